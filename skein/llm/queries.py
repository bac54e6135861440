"""What this subpackage adds to the registry: queries, and SQL where SQL can express one."""

from __future__ import annotations

from skein.llm.decontaminate import OP2_SQL, op2_decontaminate, op2_near_matches
from skein.llm.embedding_dedup import OP10_SQL, op10_embedding_dedup, op10_search_audit
from skein.llm.embedding_whitening import op13_whitening
from skein.llm.jaccard_join import op9_jaccard_join
from skein.llm.language_id import op3_language_id
from skein.llm.license_scan import OP5_SQL, op5_license_passages, op5_license_scan
from skein.llm.line_dedup import OP1_SQL, op1_line_dedup
from skein.llm.pieces import op6_pieces
from skein.llm.quality import op11_quality
from skein.llm.suffix_dedup import op8_suffix_dedup
from skein.llm.token_alignment import op12_token_alignment
from skein.llm.toxicity import op4_toxicity
from skein.llm.url_filters import OP7_SQL, op7_url_filters

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op2_near_matches": op2_near_matches,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_license_scan": op5_license_scan,
    "op5_license_passages": op5_license_passages,
    "op6_pieces": op6_pieces,
    "op7_url_filters": op7_url_filters,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op10_search_audit": op10_search_audit,
    "op11_quality": op11_quality,
    "op12_token_alignment": op12_token_alignment,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op5_license_scan": OP5_SQL,
    "op7_url_filters": OP7_SQL,
    "op10_embedding_dedup": OP10_SQL,
}
