"""The pipeline against a brute-force version of its five decisions."""

import random

import pytest

import corpus_pipeline
from skein.llm import pieces
from tests.llm.test_lines_urls_licences import brute_lines
from tests.llm.test_search_and_joins import brute_groups, brute_hits

EN = "the and with that have this from they would there their what about which when make like time just know take people into year your good some could them other than then look only come over think also back after work first well even want because these give most".split()
DE = "der die und nicht sich auch eine oder wenn aber nach noch schon über durch werden wurde haben sein ihre dieser zwischen gegen ohne jahr zeit mensch immer wieder heute mehr viel große neue erste unter während könnte müssen sollte deutsch straße".split()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    g = random.Random(11)
    rows = []
    for i in range(40):
        words = EN if i % 2 else DE
        lines = [" ".join(g.choices(words, k=14)) for _ in range(5)]
        if i % 3 == 0:
            lines.insert(2, "Subscribe to OUR letter" if i % 2 else "  subscribe to our letter ")
        rows.append((i, "\n".join(lines), "en" if i % 2 else "de"))
    item = " ".join(g.choices(EN, k=16))
    rows += [(50, rows[1][1] + " again", "en"), (51, "12345 67", "en"), (52, None, None), (53, "subscribe to our letter", "en"), (54, " ".join(g.choices(EN, k=30)) + " " + item.upper(), None), (55, rows[4][1], "de"), (None, " ".join(g.choices(DE, k=40)), "de")]
    base = tmp_path_factory.mktemp("corpus")
    full = [(i, t, lang, "src", None if t is None else len(t)) for i, t, lang in rows]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(7, item), (8, None)], "item_id bigint, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base), rows, item


def brute(rows, item):
    kept = [(i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t)]
    key = {n: (i if i is not None else -1) for n, (i, _) in enumerate(kept)}
    lined = brute_lines([(key[n], t) for n, (_, t) in enumerate(kept)], 10, "first")
    left = [(i, text) for i, (n, gone, text) in lined.items() if not gone or (gone < n and text.strip(" "))]
    groups = brute_groups(left)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    hits = brute_hits(left, [(7, item)])
    return {(None if i == -1 else i): t for i, t in left if not hits[i][4]}


def test_pipeline_equals_brute_force(spark, corpus):
    path, rows, item = corpus
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    want = brute(rows, item)
    assert set(got) == set(want)
    v = pieces.Pieces.load()
    assert all(v.decode(r.ids) == want[i] and r.round_trip and r.n_pieces == len(r.ids) for i, r in got.items())
    assert not {50, 51, 52, 53, 54, 55} & set(got) and got[1].n_chars == len(want[1])


def test_stages_keep_the_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "jaccard_join", "decontaminate", "pieces"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, corpus[0]).columns == docs.columns
        assert stage(spark, docs.limit(0), corpus[0]).count() == 0


def test_rows_are_decided_one_by_one(spark, tmp_path):
    """Shared and null ids: a contaminated or similar row takes no other row with it, and repeated rows leave one."""
    g = random.Random(3)
    clean = [" ".join(g.choices(EN, k=40)) for _ in range(4)]
    item = " ".join(g.choices(EN, k=16))
    rows = [(4, clean[0]), (4, clean[1] + " " + item), (None, clean[2]), (None, clean[3] + " " + item), (4, clean[2] + " also"), (9, clean[0]), (9, clean[0]), (None, " \n"), (None, " \n")]
    full = [(i, t, "en", "src", len(t)) for i, t in rows]
    docs = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(7, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert sorted((r.doc_id or -1, r.text) for r in left.collect()) == sorted((i or -1, t) for i, t in rows if item not in t)
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    want = [rows[0], rows[1], rows[3], rows[4], rows[7], rows[8]]
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted((i or -1, t) for i, t in want)
