"""Line dedup: range-partitioned line hashes, decisions as run-length keep bitmaps.

Only hashes travel.  Every line becomes (128-bit hash, document, position); the hashes are range
partitioned with a secondary sort by document and position, and a streaming window over each group
finds first occurrences and counts documents.  A line that a third of all documents share would
make one such group too large, so the range key carries a salt taken from the document: a group is
cut into at most ``salts`` ranges, each streamed by itself, and their one-row summaries are combined
after a map-side aggregation.  Texts are split once; the hashes are a table that both the sort and the
decisions read.  What returns to the documents is a compressed bitmap: the lines that go, as runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.native import WHITE, ascii_lower, lines_of, sha256_hex, text_key
from skein.llm.store import materialise

SALTS = 64


def line_key(line):
    """A line's identity: ASCII white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def occurrences(docs: DataFrame, id_col: str, text_col: str, salts: int = SALTS) -> DataFrame:
    """One row for each line with a non-empty key: (h1, h2, salt, doc, th, pos)."""
    lines = docs.select(F.col(id_col).alias("doc"), text_key(F.col(text_col)).alias("th"), F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    keyed = lines.select("doc", "th", "pos", line_key(F.col("line")).alias("key")).filter("key <> ''")
    return keyed.select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.pmod(F.col("th"), F.lit(salts)).cast("int").alias("salt"), "doc", "th", "pos"
    )


def decisions(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "first", min_docs: int = 2, salts: int = SALTS) -> DataFrame:
    """Lines to drop: (doc, th, pos).

    A key counts once for each document.  Keys in at least ``min_docs`` documents lose all lines
    (``keep="none"``) or all but the first by document and position (``keep="first"``; with
    ``min_docs=1`` repeats inside one document go too).
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    occ = materialise(occurrences(docs, id_col, text_col, salts), "lines")
    ranged = occ.repartitionByRange("h1", "h2", "salt")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy("doc", "th", "pos")
    same = F.col("doc").eqNullSafe(F.lag("doc").over(stream)) & F.col("th").eqNullSafe(F.lag("th").over(stream))
    heads = ranged.withColumn("new", F.when(same, 0).otherwise(1)).filter("new = 1")
    part = heads.groupBy("h1", "h2", "salt").agg(F.count("*").alias("n"), F.min(F.struct("doc", "th", "pos")).alias("first"))
    total = part.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.collect_set("salt").alias("salts"))
    marked = total.filter(F.col("n") >= min_docs).select("h1", "h2", "first", F.explode("salts").alias("salt"))
    hit = occ.join(marked, ["h1", "h2", "salt"])
    if keep == "first":
        hit = hit.filter(~F.struct("doc", "th", "pos").eqNullSafe(F.col("first")))
    return hit.select("doc", "th", "pos")


def keep_bitmaps(docs: DataFrame, **how) -> DataFrame:
    """(doc, th, n_dropped, dropped): for each document that loses lines, the dropped places as runs (start, len), ascending."""
    places = decisions(docs, **how).groupBy("doc", "th").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    heads = F.filter(F.sequence(F.lit(0), F.size("at") - 1), lambda i: (i == 0) | (F.get("at", i) - F.get("at", i - 1) > 1))
    runs = F.transform("heads", lambda h, k: F.struct(F.get("at", h).alias("start"), (F.coalesce(F.get("heads", k + 1), F.size("at")) - h).alias("len")))
    return places.withColumn("heads", heads).select("doc", "th", F.size("at").cast("long").alias("n_dropped"), runs.alias("dropped"))


def _kept(dropped, n):
    """The kept lines as runs (start, len): what lies between the dropped ones."""
    ends = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda r: r["start"] + r["len"]))
    runs = F.transform(ends, lambda e, k: F.struct(e.alias("start"), (F.coalesce(F.get(dropped, k)["start"], n) - e).alias("len")))
    return F.filter(runs, lambda r: r["len"] > 0)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Every row of ``docs`` with ``keep_runs`` (bitmap), ``n_lines``, ``n_dropped`` and ``kept_text``.

    Null and empty texts: one empty line, never dropped, kept text ''.  Lines that are empty after
    stripping have no key and stay.  Rows that repeat id and text count as one document and get the
    same result; rows that share only the id are separate documents.  A null id is a value like
    others.  Input columns named like an output column are replaced; other columns pass through.
    """
    out = [c for c in docs.columns if c not in ("keep_runs", "n_lines", "n_dropped", "kept_text")]
    doc, th, key, count, dropped = (_free(name, out) for name in ("__doc", "__th", "__key", "__count", "__dropped"))
    lost = keep_bitmaps(docs, id_col=id_col, text_col=text_col, **how).toDF(doc, th, count, dropped)
    own = docs.select(*out, text_key(F.col(text_col)).alias(key))
    joined = own.join(lost, own[id_col].eqNullSafe(F.col(doc)) & (F.col(key) == F.col(th)), "left")
    lines = lines_of(F.col(text_col))
    none = F.array().cast("array<struct<start:int,len:int>>")
    runs = joined.withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", F.coalesce(F.col(count), F.lit(0)).cast("long"))
    runs = runs.withColumn("keep_runs", _kept(F.coalesce(F.col(dropped), none), F.col("n_lines").cast("int")))
    text = F.array_join(F.flatten(F.transform("keep_runs", lambda r: F.slice(lines, r["start"] + 1, r["len"]))), "\n")
    kept = F.when(F.col("n_dropped") == 0, F.coalesce(F.col(text_col), F.lit(""))).otherwise(text)
    return runs.withColumn("kept_text", kept).select(*out, "keep_runs", "n_lines", "n_dropped", "kept_text")


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """``documents`` without the lines that ten documents or more share."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = dedup_lines(docs, keep="none", min_docs=10)
    return done.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("kept_text")).alias("kept_sha256"))


OP1_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
k AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos,
             unnest(list_transform(ls, lambda x: translate(trim(x, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS key FROM d),
f AS (SELECT key AS fkey FROM (SELECT DISTINCT doc_id, key FROM k WHERE length(key) >= 1) GROUP BY key HAVING count(*) >= 10)
SELECT doc_id, count(*) AS n_lines, count(fkey) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE fkey IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON key = fkey GROUP BY doc_id
"""
