"""Corpus pipeline: documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes
every stage's result as Parquet and reads it again, so a lost executor repeats one stage at most.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontaminate, jaccard_join, language_id, line_dedup, pieces
from skein.llm.native import row_key
from skein.llm.store import materialise

#: A document goes if no language has this share of it, or none can be told.
LEAST_SHARE = 0.4
#: Lines of so many documents stay in the first of them only.
LINE_DOCS = 10


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or a main language; a missing ``lang`` becomes the prediction."""
    judged = language_id.predict(docs, language_id.fit_on(docs))
    kept = judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts common lines from all documents but the first that has them; what is left empty goes."""
    done = line_dedup.dedup_lines(docs, keep="first", min_docs=LINE_DOCS)
    kept = done.filter((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines")) & (F.trim("kept_text") != ""))
    text = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return kept.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one row stays: that of the smallest id, null ids last, and of the smallest ``row_key``.

    Decided by row: texts that share an id, or have none, are different documents.  Texts without
    words are in no group and stay.
    """
    groups = jaccard_join.similar_groups(docs).filter("group_id IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first")
    kept = groups.groupBy("group_id").agg(first).select(F.col("first.doc_id").alias("__kept"), F.col("first.row_key").alias("__key"))
    has_words = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    own = docs.filter(has_words).withColumn("__own", row_key(F.col("doc_id"), F.col("text")))
    own = own.join(kept, own["doc_id"].eqNullSafe(kept["__kept"]) & (own["__own"] == kept["__key"]), "left_semi")
    return own.dropDuplicates(["doc_id", "__own"]).select(docs.columns).unionAll(docs.filter(~has_words))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the rows whose text holds a window of a benchmark item."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.decontaminate(docs, bench).filter("contaminated").select(F.col("doc_id").alias("__bad"), F.col("row_key").alias("__key")).distinct()
    own = docs.withColumn("__own", row_key(F.col("doc_id"), F.col("text")))
    return own.join(found, own["doc_id"].eqNullSafe(found["__bad"]) & (own["__own"] == found["__key"]), "left_anti").select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document's whole text."""
    return pieces.encode(docs).select("doc_id", "lang", "source", "n_chars", "n_pieces", "ids", "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pieces", encode_pieces),
]

#: Mixture inference and piece lattices have no SQL form; tests compare ``run`` with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
