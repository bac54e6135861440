"""Two readers' transcripts of the same pages: how far they agree, and which pages become final."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNSURE = r"\?\z"


def plain(tokens: Column) -> Column:
    """An event's tokens without marks of doubt, in order of their text."""
    return F.array_sort(F.transform(tokens, lambda t: F.regexp_replace(t, _UNSURE, "")))


def _same(a: Column, b: Column) -> Column:
    return F.coalesce(plain(a) == plain(b), F.lit(False))


def agreement(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, events, agreed): aligned pairs of token arrays, null where one side has no event; such pairs disagree."""
    return pairs.groupBy(key).agg(F.count("*").alias("events"), F.count_if(_same(F.col(a), F.col(b))).alias("agreed"))


def promote(a: DataFrame, b: DataFrame, *, page: str, order: str, tokens: str) -> DataFrame:
    """Events of the pages that both readers have read alike, event for event, as (page, order, tokens).

    Doubts of either reader stay: a token that ``b`` doubts anywhere on the page is marked in ``a``'s
    text too.  Pages that only one reader has, and events that are null, settle nothing.
    """
    two = a.select(page, order, F.col(tokens).alias("__a")).join(b.select(page, order, F.col(tokens).alias("__b")), [page, order], "full")
    alike = two.groupBy(page).agg(F.bool_and(_same(F.col("__a"), F.col("__b"))).alias("__alike")).filter("__alike").select(page)
    doubts = b.select(page, F.explode(tokens).alias("__t")).filter(F.endswith("__t", F.lit("?")))
    marks = doubts.groupBy(page).agg(F.collect_set(F.regexp_replace("__t", _UNSURE, "")).alias("__marks"))
    kept = a.select(page, order, tokens).join(alike, page, "left_semi").join(marks, page, "left")
    known = F.coalesce("__marks", F.array().cast("array<string>"))
    marked = F.transform(tokens, lambda t: F.when(F.array_contains(known, t), F.concat(t, F.lit("?"))).otherwise(t))
    return kept.select(page, order, marked.alias(tokens))
