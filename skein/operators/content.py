"""Stored files of a sheet's pages, reused by what they hold when the sheet is saved again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def place_pages(pages: DataFrame, stored: DataFrame, *, sheet: str, position: str, sha1: str, name: str, suffix: str = "") -> DataFrame:
    """(sheet, position, sha1, name, reused): the file of every incoming page.

    A page whose content the sheet has stored keeps that file (the last one stored, if several hold
    it); the first page of a new content names a file by its place and hash, later ones share it.
    Places have three digits, four in sheets of more than 999 pages.  Pages without content are left out.
    Classes of content are aggregates, so a content that a sheet repeats combines before it is shuffled.
    """
    have = stored.filter(F.col(sha1).isNotNull()).groupBy(sheet, sha1).agg(F.max_by(name, position).alias("__old"))
    own = pages.filter(F.col(sha1).isNotNull()).select(sheet, position, sha1)
    first = own.groupBy(sheet, sha1).agg(F.min(position).alias("__first"))
    width = pages.groupBy(sheet).agg(F.when(F.count("*") > 999, 4).otherwise(3).alias("__width"))
    named = first.join(have, [sheet, sha1], "left").join(width, sheet)
    place = F.lpad(F.col("__first").cast("string"), F.greatest("__width", F.length(F.col("__first").cast("string"))), F.lit("0"))
    new = F.concat(F.lit("page-"), place, F.lit("-"), F.substring(sha1, 1, 8), F.lit(f"{suffix}.png"))
    both = own.join(named.select(sheet, sha1, "__first", "__old", F.coalesce("__old", new).alias("__name")), [sheet, sha1])
    return both.select(sheet, position, sha1, F.col("__name").alias(name), (F.col("__old").isNotNull() | (F.col(position) > F.col("__first"))).alias("reused"))


def stale_pages(placed: DataFrame, stored: DataFrame, *, sheet: str, name: str) -> DataFrame:
    """(sheet, name): stored files of saved sheets that no page uses any more."""
    saved = placed.select(sheet).distinct()
    return stored.select(sheet, name).distinct().join(saved, sheet, "left_semi").join(placed.select(sheet, name).distinct(), [sheet, name], "left_anti")
