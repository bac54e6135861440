"""A searchable document library: search, sort, upsert, delete, budgets, cleaning, all as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import contains_all, fold, folded, natural_key
from skein.sources.stages import arrow_batches


def search(docs: DataFrame, query: str, fields: list[str], *, ascii_only: bool = False) -> DataFrame:
    """Rows whose fields together contain every term; NFKC folding unless the text is known ASCII.

    Only texts that are not ASCII are folded in Python, in batches of bounded size.
    """
    hay = F.concat_ws("\n", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    if ascii_only:
        return docs.filter(contains_all(F.lower(hay), query.lower()))
    arrow_batches(docs.sparkSession)
    beyond = hay.rlike(r"[^\x00-\x7f]")
    return docs.filter(contains_all(F.coalesce(fold(F.when(beyond, hay)), F.lower(hay)), query.lower()))


#: Sort orders of the library list: columns (title, artist, updated, added, pages); ``who`` is the artist or else the channel.
SORTS = {
    "edited": lambda who: [F.desc("updated"), F.asc("id")],
    "added": lambda who: [F.desc("added"), F.asc("id")],
    "title": lambda who: [natural_key(F.col("title")).asc(), F.asc("id")],
    "artist": lambda who: [(F.coalesce(who, F.lit("")) == "").asc(), folded(who).asc(), natural_key(F.col("title")).asc(), F.asc("id")],
    "pages": lambda who: [F.desc("pages"), natural_key(F.col("title")).asc(), F.asc("id")],
}


def listing(sheets: DataFrame, sort: str = "edited", limit: int = 60) -> DataFrame:
    """The first rows in the wanted order; unknown orders mean ``edited``.

    Titles compare with their numbers as numbers, without case and accents; where there is a ``channel``, it
    stands in for an artist that is null or empty.
    """
    who = F.when(F.col("artist") != "", F.col("artist")) if "artist" in sheets.columns else F.lit(None).cast("string")
    who = F.coalesce(who, F.col("channel")) if "channel" in sheets.columns else who
    return sheets.orderBy(*SORTS.get(sort, SORTS["edited"])(who)).limit(limit)


def clean(raw: DataFrame, spec: dict[str, tuple]) -> DataFrame:
    """Coerce, clamp, shorten and default columns: name -> ("text", longest) or ("number", low, high, default)."""
    out = []
    for name, (kind, *args) in spec.items():
        c = F.col(name)
        if kind == "text":
            out.append(F.left(F.coalesce(F.trim(c.cast("string")), F.lit("")), F.lit(args[0])).alias(name))
        else:
            low, high, default = args
            n = c.try_cast("double")
            out.append(F.when(n.isNull() | F.isnan(n), F.lit(default)).otherwise(F.least(F.greatest(n, F.lit(low)), F.lit(high))).alias(name))
    return raw.select(*out)


def totals(sheets: DataFrame, size: Column) -> DataFrame:
    return sheets.agg(F.count("*").alias("sheets"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def with_pages(sheets: DataFrame, pages: DataFrame, key: str, index: str, page: str) -> DataFrame:
    """Each sheet with its pages in order; sheets without pages have an empty list."""
    own = pages.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(index, page))), lambda x: x[page]).alias("pages"))
    return sheets.join(own, key, "left").withColumn("pages", F.coalesce("pages", F.array().cast(own.schema["pages"].dataType)))


def migrate(source: DataFrame, target: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows to copy: neither in the target nor copied before."""
    return source.join(target.select(key), key, "left_anti").join(done.select(key), key, "left_anti")
