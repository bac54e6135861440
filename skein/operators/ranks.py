"""Exact rank statistics from pre-aggregated value counts, so no group has to sit in one task as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.stages import stored

#: Index of the wanted value among n sorted ones, from 0: four rules that differ.
FLOOR = lambda q: lambda n: F.floor(F.lit(q) * (n - 1))
NEAREST = lambda q: lambda n: F.floor(F.lit(q) * (n - 1) + 0.5)
UPPER = lambda n: F.floor(n / 2)
LOWER = lambda n: F.floor((n - 1) / 2)


def exact_ranks(df: DataFrame, key, value: str, ranks: dict[str, object]) -> DataFrame:
    """(key, n, one column for each rank rule): values at exact places of the sorted group.

    Equal values are counted before they are shuffled; only distinct values are then in order, and not
    even those in one task (``running``).  Nulls are left out; a group of nulls only is absent.
    """
    keys = [key] if isinstance(key, str) else list(key)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).count()
    upto = running(counts, keys, value, {"count": "__to"}, {"count": "__n"})
    picks = [F.min(F.when(F.col("__to") > rule(F.col("__n")), F.col(value))).alias(name) for name, rule in ranks.items()]
    return upto.groupBy(*keys).agg(F.first("__n").alias("n"), *picks)


def running(df: DataFrame, keys: list[str], value: str, sums: dict[str, str], totals: dict[str, str], ranges: int | None = None) -> DataFrame:
    """Rows with running sums of columns in order of ``value`` (column -> name), and sums of the whole key.

    In two levels: rows are dealt out by ranges of (keys, value), each range of a key is summed up by
    itself and starts from the small table of the ranges before it; so one key, or one stretch of its values, fills
    many tasks.  Values have to be distinct within a key.  Where ranges begin changes no result; the dealt rows are
    stored, as their range is the number of their partition.
    """
    cut = stored(df.repartitionByRange(*([ranges] if ranges else []), *keys, value).withColumn("__range", F.spark_partition_id()))
    columns = sorted({*sums, *totals})
    part = cut.groupBy(*keys, "__range").agg(*[F.sum(c).alias(f"__p_{c}") for c in columns])
    earlier, every = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    part = part.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"),
        *[F.coalesce(F.sum(f"__p_{c}").over(earlier), F.lit(0)).alias(f"__b_{c}") for c in sums], *[F.sum(f"__p_{c}").over(every).alias(name) for c, name in totals.items()],
    )
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    within = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(F.broadcast(part) if not keys else part, same)
    for c, name in sums.items():
        out = out.withColumn(name, F.col(f"__b_{c}") + F.sum(c).over(within))
    return out.drop("__range", "__r", *[f"__k{i}" for i in range(len(keys))], *[f"__b_{c}" for c in sums])


def cell_counts(df: DataFrame, key, x: Column, y: Column) -> DataFrame:
    """Grid signature: rows of each cell (cx, cy)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.select(*keys, F.floor(x).alias("cx"), F.floor(y).alias("cy")).groupBy(*keys, "cx", "cy").agg(F.count("*").alias("n"))


def max_window_2x2(cells: DataFrame, key, count: str = "n") -> DataFrame:
    """The largest sum of a 2 x 2 block of cells."""
    keys = [key] if isinstance(key, str) else list(key)
    anchors = F.explode(F.array(*[F.struct((F.col("cx") - dx).alias("ax"), (F.col("cy") - dy).alias("ay")) for dx in (0, 1) for dy in (0, 1)]))
    sums = cells.select(*keys, count, anchors.alias("a")).groupBy(*keys, "a").agg(F.sum(count).alias("s"))
    return sums.groupBy(*keys).agg(F.max("s").alias("max_2x2"))


def ranked_composite(df: DataFrame, pixel, value: str, *, rank: float = 0.65, gate: float, share: float = 0.6) -> DataFrame:
    """Each pixel's value at a rank of its samples, kept only if enough samples pass the gate, else 0."""
    keys = [pixel] if isinstance(pixel, str) else list(pixel)
    ranks = exact_ranks(df, keys, value, {"v": FLOOR(rank)})
    votes = df.groupBy(*keys).agg(F.count_if(F.col(value) > gate).alias("votes"))
    both = ranks.join(votes, keys)
    return both.select(*keys, "n", "votes", F.when(F.col("votes") >= F.ceil(F.lit(share) * F.col("n")), F.col("v")).otherwise(0).alias("v"))


def weighted_vote(df: DataFrame, cluster: str, label: str, weight: Column) -> DataFrame:
    """The heaviest label of each cluster (smallest of equals), its share, and whether others voted."""
    by = df.groupBy(cluster, label).agg(F.sum(weight).alias("w"))
    best = F.max_by(F.struct(F.col(label).alias("l"), F.col("w").alias("w")), F.struct("w", (-F.col(label)).alias("o")))
    out = by.groupBy(cluster).agg(best.alias("b"), F.sum("w").alias("total"), (F.count("*") > 1).alias("dissent"))
    return out.select(cluster, F.col("b.l").alias("winner"), (F.col("b.w") / F.col("total")).alias("share"), "dissent")


def present(df: DataFrame, key: str, value: str, *, q: float = 0.6, share: float = 0.3) -> DataFrame:
    """Rows with ``present``: a value above 0 and of at least ``share`` of its key's q-th rank; nulls are absent."""
    at = exact_ranks(df.filter(F.col(value).isNotNull()).select(key, value), key, value, {"__at": NEAREST(q)}).select(F.col(key).alias("__key"), "__at")
    joined = df.join(at, F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.withColumn("present", F.coalesce((F.col(value) > 0) & (F.col(value) >= share * F.col("__at")), F.lit(False))).drop("__key", "__at")
