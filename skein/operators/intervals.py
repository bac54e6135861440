"""Points and the intervals that hold them, by dyadic cells; frames that many pages ask for, read once.

An interval is the union of at most two cells of each power-of-two size, so a long one has few cells and
not one for each bucket that it crosses.  A point is in one cell of each size.  The join is an equi-join on
(key, size, cell) whose pairs are exactly the results: each once, and none to be filtered away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CELL = "array<struct<level:int,cell:bigint>>"


def cover(lo: Column, hi: Column) -> Column:
    """The cells of the whole numbers lo to hi, both included, as array<struct<level, cell>>; none if hi < lo or one is null."""

    def widen(state: Column, level: Column) -> Column:
        a, b = state["a"], state["b"]
        left = F.when((a < b) & (F.pmod(a, F.lit(2)) == 1), F.array(F.struct(level.alias("level"), a.alias("cell")))).otherwise(F.array().cast(_CELL))
        up = a + F.pmod(a, F.lit(2))
        right = F.when((up < b) & (F.pmod(b, F.lit(2)) == 1), F.array(F.struct(level.alias("level"), (b - 1).alias("cell")))).otherwise(F.array().cast(_CELL))
        return F.struct(F.shiftright(up, 1).alias("a"), F.shiftright(b, 1).alias("b"), F.concat(state["cells"], left, right).alias("cells"))

    start = F.struct(lo.alias("a"), (hi + 1).alias("b"), F.array().cast(_CELL).alias("cells"))
    largest = F.ceil(F.log2((hi - lo + 2).cast("double"))).cast("int")  # no cell is larger than the interval
    cells = F.aggregate(F.sequence(F.lit(0), largest), start, widen, lambda s: s["cells"])
    return F.when(lo <= hi, cells).otherwise(F.array().cast(_CELL))


def within(points: DataFrame, intervals: DataFrame, *, key: str | list[str], at: str, lo: str, hi: str) -> DataFrame:
    """Pairs of a point and an interval of its key with lo <= at <= hi, as all columns of both.

    ``at``, ``lo`` and ``hi`` are whole numbers below 2**62 in size.  The column ``key`` appears once; other names
    must differ; it may be a list.  Null keys, places and ends, and intervals that end before they begin, pair with
    nothing; repeated rows pair each.  Only sizes that some interval uses are looked up.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cells = intervals.withColumn("__c", F.explode(cover(F.col(lo).cast("long"), F.col(hi).cast("long")))).withColumns({"__level": F.col("__c.level"), "__cell": F.col("__c.cell")}).drop("__c")
    levels = sorted(r[0] for r in cells.select("__level").distinct().collect())  # 63 at most
    if not levels:
        return points.limit(0).join(intervals, keys)
    looked = F.explode(F.array(*[F.lit(x) for x in levels]))
    own = points.withColumn("__level", looked).withColumn("__cell", F.expr(f"shiftright(cast(`{at}` as bigint), __level)"))
    return own.join(cells, [*keys, "__level", "__cell"]).drop("__level", "__cell")


def sample_frames(pages: DataFrame, *, lo: str = "lo", hi: str = "hi", most: int = 11, name: str = "frame") -> DataFrame:
    """A row for each of at most ``most`` frames, spread evenly from ``lo`` to ``hi``, of each page; the plan of a scan."""
    n = F.col(hi) - F.col(lo) + 1
    k = F.least(n, F.lit(most))
    spread = F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), lambda i: (F.col(lo) + F.floor((i * (n - 1) + F.floor((k - 1) / 2)) / F.greatest(k - 1, F.lit(1)))).cast("long"))
    return pages.filter(n > 0).withColumn(name, F.explode(spread))


def frames_for_pages(frames: DataFrame, plan: DataFrame, *, key: str, frame: str, page: list[str], **made: Column) -> DataFrame:
    """(key, page columns, n_samples, ``made`` ...) from one scan of ``frames``, however many pages want a frame.

    ``plan`` names the frames that each page wants (``sample_frames``); a frame asked for by several pages is
    read once and goes to each.  Only wanted frames are kept before anything is shuffled with them, and
    aggregates are partly made where frames are read.
    """
    wanted = plan.select(key, frame, *page).distinct()
    return frames.join(wanted, [key, frame]).groupBy(key, *page).agg(F.count("*").alias("n_samples"), *[c.alias(n) for n, c in made.items()])
