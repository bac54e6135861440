"""Recursive splitting of stable runs at their clearest change, one level of all runs at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.stages import stored

#: Frames of a slice, within which neighbours are looked up; a slice also holds the first frames of the next.
SLICE = 4096
#: Segments shorter than three times this have no distance to compare.
LEAST_LAG = 3


def signature_distance(a: Column, b: Column, floor: float) -> Column:
    """L1 distance of two arrays of counts over the larger of their sums, ``floor`` and 1."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return total(F.zip_with(a, b, lambda p, q: F.abs(p - q).cast("double"))) / F.greatest(total(a), total(b), F.lit(float(floor)), F.lit(1.0))


def lagged_distances(frames: DataFrame, key: str, frame: str, sig: str, lags: list[int], floor: float) -> DataFrame:
    """(key, f, d): distances of frame f to f + lag, by lag; null where that frame is missing.

    Frames are cut into slices that borrow the first frames of the next one, so a key with a third of
    all frames is many groups.
    """
    reach = max(lags)
    cell = F.floor(F.col(frame) / SLICE)
    lend = F.when(F.pmod(F.col(frame), F.lit(SLICE)) < reach, F.array(cell, cell - 1)).otherwise(F.array(cell))
    cut = frames.select(F.col(key).alias("k"), F.col(frame).cast("long").alias("f"), F.col(sig).cast("array<double>").alias("sig"), F.explode(lend).alias("slice"))
    w = Window.partitionBy("k", "slice").orderBy("f")
    # frames may be missing: the row that is `lag` frames later is at most `lag` rows later
    later = F.collect_list(F.struct("f", "sig")).over(w.rowsBetween(1, reach))
    near = cut.withColumn("later", later).filter(F.floor(F.col("f") / SLICE) == F.col("slice"))
    one = lambda lag: F.filter("later", lambda x: x["f"] == F.col("f") + lag)
    d = F.array(*[F.when(F.size(one(lag)) > 0, signature_distance(F.col("sig"), F.get(one(lag), F.lit(0))["sig"], floor)) for lag in lags])
    return near.select("k", "f", d.alias("d"))


def refine_runs(frames: DataFrame, runs: DataFrame, *, key: str, frame: str, sig: str, change: float, floor: float = 1.0, lag: int = 8, min_frames: int = 4) -> DataFrame:
    """Runs (key, start_f, end_f), split where two frames some way apart differ most; (key, start_f, end_f, n_frames).

    A segment of n frames compares frames L = min(lag, n / 3) apart, if L is at least 3.  The pair with
    the largest distance, the first of equal ones, splits it half-way between if that distance is over
    ``change`` and both sides keep ``min_frames``; the parts are split again.

    All segments that may still split go through a round together: a partial maximum for each task and
    segment, one join of the segments that split with their frames, and a table that ends the lineage.
    Rounds are as many as the deepest nesting of splits.  Runs of a key must not overlap; a frame
    outside all runs, or that is missing, has no part.  Null keys form no run.
    """
    lags = list(range(LEAST_LAG, lag + 1))
    whole = runs.select(F.col(key).alias("k"), F.col("start_f").cast("long").alias("lo"), F.col("end_f").cast("long").alias("hi")).filter("k IS NOT NULL AND lo <= hi")
    whole = stored(whole)
    if lag < LEAST_LAG:
        return _named(whole, key)
    usable = whole.filter(_lag(lag) >= LEAST_LAG)
    rows = stored(_within(lagged_distances(frames, key, frame, sig, lags, floor), usable))
    done = [whole.filter(_lag(lag) < LEAST_LAG)]
    while True:
        # the distance for the segment's own lag, of pairs inside the segment; the earliest of equal ones
        inside = rows.withColumn("lag", _lag(lag).cast("int")).withColumn("x", F.get("d", F.col("lag") - LEAST_LAG)).filter("f + lag <= hi AND x IS NOT NULL")
        best = inside.groupBy("k", "lo", "hi", "lag").agg(F.max(F.struct("x", (-F.col("f")).alias("nf"))).alias("top")).filter(F.col("top.x") > change)
        cut = best.select("k", "lo", "hi", (-F.col("top.nf") + F.ceil(F.col("lag") / 2)).alias("cut"))
        cut = stored(cut.filter((F.col("cut") - F.col("lo") >= min_frames) & (F.col("hi") - F.col("cut") + 1 >= min_frames)))
        done.append(usable.join(cut, ["k", "lo", "hi"], "left_anti"))
        if cut.isEmpty():
            break
        parts = cut.select("k", F.explode(F.array(F.struct("lo", (F.col("cut") - 1).alias("hi")), F.struct(F.col("cut").alias("lo"), "hi"))).alias("s")).select("k", "s.lo", "s.hi")
        done.append(parts.filter(_lag(lag) < LEAST_LAG))
        usable = parts.filter(_lag(lag) >= LEAST_LAG)
        left = F.col("f") < F.col("cut")
        moved = rows.join(cut, ["k", "lo", "hi"]).select("k", "f", "d", F.when(left, F.col("lo")).otherwise(F.col("cut")).alias("lo"), F.when(left, F.col("cut") - 1).otherwise(F.col("hi")).alias("hi"))
        rows = stored(moved.filter(_lag(lag) >= LEAST_LAG))
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return _named(out, key)


def _lag(most: int) -> Column:
    return F.least(F.lit(most), F.floor((F.col("hi") - F.col("lo") + 1) / 3))


def _within(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows with the bounds of their run.  Runs are cut at slices, so that the join has a key besides the run's."""
    cells = runs.withColumn("slice", F.explode(F.sequence(F.floor(F.col("lo") / SLICE), F.floor(F.col("hi") / SLICE))))
    cut = rows.withColumn("slice", F.floor(F.col("f") / SLICE))
    return cut.join(cells, ["k", "slice"]).filter("f BETWEEN lo AND hi").drop("slice")


def _named(runs: DataFrame, key: str) -> DataFrame:
    return runs.select(F.col("k").alias(key), F.col("lo").alias("start_f"), F.col("hi").alias("end_f"), (F.col("hi") - F.col("lo") + 1).alias("n_frames"))
