"""Operators over ordered rows of a key: runs, votes, morphology, neighbours, interpolation.

All take ``key`` (partition), ``order`` (a total order) and value columns by name; null keys are a
group of their own.  Each is one window sort on the key, shared by all of an operator's windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(key, order):
    return Window.partitionBy(*_list(key)).orderBy(*_list(order))


def _list(x):
    return [x] if isinstance(x, (str, Column)) else list(x)


def positions(df: DataFrame, key, order, name: str = "t") -> DataFrame:
    """Rows numbered from 0 within their key."""
    return df.withColumn(name, F.row_number().over(_w(key, order)) - 1)


def segment_runs(df: DataFrame, key: str, order, value: str, *, change: float = 0.5, min_pairs: int = 2, min_rows: int = 3) -> DataFrame:
    """Stable stretches: (key, start_f, end_f, n_frames), frames inclusive.

    A pair of neighbours is a transition if it differs by more than ``change`` of its larger side (1 at
    least); runs of at least ``min_pairs`` other pairs and ``min_rows`` rows count.  A null value breaks
    no run and joins none: its pairs are left out.
    """
    t = positions(df, key, order)
    w = Window.partitionBy(key).orderBy("t")
    pairs = t.select(key, "t", F.col(value).alias("v"), F.lag(value).over(w).alias("p")).filter("p IS NOT NULL AND v IS NOT NULL")
    ratio = F.abs(F.col("v") - F.col("p")) / F.greatest("v", "p", F.lit(1.0))
    marked = pairs.select(key, (F.col("t") - 1).alias("i"), F.when(ratio > change, 1).otherwise(0).alias("tr"))
    grouped = marked.withColumn("g", F.sum("tr").over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)))
    runs = grouped.filter("tr = 0").groupBy(key, "g").agg(F.min("i").alias("start_f"), (F.max("i") + 1).alias("end_f"), (F.count("*") + 1).alias("n_frames"))
    return runs.filter((F.col("n_frames") > min_pairs) & (F.col("n_frames") >= min_rows)).drop("g")


def majority(df: DataFrame, key: str, order, mask: str, *, reach: int = 3, name: str = "majority") -> DataFrame:
    """Centred majority vote of a boolean over 2 * reach + 1 rows; edge rows are repeated outwards."""
    w = _w(key, order)
    m = F.col(mask).cast("int")
    whole = Window.partitionBy(key)
    up = F.row_number().over(w)
    down = F.count("*").over(whole) - up + 1
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    votes = F.sum(m).over(w.rowsBetween(-reach, reach)) + F.greatest(F.lit(0), reach + 1 - up) * F.first(m).over(every) + F.greatest(F.lit(0), reach + 1 - down) * F.last(m).over(every)
    return df.withColumn(name, votes > reach)


def upper_median(values: Column) -> Column:
    """sorted[n / 2] of an array."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)


def adaptive_peaks(df: DataFrame, key: str, order, value: str, *, history: int = 256, times: float = 4.0) -> DataFrame:
    """Rows that top the last three and the mean of the last nine by median + times * MAD of the history."""
    w = _w(key, order)
    rows = df.withColumn("h", F.collect_list(value).over(w.rowsBetween(-(history - 1), 0)))
    rows = rows.withColumn("med", upper_median(F.col("h"))).withColumn("mad", upper_median(F.transform("h", lambda x: F.abs(x - F.col("med")))))
    top, mean = F.max(value).over(w.rowsBetween(-2, 0)), F.avg(value).over(w.rowsBetween(-8, 0))
    return rows.withColumn("peak", (F.col(value) >= top) & (F.col(value) >= mean + (F.col("med") + times * F.col("mad")) * 0.1)).drop("h")


def morph(df: DataFrame, key, order, value: str, how: str, reach: int, name: str) -> DataFrame:
    """Sliding minimum or maximum over 2 * reach + 1 rows; beyond the ends counts as nothing."""
    return df.withColumn(name, getattr(F, how)(value).over(_w(key, order).rowsBetween(-reach, reach)))


def top_hat(df: DataFrame, key, order, value: str, reach: int, name: str = "top_hat") -> DataFrame:
    """What an opening (minimum, then maximum) takes away."""
    opened = morph(morph(df, key, order, value, "min", reach, "__low"), key, order, "__low", "max", reach, "__open")
    return opened.withColumn(name, F.col(value) - F.col("__open")).drop("__low", "__open")


def longest_bridged_run(df: DataFrame, key, order, mask: str, *, gap: int = 2, fill: float = 0.5) -> DataFrame:
    """Per key the longest run of marked rows that bridges gaps up to ``gap``: (key, x0, x1, n); first of equals."""
    t = positions(df, key, order).filter(F.col(mask))
    w = Window.partitionBy(*_list(key)).orderBy("t")
    new = F.coalesce((F.col("t") - F.lag("t").over(w) - 1 > gap).cast("int"), F.lit(1))
    runs = t.withColumn("n", new).withColumn("g", F.sum("n").over(w)).groupBy(*_list(key), "g").agg(F.min("t").alias("x0"), F.max("t").alias("x1"), F.count("*").alias("n"))
    runs = runs.filter(F.col("n") >= fill * (F.col("x1") - F.col("x0") + 1))
    best = F.max_by(F.struct("x0", "x1", "n"), F.struct((F.col("x1") - F.col("x0")).alias("l"), (-F.col("x0")).alias("f"))).alias("b")
    return runs.groupBy(*_list(key)).agg(best).select(*_list(key), "b.*")


def bar_before(df: DataFrame, key, order, bar: str) -> DataFrame:
    """Rows that are no bar, with whether a bar came since the row before."""
    seen = df.withColumn("__bars", F.sum(F.col(bar).cast("int")).over(_w(key, order).rowsBetween(Window.unboundedPreceding, 0)))
    rest = seen.filter(~F.col(bar))
    return rest.withColumn("bar_before", F.col("__bars") > F.coalesce(F.lag("__bars").over(_w(key, order)), F.lit(0))).drop("__bars")


def ringing(df: DataFrame, key, order, string: str, value: str, *, back: int = 4, name: str = "ringing") -> DataFrame:
    """Of the ``back`` rows before: each string's latest value, without the row's own string, by string."""
    w = _w(key, order).rowsBetween(-back, -1)
    last = F.collect_list(F.struct(F.col(string).alias("s"), F.col(value).alias("v"))).over(w)
    kept = F.filter(last, lambda x, i: (x["s"] != F.col(string)) & ~F.exists(F.slice(last, i + 2, F.lit(back)), lambda y: y["s"] == x["s"]))
    return df.withColumn(name, F.array_sort(kept))


def neighbours(df: DataFrame, key, order, value: str) -> DataFrame:
    """``prev`` and ``next``: the nearest values that are not null before and after the row."""
    w = _w(key, order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumn("prev", before).withColumn("next", after)


def interpolate(df: DataFrame, key, order, place: str, value: str, name: str = "filled") -> DataFrame:
    """Nulls on the straight line between their neighbours by ``place``; beyond the ends the nearest value.

    The result never goes backwards: it is the running maximum.
    """
    w = _w(key, order)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(place).alias("p"), F.col(value).alias("v")))
    a = F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(at, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = df.withColumn("__a", a).withColumn("__b", b)
    span = F.col("__b.p") - F.col("__a.p")
    share = F.when(span > 1e-9, (F.col(place) - F.col("__a.p")) / span).otherwise(0.0)
    line = F.coalesce(F.col("__a.v") + share * (F.col("__b.v") - F.col("__a.v")), F.col("__a.v"), F.col("__b.v"))
    rows = rows.withColumn("__line", line)
    return rows.withColumn(name, F.max("__line").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__a", "__b", "__line")


def progress(df: DataFrame, key, order, weight: str) -> DataFrame:
    """Share of the key's weight that lies before each row, and with it."""
    w = _w(key, order)
    total = F.sum(weight).over(Window.partitionBy(*_list(key)))
    before = F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn("before", before / total).withColumn("after", (before + F.col(weight)) / total)


def neighbour_median(df: DataFrame, key, order, value: str, *, reach: int = 3, far: float = 5.0) -> DataFrame:
    """Upper median of the rows around (itself included) and whether the row is far from it."""
    around = F.collect_list(value).over(_w(key, order).rowsBetween(-reach, reach))
    return df.withColumn("median", upper_median(around)).withColumn("odd", F.abs(F.col(value) - F.col("median")) > far)


def held(df: DataFrame, key, order, mask: str, *, last: int = 3, least: int = 2) -> DataFrame:
    """Whether at least ``least`` of the last rows are marked."""
    return df.withColumn("held", F.sum(F.col(mask).cast("int")).over(_w(key, order).rowsBetween(1 - last, 0)) >= least)


def epoch_fence(df: DataFrame, key, order, epoch: str) -> DataFrame:
    """Drops rows of an epoch below one that was already seen."""
    seen = F.max(epoch).over(_w(key, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__seen", seen).filter(F.col(epoch) >= F.col("__seen")).drop("__seen")


def evidence(df: DataFrame, key, seconds: str, kind: str, *, ttl: int) -> DataFrame:
    """Kinds seen within the last ``ttl`` seconds of each row, itself included: count of distinct kinds.

    A kind's sightings make intervals that end ``ttl`` after their last one; a running sum of beginnings
    and ends counts those that are open, so no row holds a set.  A null kind is none.
    """
    own = Window.partitionBy(*_list(key), kind).orderBy(seconds)
    gap_before = F.coalesce(F.col(seconds) - F.lag(seconds).over(own) > ttl, F.lit(True))
    gap_after = F.coalesce(F.lead(seconds).over(own) - F.col(seconds) > ttl, F.lit(True))
    known = F.col(kind).isNotNull()
    cols = F.struct(*df.columns)
    marked = df.select(cols.alias("__row"), *_list(key), seconds, (known & gap_before).cast("int").alias("__open"), (known & gap_after).alias("__last"))
    rows = marked.select("__row", *_list(key), F.col(seconds).alias("__at"), F.lit(0).alias("__end"), F.col("__open").alias("__step"))
    ends = marked.filter("__last").select(F.lit(None).cast(marked.schema["__row"].dataType).alias("__row"), *_list(key), (F.col(seconds) + ttl).alias("__at"), F.lit(1).alias("__end"), F.lit(-1).alias("__step"))
    upto = Window.partitionBy(*_list(key)).orderBy("__at", "__end").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.unionAll(ends).withColumn("alive", F.sum("__step").over(upto)).filter("__end = 0").select("__row.*", "alive")


def range_extremes(df: DataFrame, key, seconds: str, value: str, *, since: int, until: int) -> DataFrame:
    """``low`` and ``high`` of the key's values from ``since`` to ``until`` seconds before each row; null without any."""
    w = Window.partitionBy(*_list(key)).orderBy(seconds).rangeBetween(-since, -until)
    return df.withColumn("low", F.min(value).over(w)).withColumn("high", F.max(value).over(w))


def local_maxima(df: DataFrame, key, order, value: str, id_col: str, *, most: int = 6) -> DataFrame:
    """Each key's ``most`` highest rows that are no lower than the row before and higher than the next, ranked; equal ones by id."""
    w = _w(key, order)
    up = F.coalesce(F.col(value) >= F.lag(value).over(w), F.lit(True))
    down = F.coalesce(F.col(value) > F.lead(value).over(w), F.lit(True))
    tops = df.withColumn("__top", up & down & F.col(value).isNotNull()).filter("__top").drop("__top")
    best = Window.partitionBy(*_list(key)).orderBy(F.desc(value), id_col)
    return tops.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)


def missed(df: DataFrame, key, order, due: str, now: Column, *, speed: float = 1.0) -> DataFrame:
    """Rows whose time ran out: now > due + max(speed / 2, gap to the next row)."""
    gap = F.coalesce(F.lead(due).over(_w(key, order)) - F.col(due), F.lit(0.0))
    return df.withColumn("missed", now > F.col(due) + F.greatest(F.lit(0.5 * speed), gap))


def explode_sequence(df: DataFrame, key, order, start: str, also: str, *, least: float = 1.0) -> DataFrame:
    """Every row at its start and its further starts, in order of time, with durations and repeat flags.

    Ties keep the input order, then the order of starts; the last row of a key lasts ``least``.
    """
    rows = df.select("*", F.posexplode(F.concat(F.array(start), F.coalesce(also, F.array().cast(df.schema[also].dataType)))).alias("k", "at"))
    w = Window.partitionBy(*_list(key)).orderBy("at", *_list(order), "k")
    return rows.withColumn("seq", F.row_number().over(w) - 1).withColumn("dur", F.greatest(F.lit(least), F.coalesce(F.lead("at").over(w) - F.col("at"), F.lit(least)))).withColumn("repeat", F.col("k") > 0)


def size_budget(df: DataFrame, key, order, size: str, *, budget: int, most: int) -> DataFrame:
    """Rows in order while their running size stays in the budget; the first overflow ends it.

    Sizes are not negative.  A key's first ``most`` rows are cut off before they are shuffled; only those are summed up.
    """
    first = df.withColumn("rank", F.row_number().over(_w(key, order))).filter(F.col("rank") <= most)
    spent = F.sum(size).over(_w(key, "rank").rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("spent", spent).filter(F.col("spent") <= budget)


def sweep_at(systems: DataFrame, shares: DataFrame, *, key: str, order: str, x0: str, x1: str, share: str) -> DataFrame:
    """Shares of a page's whole width (0 to 1, clamped), each with the system it falls in and the place there.

    (all columns of ``shares``, ``system``, ``x``); systems are at least 1 wide, and a share on the
    border of two belongs to the first.  Keys without systems have no rows.  One sort of systems and shares together.
    """
    w = _w(key, order)
    width = F.greatest(F.lit(1.0), F.col(x1) - F.col(x0))
    own = F.struct(F.col(order).alias("system"), F.col(x0).cast("double").alias("x0"), width.alias("w"), (F.sum(width).over(w) - width).alias("before"))
    ends = F.when(F.lead(order).over(w).isNull(), F.lit(float("inf"))).otherwise(F.sum(width).over(w))
    spans = systems.select(F.col(key).alias("__k"), own.alias("__span"), ends.alias("__at"))
    whole = systems.groupBy(F.col(key).alias("__k")).agg(F.sum(width).alias("__all"))
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(share))) * F.col("__all")
    asked = shares.join(whole, shares[key].eqNullSafe(whole["__k"])).select("__k", at.alias("__at"), F.struct(*shares.columns).alias("__row"))
    both = spans.withColumn("__row", F.lit(None).cast(asked.schema["__row"].dataType)).unionByName(asked.withColumn("__span", F.lit(None).cast(spans.schema["__span"].dataType)))
    # from the right: the last system seen is the first that ends at the share or beyond
    back = Window.partitionBy("__k").orderBy(F.col("__at").desc(), F.col("__span").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__s", F.last("__span", ignorenulls=True).over(back)).filter("__row IS NOT NULL AND __s IS NOT NULL")
    place = F.col("__s.x0") + F.least(F.col("__s.w"), F.col("__at") - F.col("__s.before"))
    return met.select("__row.*", F.col("__s.system").alias("system"), place.alias("x"))


def drop_words(df: DataFrame, key: str, order, *, x0: str, x1: str, big: Column, letter: Column, gap: float) -> DataFrame:
    """Rows without written words: tight runs of three or more big marks, of which two and half are letters.

    Small marks neither make nor break a run and always stay.
    """
    w = _w(key, order)
    t = df.withColumn("__big", F.coalesce(big, F.lit(False))).withColumn("__letter", F.col("__big") & F.coalesce(letter, F.lit(False)))
    last = F.last(F.when(F.col("__big"), F.col(x1)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("__big") & (last.isNull() | (F.col(x0) - last - 1 > gap))
    t = t.withColumn("__opens", opens.cast("int")).withColumn("__run", F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*_list(key), "__run")
    n, letters = (F.sum(F.col(c).cast("int")).over(whole) for c in ("__big", "__letter"))
    t = t.withColumn("__word", F.col("__big") & (n >= 3) & (letters >= 2) & (letters * 2 >= n))
    return t.filter("NOT __word").select(*df.columns)


def nearest_centre(peaks: DataFrame, rows: DataFrame, *, key: str, at: str, size: str, centre: str, low: str, high: str) -> DataFrame:
    """(key, centre, size): the greatest peak of every row, 0 without one; centres of a key are distinct.

    A peak goes to the nearest centre by ratio if it is within that row's bounds, else to the other
    of its two neighbours if it is within that one's.  One sort of peaks and rows together.
    """
    by_centre = _w(key, centre)
    later = [F.lead(c).over(by_centre).alias(f"n{i}") for i, c in enumerate((centre, low, high))]
    r = rows.select(key, F.col(centre).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(peaks.schema[size].dataType).alias("__size"), F.struct(F.col(centre).alias("c0"), F.col(low).alias("c1"), F.col(high).alias("c2"), *later).alias("__row"))
    p = peaks.select(key, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.col(size).alias("__size"), F.lit(None).cast(r.schema["__row"].dataType).alias("__row"))
    both = r.unionByName(p)
    w = _w(key, ["__at", "__kind"])
    upto = F.last("__row", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    least = F.min("__row").over(Window.partitionBy(key))
    f = F.col("__at")
    met = both.withColumn("__r", F.coalesce(upto, least)).filter("__kind = 1 AND __r IS NOT NULL")
    up = F.coalesce((f > F.col("__r.c0")) & (F.col("__r.n0") / f < f / F.col("__r.c0")), F.lit(False))
    here, there = (F.when(f.between(F.col(f"__r.{c}1"), F.col(f"__r.{c}2")), F.col(f"__r.{c}0")) for c in ("c", "n"))
    taken = met.withColumn(centre, F.when(up, F.coalesce(there, here)).otherwise(F.coalesce(here, there))).filter(F.col(centre).isNotNull())
    most = taken.groupBy(key, centre).agg(F.max("__size").alias(size))
    return rows.select(key, centre).join(most, [key, centre], "left").select(key, centre, F.coalesce(F.col(size), F.lit(0)).alias(size))
