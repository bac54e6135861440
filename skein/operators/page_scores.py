"""Scores of read pages against labels, event by event, with notes that stand in a neighbouring event told apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTS = ["tp", "fp", "fn", "split", "merged", "wrong_fret", "wrong_string", "missed", "extra", "tech_truth", "tech_read", "tech_hit", "chords", "chords_exact"]


def _code(n: Column) -> Column:
    """String and fret of a note in one number; a muted note has no fret."""
    return n["string"] * 1000 + F.coalesce(n["fret"], F.lit(-1)) + 1


def _inside(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def _choices(df: DataFrame, page: str) -> DataFrame:
    """Adds ``choice``: which neighbour an event without a partner belongs to (-1, 1 or 0 for none).

    The earlier neighbour comes first, unless the event before it took the same notes of it.  Rows stream through a
    task in order of page and place; two choices are held.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, one, two = object(), 0, 0
        for pdf in frames:
            out = []
            for p, back, on, again in zip(pdf[page], pdf["__back"], pdf["__on"], pdf["__again"], strict=True):
                if p != own:
                    own, one, two = p, 0, 0
                now = -1 if back and not (again and two == 1) else 1 if on else 0
                out.append(now)
                one, two = now, one
            yield pdf[[page, "__pos"]].assign(choice=out)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.select(page, "__pos", "__back", "__on", "__again").repartition(page).sortWithinPartitions(page, "__pos")
    return rows.mapInPandas(run, f"{page} {kinds[page]}, __pos {kinds['__pos']}, choice int")


def score_pages(pairs: DataFrame, page: str, pos: str, *, read: str = "read", truth: str = "truth", scored=("h", "p", "b", "s")) -> DataFrame:
    """Counts of each page: hits, false and missing notes, and why (see ``COUNTS``).

    ``pairs`` are aligned events in order; ``read`` is array<struct<string,fret,tech>>, ``truth`` has ``unsure`` too, and
    the side that has no partner is null.  ``pos`` is unique in a page.  Unsure notes, and what was read on their strings,
    count for nothing.  An event without a partner whose notes are all missing from a neighbouring pair is split off from
    it; the other way round it was merged into it.  A string carries one note of an event at most.  A null page is left out.
    """
    w = Window.partitionBy(page).orderBy("__pos")
    none = F.array().cast("array<int>")
    codes = lambda c: F.coalesce(F.transform(c, _code), none)
    d = pairs.filter(F.col(page).isNotNull()).select(page, F.col(pos).alias("__pos"), F.col(read).alias("r"), F.col(truth).alias("t"))
    doubt = F.transform(F.filter(F.coalesce("t", F.slice("t", 1, 0)), lambda n: F.coalesce(n["unsure"], F.lit(False))), lambda n: n["string"])
    sure = F.filter("t", lambda n: ~F.coalesce(n["unsure"], F.lit(False)))
    d = d.withColumn("doubt", F.coalesce(doubt, none)).withColumn("ts", sure).withColumn("rs", F.filter("r", lambda n: ~F.array_contains(F.col("doubt"), n["string"])))
    d = d.withColumn("tk", codes(F.col("ts"))).withColumn("rk", codes(F.col("rs"))).withColumn("pair", F.col("r").isNotNull() & F.col("t").isNotNull())
    d = d.withColumn("lost", F.array_except("tk", "rk")).withColumn("false", F.array_except("rk", "tk"))

    # What an event without a partner holds, and what its neighbours lack or have too many of.
    alone = F.when(F.col("t").isNull(), F.col("rk")).when(F.col("r").isNull(), F.col("tk"))
    d = d.withColumn("alone", F.when(F.size(alone) > 0, alone)).withColumn("kind", F.when(F.col("t").isNull(), 1).when(F.col("r").isNull(), 2).otherwise(0))

    def near(step: int) -> Column:
        shift = F.lag if step < 0 else F.lead
        short = F.when(F.col("kind") == 1, shift("lost").over(w)).otherwise(shift("false").over(w))
        return F.coalesce(F.col("alone").isNotNull() & shift("pair").over(w) & _inside(F.col("alone"), short), F.lit(False))

    again = (F.lag("kind", 2).over(w) == F.col("kind")) & F.arrays_overlap("alone", F.lag("alone", 2).over(w))
    d = d.select("*", near(-1).alias("__back"), near(1).alias("__on"), F.coalesce(again, F.lit(False)).alias("__again"))
    d = d.join(_choices(d, page), [page, "__pos"])

    def taken(kind: int) -> Column:
        one = lambda shift, way: F.when((shift("choice").over(w) == way) & (shift("kind").over(w) == kind), shift("alone").over(w)).otherwise(none)
        return F.concat(one(F.lag, 1), one(F.lead, -1))

    d = d.select("*", taken(1).alias("split_off"), taken(2).alias("merged_in"))
    d = d.withColumn("lost", F.array_except("lost", "split_off")).withColumn("false", F.array_except("false", "merged_in"))
    string = lambda c: F.transform(c, lambda k: F.floor(k / 1000).cast("int"))
    fret = lambda c: F.transform(c, lambda k: k % 1000)
    d = d.withColumn("both", F.array_intersect(string(F.col("lost")), string(F.col("false"))))
    rest = lambda c: F.filter(c, lambda k: ~F.array_contains(F.col("both"), F.floor(k / 1000).cast("int")))
    d = d.withColumn("lf", fret(rest("lost"))).withColumn("ff", fret(rest("false")))
    times = lambda c, x: F.size(F.filter(c, lambda y: y == x))
    moved = F.aggregate(F.array_distinct("lf"), F.lit(0), lambda a, x: a + F.least(times("lf", x), times("ff", x)))
    d = d.withColumn("moved", moved)

    hits = F.array_intersect("tk", "rk")
    marks = lambda notes: F.flatten(F.transform(F.filter(notes, lambda n: F.array_contains(hits, _code(n))), lambda n: F.transform(F.array_intersect(F.coalesce(n["tech"], F.array().cast("array<string>")), F.array(*map(F.lit, scored))), lambda m: F.concat(n["string"].cast("string"), m))))
    strings = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda n: n["string"])))
    pair, claimed, size = F.col("pair"), F.col("choice") != 0, F.size("alone")
    count = lambda c, n=1: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("bigint")
    wrong_fret, free = F.size("both"), ~pair & ~claimed & F.col("alone").isNotNull()
    missed = F.when(pair, F.size("lost") - wrong_fret - F.col("moved")).when(free & (F.col("kind") == 2), size).otherwise(0)
    extra = F.when(pair, F.size("false") - wrong_fret - F.col("moved")).when(free & (F.col("kind") == 1), size).otherwise(0)
    d = d.withColumn("missed", missed).withColumn("extra", extra)
    shared = F.when(claimed, size).when(pair, wrong_fret + F.col("moved")).otherwise(0)
    tech_t, tech_r = marks(F.col("ts")), marks(F.col("rs"))
    chord = F.size("ts") >= 2
    yes = F.lit(True)
    return d.groupBy(page).agg(
        count(pair, F.size(hits)).alias("tp"), count(yes, F.col("extra") + shared).alias("fp"), count(yes, F.col("missed") + shared).alias("fn"),
        count(claimed & (F.col("kind") == 1), size).alias("split"), count(claimed & (F.col("kind") == 2), size).alias("merged"),
        count(pair, wrong_fret).alias("wrong_fret"), count(pair, F.col("moved")).alias("wrong_string"), count(yes, F.col("missed")).alias("missed"), count(yes, F.col("extra")).alias("extra"),
        count(pair, F.size(tech_t)).alias("tech_truth"), count(pair, F.size(tech_r)).alias("tech_read"), count(pair, F.size(F.array_intersect(tech_t, tech_r))).alias("tech_hit"),
        count(chord).alias("chords"), count(chord & pair & (strings(F.col("r")) == strings(F.col("t")))).alias("chords_exact"))
