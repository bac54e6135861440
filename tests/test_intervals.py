"""Interval joins against all pairs; plans of sample frames."""

import random

from pyspark.sql import functions as F

from skein.operators import intervals

POINTS, PAGES = "k string, at bigint, x int", "k string, lo bigint, hi bigint, page int"


def test_against_all_pairs(spark):
    g = random.Random(3)
    points = [(g.choice("ab"), g.randrange(-60, 300), i) for i in range(200)] + [("a", 2**61, 1000), ("a", -(2**61), 1001), (None, 5, 1002), ("a", None, 1003), ("a", 7, 1004), ("a", 7, 1004)]
    pages = [(g.choice("ab"), lo, lo + g.choice([0, 1, 2, 7, 64, 100, 1000]), i) for i in range(60) for lo in [g.randrange(-70, 300)]]
    pages += [("a", -(2**61), 2**61, 100), ("b", 5, 4, 101), (None, 0, 9, 102), ("a", None, 9, 103), ("b", 0, None, 104), pages[0]]
    want = sorted((x, p) for k, at, x in points for q, lo, hi, p in pages if k is not None and k == q and None not in (at, lo, hi) and lo <= at <= hi)
    got = intervals.within(spark.createDataFrame(points, POINTS), spark.createDataFrame(pages, PAGES), key="k", at="at", lo="lo", hi="hi")
    assert got.columns == ["k", "at", "x", "lo", "hi", "page"] and sorted((r.x, r.page) for r in got.collect()) == want


def test_cells_are_few_and_tile_the_interval(spark):
    g = random.Random(4)
    rows = [(lo, lo + g.randrange(1 << g.randrange(1, 40))) for lo in (g.randrange(-(1 << 40), 1 << 40) for _ in range(200))]
    for r in spark.createDataFrame(rows, "lo bigint, hi bigint").withColumn("c", intervals.cover(F.col("lo"), F.col("hi"))).collect():
        spans = sorted((c.cell << c.level, (c.cell + 1 << c.level) - 1) for c in r.c)
        assert spans[0][0] == r.lo and spans[-1][1] == r.hi and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) <= 2 * (r.hi - r.lo + 1).bit_length()


def test_no_intervals(spark):
    points, pages = spark.createDataFrame([("a", 1, 1)], POINTS), spark.createDataFrame([], PAGES)
    got = intervals.within(points, pages, key="k", at="at", lo="lo", hi="hi")
    assert got.count() == 0 and got.columns == ["k", "at", "x", "lo", "hi", "page"]


def test_sampled_frames(spark):
    pages = spark.createDataFrame([("a", 3, 3, 1), ("a", 0, 4, 2), ("a", 10, 500, 3), ("a", 5, 4, 4)], PAGES)
    plan = intervals.sample_frames(pages)
    got = {r.page: r.f for r in plan.groupBy("page").agg(F.sort_array(F.collect_list("frame")).alias("f")).collect()}
    assert got[1] == [3] and got[2] == [0, 1, 2, 3, 4] and 4 not in got
    assert len(got[3]) == 11 and got[3][0] == 10 and got[3][-1] == 500 and max(abs(b - a - 49) for a, b in zip(got[3], got[3][1:])) <= 1
    frames = spark.createDataFrame([("a", t, t) for t in range(0, 500)], "k string, frame bigint, v int")
    done = {r.page: (r.n_samples, r.top) for r in intervals.frames_for_pages(frames, plan, key="k", frame="frame", page=["page"], top=F.max("v")).collect()}
    assert done == {1: (1, 3), 2: (5, 4), 3: (10, 451)}
