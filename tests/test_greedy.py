"""Greedy groups in slices against one fold over all rows."""

import random

import numpy as np
import pytest

from skein.operators import greedy

ROWS, RUNS = "page string, y int, x0 int, x1 int, c string", "page string, t bigint, n int, ink double, line int"


def lines_one_by_one(rows, gap=2):
    """Straight from the definition, page by page."""
    out = []
    for page in {r[0] for r in rows}:
        groups = []
        for _, y, x0, x1 in sorted((r for r in rows if r[0] == page), key=lambda r: r[1:]):
            if groups and y - groups[-1][-1][0] <= gap and x0 <= groups[-1][0][2] and x1 >= groups[-1][0][1]:
                groups[-1].append((y, x0, x1))
            else:
                groups.append([(y, x0, x1)])
        for i, g in enumerate(groups):
            size = [b - a + 1 for _, a, b in g]
            k = size.index(max(size))
            out.append((page, i, round(sum(y * s for (y, _, _), s in zip(g, size)) / sum(size), 9), g[k][1], g[k][2], size[k], len(g)))
    return out


@pytest.mark.parametrize("cell", [1 << 15, 50, 7])
def test_lines(spark, monkeypatch, cell):
    monkeypatch.setattr(greedy, "SLICE", cell)
    g = random.Random(cell)
    rows = [("long", y, a, a + g.randrange(60)) for y in range(400) for a in [g.randrange(100)] if g.random() > 0.05]
    rows += [("short", g.randrange(30), a, a + 20) for a in (3, 5, 50, 7)] + [(None, 5, 0, 9), (None, 6, 3, 12)]
    rows += rows[:3]  # repeated rows
    bad = [("long", None, 1, 2, ""), ("long", 3, 9, 2, ""), ("long", 3, None, 2, "")]
    frame = spark.createDataFrame([(*r, "z") for r in rows] + bad, ROWS).repartition(3)
    got = [(*r[:2], round(r[2], 9), *r[3:]) for r in greedy.merge_lines(frame, "page").collect()]
    assert sorted(got, key=repr) == sorted(lines_one_by_one(rows), key=repr)


def test_lines_fold_only_crossing_chains(spark, monkeypatch):
    """Of 300 rows ten apart and one pair across an edge of slices, the pair alone is folded as greedy groups."""
    monkeypatch.setattr(greedy, "SLICE", 100)
    seen, plain = [], greedy.greedy_groups
    monkeypatch.setattr(greedy, "greedy_groups", lambda df, *a, **more: seen.append(df.count()) or plain(df, *a, **more))
    rows = [("a", 10 * i + 5, i % 7, i % 7 + 20) for i in range(300)] + [("b", 99, 0, 9), ("b", 100, 5, 30), ("b", 300, 0, 1)]
    got = [(*r[:2], round(r[2], 9), *r[3:]) for r in greedy.merge_lines(spark.createDataFrame([(*r, "z") for r in rows], ROWS), "page").collect()]
    assert sorted(got) == sorted(lines_one_by_one(rows)) and seen == [2]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_lines_over_small_batches(spark, monkeypatch, n):
    monkeypatch.setattr(greedy, "SLICE", 200)
    g = random.Random(n)
    rows = [(p, y, a, a + g.randrange(40)) for p in ("a", "b", None) for y in range(300) for a in [g.randrange(60)] if g.random() > 0.3]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, str(n))
    try:
        got = [(*r[:2], round(r[2], 9), *r[3:]) for r in greedy.merge_lines(spark.createDataFrame([(*r, "z") for r in rows], ROWS).repartition(3), "page").collect()]
    finally:
        spark.conf.set(size, before)
    assert sorted(got, key=repr) == sorted(lines_one_by_one(rows), key=repr)


def test_a_phase_that_never_settles(spark, monkeypatch):
    """Steps of one and groups of three: a wrong start would stay wrong in all slices, so only true jumps give this."""
    monkeypatch.setattr(greedy, "SLICE", 8)
    frame = spark.createDataFrame([("a", i, i) for i in range(200)], "k string, i int, v int")
    got = greedy.greedy_groups(frame, "k", "i", ["v"], lambda anchor, last, row: row[0] - anchor[0] <= 2)
    assert {r.i: r.group for r in got.collect()} == {i: i // 3 for i in range(200)}


def test_one_group_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(greedy, "SLICE", 16)
    frame = spark.createDataFrame([("a", i, 1) for i in range(0, 600, 2)] + [("b", 1000, 1)], "k string, i int, group int")
    got = greedy.greedy_groups(frame, "k", "i", ["group"], lambda anchor, last, row: anchor[0] == row[0])
    assert {r.group for r in got.collect()} == {0} and got.columns == ["k", "i", "group"] and got.count() == 301


@pytest.mark.parametrize("cell", [1 << 15, 20])
def test_screens_against_the_longest_run(spark, monkeypatch, cell):
    monkeypatch.setattr(greedy, "SLICE", cell)
    g = random.Random(9)
    level, runs = 10.0, []
    for t in range(180):
        level += g.choice([0, 0.3, -0.2, 0.4, 8 if g.random() < 0.1 else 0])
        runs.append(("v", t, g.randrange(1, 9), level, 5))
    want, anchor, group = {}, None, -1
    for _, t, n, ink, _ in runs:
        if anchor is None or abs(anchor[1] - ink) > 1:
            anchor, group = (n, ink), group + 1
        elif n > anchor[0]:
            anchor = (n, ink)
        want[t] = group
    got = greedy.merge_screens(spark.createDataFrame(runs, RUNS), "page", "t", "n", ["ink"], lambda a, b: abs(a[0] - b[0]) <= 1)
    assert {r.t: r.screen for r in got.collect()} == want and 10 < group < 150


def test_edges(spark):
    none = spark.createDataFrame([], ROWS)
    assert greedy.merge_lines(none, "page").count() == 0
    frame = spark.createDataFrame([("a", 1, None), ("a", None, 3), ("a", 2, 4)], "k string, i int, v int")
    got = greedy.greedy_groups(frame, "k", "i", ["v"], lambda anchor, last, row: not np.isnan(row[0]))
    assert {(r.i, r.group) for r in got.collect()} == {(1, 0), (2, 0)}


@pytest.mark.parametrize("cell, slots", [(1 << 15, 1), (40, 1), (40, 3)])
def test_slots(spark, monkeypatch, cell, slots):
    """Against one counter of running jobs, whose refusals hold no slot."""
    monkeypatch.setattr(greedy, "SLICE", cell)
    g = random.Random(cell + slots)
    jobs = [(k, i, t, None if g.random() < 0.005 else t + g.choice([0, 1, 5, 30, 90])) for k in "ab" for i, t in enumerate(sorted(g.randrange(600) for _ in range(200)))]
    want = {}
    for key in "ab":
        running = []
        for _, i, t, until in sorted((j for j in jobs if j[0] == key), key=lambda j: (j[2], j[1])):
            running = [u for u in running if u > t]
            want[key, i] = len(running) < slots
            if want[key, i]:
                running.append(float("inf") if until is None else until)
    got = greedy.admitted(spark.createDataFrame(jobs, "k string, i int, start int, until int"), "k", "start", "until", slots=slots, ties=("i",)).collect()
    assert {(r.k, r.i): r.admitted for r in got} == want and 20 < sum(want.values()) < 390
