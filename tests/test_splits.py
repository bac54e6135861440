"""Recursive splitting against a plain recursion."""

import random

import pytest

from skein.operators import splits

FRAMES, RUNS = "user bigint, f int, sig array<int>, k string, lo int", "user bigint, start_f int, end_f int"


def recursion(sigs, lo, hi, change, floor, lag, least):
    """Straight from the definition, one segment after the other."""
    step = min(lag, (hi - lo + 1) // 3)
    pairs = []
    for t in range(lo, hi - step + 1) if step >= 3 else ():
        if t in sigs and t + step in sigs:
            a, b = sigs[t], sigs[t + step]
            pairs.append((sum(abs(p - q) for p, q in zip(a, b)) / max(sum(a), sum(b), floor, 1), -t))
    if pairs and max(pairs)[0] > change:
        cut = -max(pairs)[1] + -(-step // 2)
        if cut - lo >= least and hi - cut + 1 >= least:
            return recursion(sigs, lo, cut - 1, change, floor, lag, least) + recursion(sigs, cut, hi, change, floor, lag, least)
    return [(lo, hi)]


@pytest.mark.parametrize("cell", [4096, 16])
def test_against_recursion(spark, monkeypatch, cell):
    monkeypatch.setattr(splits, "SLICE", cell)
    g = random.Random(cell)
    frames, runs, want = [], [], set()
    for user in range(12):
        n, level, sigs = g.randrange(1, 120), [5, 5, 5], {}
        for t in range(n):
            if g.random() < 0.08:
                level = [g.randrange(20) for _ in range(3)]
            if g.random() > 0.05:  # some frames are missing
                sigs[t] = [max(0, x + g.randrange(-1, 2)) for x in level]
        frames += [(user, t, s, "a", 1) for t, s in sigs.items()]
        edges = sorted({0, n, *(g.randrange(n) for _ in range(3))})
        for lo, hi in zip(edges, edges[1:]):
            hi -= 1 + (g.random() < 0.3 and hi - lo > 2)  # a gap between runs
            runs.append((user, lo, hi))
            want |= {(user, *r) for r in recursion(sigs, lo, hi, 0.3, 12.0, 8, 4)}
    frames += [(None, 0, [1], "a", 1)]
    runs += [(None, 0, 40), (99, 0, 50)]  # no key; no frames
    want.add((99, 0, 50))
    got = splits.refine_runs(spark.createDataFrame(frames, FRAMES).repartition(5), spark.createDataFrame(runs, RUNS), key="user", frame="f", sig="sig", change=0.3, floor=12.0)
    assert {(r.user, r.start_f, r.end_f) for r in got.collect()} == want and got.count() == len(want)
    assert len(want) > len(runs) + 10


def test_one_long_key(spark, monkeypatch):
    """A key with all rows is many slices and splits at each change of its level, some rounds deep."""
    monkeypatch.setattr(splits, "SLICE", 64)
    n, level = 600, lambda t: 10 * (1 + (t // 50) % 2)
    frames = spark.createDataFrame([(1, t, [level(t)], "", 0) for t in range(n)], FRAMES)
    got = splits.refine_runs(frames, spark.createDataFrame([(1, 0, n - 1)], RUNS), key="user", frame="f", sig="sig", change=0.4, floor=1.0)
    assert {(r.start_f, r.end_f) for r in got.collect()} == set(recursion({t: [level(t)] for t in range(n)}, 0, n - 1, 0.4, 1.0, 8, 4))


def test_edges(spark):
    frames, runs = spark.createDataFrame([], FRAMES), spark.createDataFrame([], RUNS)
    ask = lambda f, r, **more: splits.refine_runs(f, r, key="user", frame="f", sig="sig", change=0.3, **more)
    assert ask(frames, runs).columns == ["user", "start_f", "end_f", "n_frames"] and ask(frames, runs).count() == 0
    whole = spark.createDataFrame([(1, 0, 9), (1, 20, 19)], RUNS)
    assert [tuple(r) for r in ask(frames, whole).collect()] == [(1, 0, 9, 10)]
    assert [tuple(r) for r in ask(frames, whole, lag=2).collect()] == [(1, 0, 9, 10)]
    empty = spark.createDataFrame([(1, t, [], "", 0) for t in range(10)], FRAMES)
    assert ask(empty, whole).count() == 1
