"""Waves of leaders against one pass over each key."""

import random

import numpy as np
import pytest

from skein.operators import leaders

SCHEMA = "k string, i int, v array<float>, leader int, o string"


def one_pass(rows, alike):
    out, heads = {}, {}
    for k, i, v in sorted((r for r in rows if None not in r), key=lambda r: r[:2]):
        own = heads.setdefault(k, [])
        lead = next((j for j, w in own if alike(v, w)), i)
        out[k, i] = lead
        if lead == i:
            own.append((i, v))
    return out


def cloud(seed, n, centres):
    g = random.Random(seed)
    at = [[g.gauss(0, 1) for _ in range(4)] for _ in range(centres)]
    rows = []
    for i in range(n):
        v = np.array(g.choice(at)) + [g.gauss(0, 0.25) for _ in range(4)]
        rows.append(("ab"[g.random() < 0.1], i, np.float32(v / np.linalg.norm(v)).tolist()))
    return rows


@pytest.mark.parametrize("cell, wave, centres", [(1024, 4096, 12), (20, 50, 12), (20, 30, 200)])
def test_against_one_pass(spark, monkeypatch, cell, wave, centres):
    """One key has nine tenths of all rows; leaders fill several waves."""
    monkeypatch.setattr(leaders, "SLICE", cell)
    monkeypatch.setattr(leaders, "WAVE", wave)
    rows = cloud(centres + cell, 400, centres)
    frame = [(*r, 0, "x") for r in rows] + [(None, 5, [1.0] * 4, 0, "x"), ("a", None, [1.0] * 4, 0, "x"), ("a", 999, None, 0, "x"), ("a", 998, [None] * 4, 0, "x")]
    got = leaders.first_leaders(spark.createDataFrame(frame, SCHEMA), key="k", order="i", fields="v", alike=leaders.dots_at_least(0.9)).collect()
    want = one_pass(rows, lambda a, b: float(np.dot(np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float))) >= 0.9)
    assert {(r.k, r.i): r.leader for r in got} == want and len(got) == len(want) and len(set(want.values())) > 5


def test_rows_alike_and_none(spark):
    same = spark.createDataFrame([("a", i, [1.0], 0, "") for i in range(50)], SCHEMA)
    ask = lambda df: leaders.first_leaders(df, key="k", order="i", fields="v", alike=lambda a, b: np.abs(a[:, :1] - b[:, 0]) <= 0.5)
    assert {r.leader for r in ask(same).collect()} == {0} and ask(same.limit(0)).collect() == []
