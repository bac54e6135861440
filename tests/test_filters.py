"""Sliced filters against sample-by-sample ones."""

import random

import numpy as np
import pytest

from skein.operators import filters

SCHEMA = "k string, i bigint, x double, y int, c string"


def one_by_one(x, b, a):
    y = []
    for n in range(len(x)):
        past = sum(b[j] * x[n - j] for j in range(len(b)) if n >= j) - sum(a[j] * y[n - j] for j in range(1, len(a)) if n >= j)
        y.append(past)
    return y


@pytest.mark.parametrize("size, fan", [(1 << 15, 256), (64, 4), (100, 2)])
def test_recursive_filter_is_the_sequential_one(spark, monkeypatch, size, fan):
    """One key holds nearly all rows; slices are combined in up to seven levels."""
    monkeypatch.setattr(filters, "SLICE", size)
    monkeypatch.setattr(filters, "FAN", fan)
    g = random.Random(size)
    b, a = filters.high_pass(0.004, 1.0)  # long memory: many slices matter to each sample
    rows, want = [], {}
    for key, n in (("a", 6000), ("b", 3), (None, 150)):
        x = [g.uniform(-1, 1) + 3 for _ in range(n)]
        for i in range(n):
            if i > 2 and (g.random() < 0.1 or 1000 < i < 2500):  # missing samples, whole slices of them
                x[i] = 0.0
            else:
                bad = g.random()
                rows.append((key, i, None if bad < 0.02 else float("nan") if bad < 0.04 else x[i], 7, "z"))
                x[i] = 0.0 if bad < 0.04 else x[i]
        want |= {(key, i): y for i, y in enumerate(one_by_one(x, b, a))}
    g.shuffle(rows)
    got = filters.recursive_filter(spark.createDataFrame([*rows, ("a", None, 1.0, 7, "z")], SCHEMA).repartition(4), "k", "i", "x", b, a, name="y").collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["k", "i", "x", "c", "y"]
    assert max(abs(r.y - want[r.k, r.i]) for r in got) < 1e-9


def test_higher_orders_and_negative_indices(spark, monkeypatch):
    monkeypatch.setattr(filters, "SLICE", 32)
    monkeypatch.setattr(filters, "FAN", 3)
    b, a = [0.2, 0.1, 0.3, -0.1], [1.0, -0.5, 0.2, 0.1, -0.05]
    x = np.random.default_rng(1).standard_normal(700)
    rows = spark.createDataFrame([("a", i - 333, float(v), 0, "") for i, v in enumerate(x)], SCHEMA)
    got = {r.i: r.out for r in filters.recursive_filter(rows, "k", "i", "x", b, a, name="out").collect()}
    assert max(abs(got[i - 333] - y) for i, y in enumerate(one_by_one(x, b, a))) < 1e-9


@pytest.mark.parametrize("size", [1 << 15, 40])
def test_taps(spark, monkeypatch, size):
    monkeypatch.setattr(filters, "SLICE", size)
    taps = filters.low_pass_taps(0.1, 0.2, 1.0)
    assert len(taps) % 2 == 1 and len(taps) < 40 and taps.sum() == pytest.approx(1) and np.allclose(taps, taps[::-1])
    x = np.random.default_rng(2).standard_normal(333)
    rows = spark.createDataFrame([("a", i, float(v), 0, "") for i, v in enumerate(x) if i % 10 != 4] + [("b", 2, 1.0, 0, ""), (None, 3, 2.0, 0, "")], SCHEMA)
    kept = np.where(np.arange(333) % 10 != 4, x, 0)
    for step in (1, 4):
        got = {(r.k, r.i): r.y for r in filters.tap_filter(rows, "k", "i", "x", taps, step=step, name="y").collect()}
        want = {("a", i): y for i, y in enumerate(np.convolve(kept, taps)[:333]) if i % 10 != 4 and i % step == step - 1} | {(None, 3): 2 * taps[0]} | ({("b", 2): taps[0]} if step == 1 else {})
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12
    with pytest.raises(ValueError):
        filters.tap_filter(rows, "k", "i", "x", np.ones(filters.SLICE + 1))


def test_responses():
    """The high-pass stops a constant and halves power at its edge; the taps pass low and stop high tones."""
    b, a = filters.high_pass(0.05, 1.0)
    gain = lambda num, den, f: abs(np.polyval(num[::-1], np.exp(-2j * np.pi * f)) / np.polyval(den[::-1], np.exp(-2j * np.pi * f)))
    assert gain(b, a, 0) < 1e-12 and gain(b, a, 0.05) == pytest.approx(np.sqrt(0.5)) and gain(b, a, 0.5) == pytest.approx(1)
    taps = filters.low_pass_taps(0.05, 0.1, 1.0)
    assert abs(gain(taps, np.ones(1), 0.04) - 1) < 0.01 and max(gain(taps, np.ones(1), f) for f in np.linspace(0.1, 0.5, 200)) < 0.008


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert filters.recursive_filter(none, "k", "i", "x", [1.0], [1.0, 0.5]).count() == 0 and filters.tap_filter(none, "k", "i", "x", [1.0]).count() == 0
