"""Joins of near rows against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import joins

SIGNED = "id bigint, lang string, cell bigint, x int, y int, z int"


def _near(spark, rows, below):
    df = spark.createDataFrame(rows, SIGNED).repartition(3)
    return joins.signature_pairs(df, id_col="id", counts=[F.col(c) for c in "xyz"], bucket=["lang", "cell"], below=below)


def all_pairs(rows, below):
    out = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1:3] == b[1:3] and None not in a + b:
                d = sum(abs(p - q) for p, q in zip(a[3:], b[3:])) / max(sum(a[3:]), sum(b[3:]), 1)
                if d < below:
                    out[a[1], a[2], a[0], b[0]] = d
    return out


@pytest.mark.parametrize("below", [0.02, 0.1, 0.5, 0.95])
def test_signatures(spark, below):
    g = random.Random(below)
    rows = []
    for lang in ("en", "de", None):
        for top in (1, 3, 60, 900):
            seen = [g.randrange(top + 1) for _ in range(3)]
            for _ in range(25):
                if g.random() < 0.2:
                    seen = [g.randrange(top + 1) for _ in range(3)]
                rows.append((len(rows), lang, g.choice([1, 1, 2]), *[max(0, c + g.randrange(-9, 10) * top // 300) for c in seen]))
    rows += [(900, "en", None, 1, 1, 1), (901, "en", 1, None, 1, 1), (902, "en", 1, 0, 0, 0), (903, "en", 1, 0, 0, 0)]
    # one part in fifty exactly, and a little less
    rows += [(910, "en", 7, 500, 500, 0), (911, "en", 7, 490, 490, 0), (912, "en", 7, 490, 491, 0), (913, "en", 7, 480, 520, 1)]
    got = _near(spark, rows, below).collect()
    want = all_pairs(rows, below)
    assert {(r.lang, r.cell, r.a, r.b): r.distance for r in got} == want and len(got) == len(want) and want


def test_signatures_of_one_bucket(spark):
    """A bucket with all rows: 800 million pairs, of which only those in neighbouring cells meet."""
    rows = spark.range(40000).select("id", F.lit("en").alias("lang"), F.lit(1).alias("cell"), *[(F.hash("id", F.lit(i)) % 3000 + 3000).alias(c) for i, c in enumerate("xyz")])
    rows = rows.union(rows.filter("id < 5").withColumn("id", F.col("id") + 100000))
    got = joins.signature_pairs(rows, id_col="id", counts=[F.col(c) for c in "xyz"], bucket=["lang", "cell"], below=0.002)
    assert {(i, i + 100000) for i in range(5)} <= {(r.a, r.b) for r in got.collect()}


VECTORS = "id bigint, label int, v array<float>"


@pytest.mark.parametrize("block, tile", [(16384, 1024), (16, 5)])
def test_similar_pairs(spark, monkeypatch, block, tile):
    monkeypatch.setattr(joins, "BLOCK", block)
    monkeypatch.setattr(joins, "TILE", tile)
    g = random.Random(block)
    rows = [(i, g.choice([0, 0, 1, None]), [g.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)]) for i in range(150)]
    nan, inf = float("nan"), float("inf")
    rows += [(200, 0, [nan] * 6), (201, 0, [inf] + [0.5] * 5), (202, 0, [-inf] + [0.5] * 5), (203, 0, None), (204, 0, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(205, 0, [1.0] * 5), (206, 0, [1.0] * 5), (3, 0, [0.5] * 6), (3, 0, [0.5] * 6), (None, 0, [0.5] * 6), (207, 1, []), (208, 1, [])]
    want = []
    for a in rows:
        for b in rows:
            if None in (a[0], b[0], a[1], a[2], b[2]) or a[0] >= b[0] or a[1] != b[1] or len(a[2]) != len(b[2]) or None in a[2] + b[2]:
                continue
            dot = 0.0
            for p, q in zip(a[2], b[2]):
                dot += p * q
            if not dot < 0.5:  # the quarters are exact, so many products are the threshold itself
                want.append((a[1], a[0], b[0], repr(dot)))
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = joins.similar_pairs(df, id_col="id", vector="v", bucket=["label"], threshold=0.5)
    assert got.columns == ["label", "a", "b", "dot"]
    assert sorted((r.label, r.a, r.b, repr(r.dot)) for r in got.collect()) == sorted(want) and len(want) > 100
    assert joins.similar_pairs(df.filter("false"), id_col="id", vector="v", bucket=["label"], threshold=0.5).count() == 0


def test_similar_pairs_of_one_bucket(spark):
    """A bucket with all rows, in blocks: 200 million products of 32 numbers, some seconds of matrix products."""
    n = 20000
    v = F.array(*[(F.hash("id", F.lit(i)) % 1000 / 10000).cast("float") for i in range(32)])
    rows = spark.range(n).select("id", F.lit(1).alias("label"), v.alias("v"))
    twins = spark.range(3).select((F.col("id") + n).alias("id"), F.lit(1).alias("label"), F.array(*[(F.hash("id", F.lit(i)) % 1000 / 10000).cast("float") for i in range(32)]).alias("v"))
    got = joins.similar_pairs(rows.union(twins), id_col="id", vector="v", bucket=["label"], threshold=0.08).collect()
    assert {(i, i + n) for i in range(3)} <= {(r.a, r.b) for r in got} and all(r.dot >= 0.08 for r in got)
