"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.store import materialise


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b bigint); component: the smallest node reached.

    Each round points every node's larger, then smaller, neighbours at the smallest one it knows, so
    chains shorten by halves; it ends when the edges no longer change.  Edges stay tables: neither
    they nor components visit the driver, and each round's table cuts the lineage.  A hot node's
    neighbours are only aggregated to a minimum, never listed.  Loops and repeats do no harm.
    """
    both = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(both, "edges")
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        now = materialise(_small_star(_large_star(now)), "edges")
        new = _mark(now)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("component"))
    return stars.select(F.col("a").alias("node"), "component").unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum((F.xxhash64("b", "a") / 2**20).cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    ends = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ends.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    far = ends.filter("b > a").join(least, "a")
    return far.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = edges.join(least, "a")
    moved = near.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
