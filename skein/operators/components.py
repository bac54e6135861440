"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.stages import stored


def connected(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b of one orderable type); root: the least node reached.

    A round ties the larger neighbours of each node, and then the node with its smaller ones, to the
    least that it knows.  Chains shorten by halves, and a node with very many neighbours only takes a
    minimum of them.  It ends when the edges stay the same.  Loops, repeats and nulls do no harm.
    """
    now = stored(edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    sign = _sign(now)
    for _ in range(rounds):
        if not sign[0]:
            break
        now = stored(_inward(_outward(now)))
        before, sign = sign, _sign(now)
        if sign == before:
            break
    else:
        raise RuntimeError("components did not come to rest")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def _sign(edges: DataFrame) -> tuple:
    """Number and two checksums of the edges."""
    half = lambda n: F.sum(F.shiftright(F.xxhash64("b", "a"), n).cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), half(8)).first())


def _outward(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours, tied to the least of the node and its neighbours."""
    ends = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ends.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return ends.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _inward(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours, tied to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()

