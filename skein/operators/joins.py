"""Join-shaped operators: tolerance joins, precedence, upserts, set differences, nearest matches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.stages import stored


def nearest_within(left: DataFrame, right: DataFrame, *, key: str, left_id: str, right_id: str, left_at: str, right_at: str, tol: float) -> DataFrame:
    """Each left row's nearest right row of its key within ``tol``; the smaller right id of equals.

    (key, left_id, right_id, d); left rows without a partner are absent.  The band becomes an equi-join
    on (key, bucket of width tol): a right row visits three buckets, so a hot key is spread over its
    buckets and no pair beyond two bucket widths is ever formed.
    """
    l = left.select(F.col(key), F.col(left_id), F.col(left_at).cast("double").alias("__l")).withColumn("__b", F.floor(F.col("__l") / tol))
    r = right.select(F.col(key), F.col(right_id), F.col(right_at).cast("double").alias("__r"))
    r = r.withColumn("__b", F.explode(F.array(*[F.floor(F.col("__r") / tol) + d for d in (-1, 0, 1)])))
    met = l.join(r, [key, "__b"]).withColumn("d", F.abs(F.col("__l") - F.col("__r"))).filter(F.col("d") <= tol)
    best = met.groupBy(key, left_id).agg(F.min(F.struct("d", right_id)).alias("m"))
    return best.select(key, left_id, F.col(f"m.{right_id}").alias(right_id), F.col("m.d").alias("d"))


def latest(df: DataFrame, key, order) -> DataFrame:
    """The row of each key with the highest order; by an aggregate, so hot keys combine map-side."""
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*orders)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, "__row.*")


def upsert(stored: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Patch rows win where they have the field; ``has_<field>`` tells an absent field from a null.

    New keys are added; fields a new key does not have are null.
    """
    p = patch.select(F.col(key).alias("__key"), *[F.col(f).alias(f"__{f}") for f in fields], *[F.col(f"has_{f}") for f in fields])
    both = stored.join(p, stored[key] == p["__key"], "full")
    merged = [F.when(F.col(f"has_{f}"), F.col(f"__{f}")).otherwise(F.col(f)).alias(f) for f in fields]
    return both.select(F.coalesce(F.col(key), F.col("__key")).alias(key), *merged)


def prefer(base: DataFrame, over: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """Base rows with fields of the first source that has the key: (field -> value from ``over``)."""
    o = over.select(F.col(key).alias("__key"), *[c.alias(f"__{f}") for f, c in fields.items()])
    joined = base.join(o, base[key] == o["__key"], "left")
    kept = [c for c in base.columns if c not in fields]
    return joined.select(*kept, *[F.coalesce(F.col(f"__{f}"), F.col(f)).alias(f) for f in fields], F.col("__key").isNotNull().alias("corrected"))


def delete(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed; repeats and unknown keys in the list do nothing."""
    return df.join(gone.select(key), key, "left_anti")


#: Rows of a block of ``similar_pairs``, and of the tiles within it whose products are taken at once.
BLOCK, TILE = 16384, 1024


def similar_pairs(df: DataFrame, *, id_col: str, vector: str, bucket: list[str], threshold: float) -> DataFrame:
    """Pairs (a < b) of one bucket with a dot product of at least ``threshold``: (bucket, a, b, dot).

    All pairs of a bucket are compared, so time grows with its square; memory does not.  Buckets are cut into
    blocks of about ``BLOCK`` rows by their ids' hashes; each two blocks are one group, with tiles of matrix products.  Pairs
    that may reach the threshold are summed again in the vector's own order in double precision.
    Vectors that are null, hold a null or differ in length have no product; NaN counts as above all numbers.
    """
    ids = df.schema[id_col].dataType
    # floats are shuffled as they are, and widened in the tasks
    numbers = F.col(vector) if df.schema[vector].dataType.simpleString() == "array<float>" else F.col(vector).cast("array<double>")
    rows = df.select(*bucket, F.col(id_col).alias("__id"), numbers.alias("__v"))
    rows = rows.dropna(subset=[*bucket, "__id", "__v"]).filter(~F.exists("__v", F.isnull)).withColumn("__n", F.size("__v"))
    rows = stored(rows)
    group = [*bucket, "__n"]
    sizes = rows.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK).alias("__blocks"))
    cut = rows.join(sizes, group).withColumn("__own", F.pmod(F.xxhash64("__id"), "__blocks"))
    # block i meets all others: the group of two blocks is named by the smaller and the larger
    meets = cut.withColumn("__with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1)))
    meets = meets.withColumns({"__lo": F.least("__own", "__with"), "__hi": F.greatest("__own", "__with")})
    meets = meets.select(*group, "__lo", "__hi", "__own", "__id", "__v")
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in bucket)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).select(["__own", "__id", "__v"]).combine_chunks()
        n, lo, hi = (k.as_py() for k in key[-3:])
        own = table["__own"].to_numpy()
        vectors = table["__v"].combine_chunks().flatten().to_numpy().astype(float).reshape(len(own), n)
        one = np.flatnonzero(own == lo)
        other = one if lo == hi else np.flatnonzero(own == hi)
        names = table["__id"].combine_chunks()
        for left, right, dot in _reaching(vectors, one, other, threshold):
            a, b = names.take(pa.array(left)), names.take(pa.array(right))
            swap = pc.greater(a, b)
            arrays = [pc.if_else(swap, b, a), pc.if_else(swap, a, b), pa.array(dot)]
            kept = pa.RecordBatch.from_arrays([*[pa.repeat(k, len(dot)) for k in key[: len(bucket)]], *arrays], [*bucket, "a", "b", "dot"])
            yield kept.filter(pc.not_equal(a, b))

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    named = f"a {ids.simpleString()}, b {ids.simpleString()}, dot double"
    return meets.groupBy(*group, "__lo", "__hi").applyInArrow(run, f"{kinds}, {named}" if bucket else named)


def _reaching(vectors: np.ndarray, one: np.ndarray, other: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, rows, dot products) of pairs from two lists of rows, or from one list, each pair once."""
    with np.errstate(all="ignore"):
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        plain = np.isfinite(norms)
        for i in range(0, len(one), TILE):
            left = one[i : i + TILE]
            for k in range(i if one is other else 0, len(other), TILE):
                right = other[k : k + TILE]
                # by how much the order of a sum may change it
                slack = (vectors.shape[1] + 8) * 2.0**-50 * norms[left][plain[left]].max(initial=0) * norms[right][plain[right]].max(initial=0)
                may = ~(vectors[left] @ vectors[right].T < threshold - slack)
                may[~plain[left]] = True
                may[:, ~plain[right]] = True
                if one is other and i == k:
                    may = np.triu(may, 1)
                p, q = np.nonzero(may)
                for at in range(0, len(p), 1 << 16):
                    a, b = left[p[at : at + (1 << 16)]], right[q[at : at + (1 << 16)]]
                    dot = np.zeros(len(a))
                    for d in range(vectors.shape[1]):
                        dot += vectors[a, d] * vectors[b, d]
                    kept = ~(dot < threshold)
                    if kept.any():
                        yield a[kept], b[kept], dot[kept]


#: Cells that follow a cell or are it; of two neighbouring cells each one is ahead of the other once.
_AHEAD, _AROUND = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)], [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)]


def signature_pairs(df: DataFrame, *, id_col: str, counts: list[Column], bucket: list[str], below: float) -> DataFrame:
    """Pairs (a < b) of one bucket whose counts differ by less than ``below`` (under 1): (bucket, a, b, distance).

    The distance is L1 over the larger sum, 1 at least; counts are whole numbers from 0.  Of a pair, the smaller sum is over
    1 - ``below`` of the larger, so their logarithms fall into one level or two adjacent ones.  A level bounds
    L1, and with it the difference of two sums of counts with signs: these are the coordinates of cells
    as wide as that bound.  A row meets its cell and those ahead in its own level, and all cells around its
    place in the next level; each pair meets once, and rows far apart don't.
    """
    g = [f"__g{i}" for i in range(len(counts))]
    rows = df.select(*bucket, F.col(id_col).alias("__id"), *[c.cast("long").alias(n) for c, n in zip(counts, g)])
    rows = stored(rows).dropna(subset=[*bucket, *g])  # after the counts, which a filter would take twice
    signed = lambda plus: sum((F.col(n) if plus(i) else -F.col(n) for i, n in enumerate(g)), F.lit(0).cast("long"))
    # a twentieth wider than needed, so that no rounding parts a pair
    step = -1.05 * math.log1p(-below)
    level = F.floor(F.log(F.greatest(F.col("__m"), F.lit(1))) / step)
    width = lambda at: F.greatest(F.lit(1.0), F.exp((at + 1) * step) * (below * 1.001))
    place = lambda at: [F.floor(F.col(c) / width(at)) for c in ("__p", "__q")]
    rows = rows.withColumns({"__m": signed(lambda i: True), "__p": signed(lambda i: 2 * i < len(g)), "__q": signed(lambda i: i % 2 == 0)}).withColumn("__l", level)

    def met(at: Column, offsets: list[tuple[int, int]]) -> list[Column]:
        x, y = place(at)
        return [F.struct(at.alias("l"), (x + i).alias("x"), (y + j).alias("y"), F.lit(i == j == 0 and offsets is _AHEAD).alias("own")) for i, j in offsets]

    cell = ["__l", "__x", "__y"]
    x, y = place(F.col("__l"))
    home = rows.select(*bucket, "__l", x.alias("__x"), y.alias("__y"), F.col("__id").alias("__b"), F.col("__m").alias("__mb"), *[F.col(n).alias(f"{n}b") for n in g])
    asks = rows.withColumn("__c", F.explode(F.array(*met(F.col("__l"), _AHEAD), *met(F.col("__l") + 1, _AROUND))))
    asks = asks.select(*bucket, *[F.col(f"__c.{c[2:]}").alias(c) for c in cell], F.col("__c.own").alias("__own"), F.col("__id").alias("__a"), F.col("__m").alias("__ma"), *g)
    dist = sum((F.abs(F.col(n) - F.col(f"{n}b")) for n in g), F.lit(0).cast("long")) / F.greatest("__ma", "__mb", F.lit(1))
    near = (F.col("__a") < F.col("__b")) | (~F.col("__own") & (F.col("__a") > F.col("__b")))
    pairs = asks.join(home, [*bucket, *cell]).filter(near & (dist < below))
    return pairs.select(*bucket, F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b"), dist.alias("distance"))


def content_classes(df: DataFrame, content: str, id_col: str) -> DataFrame:
    """(sha1, first id, rows) of each distinct content; nulls are left out."""
    return df.filter(F.col(content).isNotNull()).groupBy(F.sha1(F.col(content).cast("binary")).alias("sha1")).agg(F.min(id_col).alias("first_id"), F.count("*").alias("n"))


def equal_or_named(left: DataFrame, right: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """Left rows with the right side's value by the first key, else by the second; others are dropped."""
    one = right.select(F.col(first).alias("__f"), F.col(value).alias("__v1"))
    two = right.select(F.col(second).alias("__s"), F.col(value).alias("__v2"))
    both = left.join(one, left[first] == one["__f"], "left").join(two, left[second] == two["__s"], "left")
    return both.withColumn(value, F.coalesce("__v1", "__v2")).filter(F.col(value).isNotNull()).drop("__f", "__s", "__v1", "__v2")


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of a total order, with their rank; a top-k heap per task, not a full sort."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def not_stamped(df: DataFrame, stamps: DataFrame, *, key: str, start: str, end: str, tol: float = 1.0) -> DataFrame:
    """Rows whose start and end are not both within ``tol`` of a stamp of their key.

    A band anti-join on (key, bucket of start): a stamp visits three buckets of twice the tolerance.
    """
    cell = lambda c: F.floor(c / (2 * tol))
    s = stamps.select(F.col(key).alias("__key"), F.col(start).alias("__s"), F.col(end).alias("__e"), F.explode(F.array(*[cell(F.col(start)) + d for d in (-1, 0, 1)])).alias("__b")).distinct()
    near = (df[key] == F.col("__key")) & (cell(df[start]) == F.col("__b")) & (F.abs(df[start] - F.col("__s")) <= tol) & (F.abs(df[end] - F.col("__e")) <= tol)
    return df.join(s, near, "left_anti")
