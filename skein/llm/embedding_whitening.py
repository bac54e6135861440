"""Embedding whitening by a tall-skinny QR: no covariance is formed.

Entries become whole numbers, so column sums are exact and every row can be centred without rounding
of the mean.  Each partition reduces its centred rows, a batch at a time, to a triangular factor R;
factors are merged in a tree of tasks until one is left.  Its singular values s and right vectors V
are those of all centred rows: the eigenvalues of the covariance are s**2 / n, and a row projected on
V and divided by s / sqrt(n) is whitened.  What reaches the driver is one factor and one list of sums,
whose size depends on the width of the vectors alone.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.merging import merge_tree, reduced
from skein.llm.store import given_back, materialise

#: x = floor(SCALE * c) + SHIFT; components that are returned.
SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries must be smaller than this, so that whole numbers fit a long.
LARGEST = float(1 << 52)
#: An eigenvalue below this share of the first counts as zero, for each dimension.
_NOISE = 1e-15

_KIND = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whole_vectors(rows: DataFrame, vector_col: str, *kept: Column) -> DataFrame:
    """``kept`` columns and ``x``, the vector as whole numbers; rows without a usable vector go."""
    v = F.col(vector_col)
    usable = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    fits = F.when(F.forall(v, lambda c: F.abs(c.cast("double")) < LARGEST), v).otherwise(F.raise_error(F.lit("an entry of a vector is too large to be a whole number")))
    return rows.filter(F.coalesce(usable, F.lit(False))).select(*kept, F.transform(fits, lambda c: F.floor(c.cast("double") * float(SCALE)) + F.lit(SHIFT).cast("long")).alias("x"))


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Whole numbers of a batch, one row a vector."""
    size = np.diff(column.offsets.to_numpy())
    if len(size) and (size != (size[0] if width is None else width)).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _small(x: np.ndarray, times: int) -> bool:
    """Whether ``times`` the largest entry is far below the range of a long."""
    return not x.size or max(int(x.max()), -int(x.min())) * times < 1 << 62


def exact_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """(rows, sum of each dimension) of column ``x``, exactly; a partition sends one row of sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), None if total is None else len(total))
                n += len(x)
                own = (x if _small(x, len(x)) else x.astype(object)).sum(axis=0)
                total = [int(a) for a in own] if total is None else [a + int(b) for a, b in zip(total, own, strict=True)]
        if n:
            sums = [decimal.Decimal(a) for a in total]
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([len(sums)], pa.int32()), pa.array([sums], pa.list_(pa.decimal128(38, 0)))], ["n", "width", "sums"])

    parts = materialise(vectors.select("x").mapInArrow(given_back(run), "n bigint, width int, sums array<decimal(38,0)>"), "sums")
    n, least, most = parts.agg(F.sum("n"), F.min("width"), F.max("width")).first()
    if n is None:
        return 0, []
    if least != most:
        raise ValueError("vectors differ in length")
    sums = parts.select(F.posexplode("sums").alias("dim", "s")).groupBy("dim").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    return n, [int(r.s) for r in sums.orderBy("dim").collect()]


@dataclass
class Centre:
    """The exact mean S / n as quotient and remainder, so that x - S / n is rounded once."""

    n: int
    quotient: np.ndarray
    remainder: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.quotient) - self.remainder / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S)**2; an error if one is no long."""
        off = x - self.quotient
        bound = max(int(np.abs(off).max(initial=0)), 1) * self.n + self.n
        if bound * bound * max(x.shape[1], 1) < 1 << 62:
            return ((self.n * off - self.remainder) ** 2).sum(axis=1)
        exact = ((self.n * off.astype(object) - self.remainder.astype(object)) ** 2).sum(axis=1)
        if max(exact, default=0) >= 1 << 63:
            raise OverflowError("a deviation is too large for a long")
        return exact.astype(np.int64)


def _reduced(vectors: DataFrame, take: Callable) -> DataFrame:
    """``take(value so far or None, batch of x)`` over the batches of each partition."""
    return reduced(vectors.select("x"), lambda value, batch: take(value, _matrix(batch.column(0))))


def factor(vectors: DataFrame, centre: Centre) -> np.ndarray:
    """The triangular factor of all centred rows."""
    width = len(centre.quotient)

    def take(value: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        rows = centre.rows(x)
        return np.linalg.qr(rows if value is None else np.concatenate([value, rows]), mode="r")

    def join(values: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.concatenate([v.reshape(-1, width) for v in values]), mode="r").ravel()

    return merge_tree(_reduced(vectors, take), join, "factors").reshape(-1, width)


@dataclass
class Whitening:
    """``axes`` [width, k] with their ``spread`` (square roots of eigenvalues, 0 where there is no variance) and shares."""

    centre: Centre
    axes: np.ndarray
    spread: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """[rows, k]; nan along axes without variance."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(self.spread > 0, self.centre.rows(x) @ self.axes / self.spread, np.nan)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows of ``vectors`` (column ``x``), or None if there are none."""
    n, sums = exact_sums(vectors)
    if not n or not sums:
        return None
    centre = Centre.of(n, sums)
    _, s, vt = np.linalg.svd(factor(vectors, centre), full_matrices=True)
    s = np.append(s, np.zeros(len(sums) - len(s)))
    value = s**2 / n
    total = value.sum()
    k = min(components, len(sums))
    real = value[:k] > value[0] * _NOISE * len(sums)
    explained = np.where(real, value[:k], 0) / total if total else np.zeros(k)
    made = Whitening(centre, vt[:k].T.copy(), np.where(real, np.sqrt(value[:k]), 0), explained)
    made.identity_error = _identity_error(vectors, made)
    return made


def _identity_error(vectors: DataFrame, made: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over axes with variance."""
    real = np.flatnonzero(made.spread)
    k = len(real)
    if not k:
        return None

    def join(values: list[np.ndarray]) -> np.ndarray:
        """Parts are (rows, means, products of rows less their means): centred before multiplying, merged by their means."""
        n = sum(v[0] for v in values)
        mean = sum(v[0] * v[1 : k + 1] for v in values) / n
        off = [v[1 : k + 1] - mean for v in values]
        product = sum(v[k + 1 :] + v[0] * np.outer(d, d).ravel() for v, d in zip(values, off, strict=True))
        return np.concatenate([[n], mean, product])

    def take(value: np.ndarray | None, x: np.ndarray) -> np.ndarray:
        w = made.whitened(x)[:, real]
        mean = w.mean(axis=0)
        own = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])
        return own if value is None else join([value, own])

    done = merge_tree(_reduced(vectors, take), join, "moments")
    return float(np.abs(done[k + 1 :].reshape(k, k) / done[0] - np.eye(k)).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component (``vec_id, component, n, deviation, whitened, explained, identity_error``).

    Rows whose vector is null or holds null, NaN or infinite entries go; a null id, repeated ids and
    repeated rows stay and count.  Other columns are not read.  No usable vector, or vectors without
    entries: no rows.  A component without variance (one vector, equal vectors, fewer vectors than
    dimensions) has a null ``whitened`` and ``explained`` 0 and is left out of ``identity_error``, which
    is null if no component has variance.  Equal eigenvalues come in any order.  Errors: vectors of
    different lengths, an entry of 2**52 or more, a ``deviation`` beyond a long.
    """
    kind = _KIND.format(rows.schema[id_col].dataType.simpleString())
    vectors = whole_vectors(rows, vector_col, F.col(id_col).alias("vec_id"))
    made = fit(vectors, components)
    if made is None:
        return rows.sparkSession.createDataFrame([], kind)
    n, k = made.centre.n, len(made.spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            w = made.whitened(x)
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n)),
                    pa.array(made.centre.deviations(x)[each]), pa.array(w.ravel(), mask=np.isnan(w.ravel())), pa.array(np.tile(made.explained, len(x))),
                    pa.array([made.identity_error] * len(each), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, kind)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """The whitened vectors of all of ``embeddings``, eight components each."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
