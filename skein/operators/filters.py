"""Linear filters over long signals, cut into slices that tasks filter on their own.

A recursive filter's memory is a short vector that every sample maps linearly, so what a slice does to
it is one matrix and one vector.  Slices are filtered as if nothing came before; the vectors they
leave are combined in a tree over slices, which gives each slice the memory it begins with, and the
response to that memory is added.  One key may hold all samples.

``index`` is a whole-number column that counts samples; rows need not come in order.  A sample that is
missing, null or NaN is zero.  Results are for the rows that exist.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.stages import stored

#: Samples of a slice; slices whose memories one task combines.
SLICE, FAN = 1 << 15, 256
#: Columns of a slice laid out as a square: so many steps are taken one after the other.
_STEPS = 128


def high_pass(hz: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a second-order Butterworth high-pass, by the bilinear transform; a[0] is 1."""
    k = np.tan(np.pi * hz / rate)
    scale = 1 / (1 + np.sqrt(2) * k + k * k)
    return scale * np.array([1.0, -2.0, 1.0]), np.array([1.0, 2 * (k * k - 1) * scale, (1 - np.sqrt(2) * k + k * k) * scale])


def low_pass_taps(passed: float, stopped: float, rate: float, decibels: float = 45.0) -> np.ndarray:
    """Symmetric taps of a Kaiser-windowed sinc that sum to 1; their number is odd.  ``decibels`` is over 8.7."""
    n = int(np.ceil((decibels - 7.95) / (14.36 * (stopped - passed) / rate))) | 1
    middle = (passed + stopped) / 2 / rate
    at = np.arange(n) - (n - 1) / 2
    taps = np.sinc(2 * middle * at) * np.kaiser(n, 0.1102 * (decibels - 8.7))
    return taps / taps.sum()


class Recurrence:
    """y = b x + s[0]; s = A s + B x, for filter coefficients b and a (a[0] is 1)."""

    def __init__(self, b, a):
        self.order = max(len(b), len(a)) - 1
        self.b, self.a = (np.concatenate([x, np.zeros(self.order + 1 - len(x))]).astype(float) for x in (b, a))
        if self.a[0] != 1:
            raise ValueError("a[0] must be 1")
        self.step = np.eye(self.order, k=1)
        self.step[:, 0] -= self.a[1:]

    def after(self, samples: int) -> np.ndarray:
        """The matrix by which ``samples`` zeros change the memory."""
        return np.linalg.matrix_power(self.step, samples)

    def echo(self, samples: int) -> np.ndarray:
        """[samples, order]: what each part of a memory adds to the samples that follow."""
        out, row = np.zeros((samples, self.order)), np.eye(self.order)[0]
        for i in range(samples):
            out[i] = row
            row = row @ self.step
        return out

    def run(self, x: np.ndarray, memory: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(y, memory after) of rows that are filtered side by side, a column at a time."""
        y, s = np.empty_like(x), memory.copy()
        for t in range(x.shape[1]):
            y[:, t] = self.b[0] * x[:, t] + s[:, 0]
            s[:, :-1] = s[:, 1:]
            s[:, -1] = 0
            s += x[:, t, None] * self.b[1:] - y[:, t, None] * self.a[1:]
        return y, s

    def slice(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(y, memory after) of a slice that begins without memory: rows side by side, then one after the other."""
        n = len(x)
        square = np.concatenate([np.zeros(-n % _STEPS), x]).reshape(-1, _STEPS)  # zeros before the start do nothing
        y, left = self.run(square, np.zeros((len(square), self.order)))
        over, memory, begin = self.after(_STEPS), np.zeros(self.order), np.empty_like(left)
        for i in range(len(square)):
            begin[i] = memory
            memory = over @ memory + left[i]
        y += begin @ self.echo(_STEPS).T
        return y.ravel()[len(y.ravel()) - n :], memory


def _samples(table: pa.Table, index: str, value: str, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, samples) of a slice that begins at ``first``."""
    at = table[index].to_numpy().astype(np.int64) - first
    x = np.zeros(n)
    x[at] = np.nan_to_num(table[value].cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float), nan=0.0)
    return at, x


def recursive_filter(df: DataFrame, key: str, index: str, value: str, b, a, *, name: str = "filtered") -> DataFrame:
    """``df`` with the filter's output as a column ``name``; rows without an index go.

    Null keys are one signal.  Equal indices of a key: one of the samples counts, and all those rows get its
    output.  A column called ``name`` is replaced.
    """
    rule, size = Recurrence(b, a), SLICE
    own = [c for c in df.columns if c != name]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*own).schema.fields)
    kind = df.schema[key].dataType.simpleString()
    cut = df.select(*own).filter(F.col(index).isNotNull()).withColumn("__slice", F.floor(F.col(index) / size))

    def filtered(keys: tuple, table: pa.Table) -> pa.Table:
        at, x = _samples(table, index, value, keys[1].as_py() * size, size)
        y, memory = rule.slice(x)
        left = pa.array([memory, *[None] * (len(at) - 1)], pa.list_(pa.float64()))
        return table.append_column("__y", pa.array(y[at])).append_column("__left", left)

    parts = stored(cut.groupBy(key, "__slice").applyInArrow(filtered, f"{kinds}, __slice bigint, __y double, __left array<double>"))
    left = parts.filter("__left IS NOT NULL").select(F.col(key).alias("k"), F.col("__slice").alias("c"), F.col("__left").alias("m"))
    begin = memories(left, rule.after(size), kind).toDF("__k", "__c", "__memory")
    joined = parts.join(begin, parts[key].eqNullSafe(begin["__k"]) & (parts["__slice"] == begin["__c"])).select(*parts.columns, "__memory")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        echo = rule.echo(size)
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            at = get(index).to_numpy().astype(np.int64) - get("__slice").to_numpy() * size
            memory = get("__memory").flatten().to_numpy().reshape(-1, rule.order)
            y = get("__y").to_numpy() + (echo[at] * memory).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(get(c) for c in own), pa.array(y)], [*own, name])

    return joined.mapInArrow(finished, f"{kinds}, `{name}` double")


def memories(left: DataFrame, over: np.ndarray, kind: str) -> DataFrame:
    """(k, c, m): the memory that each slice c of a key begins with, from what slices leave by themselves.

    ``over`` is what a whole slice without samples does to a memory; slices may be missing.  FAN
    neighbours become one coarser slice, until a key has few; then memories go down again.
    """
    schema = f"k {kind}, c bigint, m array<double>"

    def rows(key: pa.Scalar, c: np.ndarray, m: list[np.ndarray], of: pa.DataType) -> pa.Table:
        return pa.table({"k": pa.array([key.as_py()] * len(c), of), "c": pa.array(c), "m": pa.array(m, pa.list_(pa.float64()))})

    def walk(table: pa.Table, memory: np.ndarray, first: int, last: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(slices, memory at the begin of each, memory at the end of ``last``), from ``memory`` at the begin of ``first``."""
        table = table.sort_by("c")
        c, own, begin, at = table["c"].to_numpy(), table["m"].to_pylist(), [], first
        for slice_, m in zip(c.tolist(), own, strict=True):
            memory = np.linalg.matrix_power(over, slice_ - at) @ memory
            begin.append(memory)
            memory, at = over @ memory + np.array(m), slice_ + 1
        return c, begin, np.linalg.matrix_power(over, last + 1 - at) @ memory

    none = np.zeros(len(over))
    left = stored(left)
    span = left.groupBy("k").agg((F.max("c") - F.min("c")).alias("span")).agg(F.max("span")).first()[0]
    if span is None or span < FAN:

        def alone(key: tuple, table: pa.Table) -> pa.Table:
            c = table["c"].to_numpy()
            c, begin, _ = walk(table, none, int(c.min()), int(c.max()))
            return rows(key[0], c, begin, table.schema.field("k").type)

        return left.groupBy("k").applyInArrow(alone, schema)
    coarse = F.floor(F.col("c") / FAN)

    def up(key: tuple, table: pa.Table) -> pa.Table:
        p = key[1].as_py()
        return rows(key[0], np.array([p]), [walk(table, none, p * FAN, p * FAN + FAN - 1)[2]], table.schema.field("k").type)

    top = memories(left.groupBy("k", coarse).applyInArrow(up, schema), np.linalg.matrix_power(over, FAN), kind)
    top = top.select(F.col("k").alias("tk"), F.col("c").alias("p"), F.col("m").alias("begin"))
    both = left.withColumn("at", coarse).join(top, F.col("k").eqNullSafe(F.col("tk")) & (F.col("at") == F.col("p"))).select("k", "c", "m", "p", "begin")

    def down(key: tuple, table: pa.Table) -> pa.Table:
        p, begin = key[1].as_py(), np.array(table["begin"][0].as_py())
        c, begin, _ = walk(table, begin, p * FAN, p * FAN + FAN - 1)
        return rows(key[0], c, begin, table.schema.field("k").type)

    return both.groupBy("k", "p").applyInArrow(down, schema)


def tap_filter(df: DataFrame, key: str, index: str, value: str, taps, *, step: int = 1, name: str = "filtered") -> DataFrame:
    """The rows of ``df`` whose index is step - 1 modulo ``step``, with the sum of taps[i] times the sample i before it.

    Slices borrow the last samples of the one before.  Nulls, equal indices and names as in
    ``recursive_filter``.
    """
    taps, size = np.asarray(taps, float), SLICE
    reach = len(taps) - 1
    if reach >= size:
        raise ValueError("more taps than a slice has samples")
    own = [c for c in df.columns if c != name]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*own).schema.fields)
    cell = F.floor(F.col(index) / size)
    lent = F.when(F.pmod(F.col(index), F.lit(size)) >= size - reach, F.array(cell, cell + 1)).otherwise(F.array(cell))
    cut = df.select(*own).filter(F.col(index).isNotNull()).withColumn("__slice", F.explode(lent))

    def filtered(keys: tuple, table: pa.Table) -> pa.Table:
        first = keys[1].as_py() * size
        at, x = _samples(table, index, value, first - reach, size + reach)
        n = at - reach  # places in the slice itself; those before it were borrowed
        kept = np.flatnonzero((n >= 0) & ((first + n) % step == step - 1))
        if not len(kept):
            return table.slice(0, 0).drop_columns("__slice").append_column(name, pa.array([], pa.float64()))
        y = np.lib.stride_tricks.sliding_window_view(x, reach + 1)[n[kept]] @ taps[::-1]
        return table.take(pa.array(kept)).drop_columns("__slice").append_column(name, pa.array(y))

    return cut.groupBy(key, "__slice").applyInArrow(filtered, f"{kinds}, `{name}` double")
