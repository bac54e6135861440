"""Training of small dense networks on tables: each step is one job that sums gradients where the rows are.

A task adds up the gradient of its rows; sums are joined by groups of tasks until a few are left, and the
driver takes the step.  So what travels is a few copies of the weights, however many rows there are.
Whole-table gradients need no order of rows and no sampling, and a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.nets import Dense, forward
from skein.sources.stages import stored

#: Sums that are joined into one.
FAN = 16
#: Softmax temperatures that are tried.
TEMPERATURES = np.geomspace(0.25, 4.0, 49)


def tasks_of(rows: DataFrame) -> int:
    """The largest number of a partition of ``rows``."""
    return rows.select(F.spark_partition_id().alias("p")).agg(F.max("p")).first()[0] or 0


def summed(rows: DataFrame, take: Callable[[pa.RecordBatch], np.ndarray], tasks: int | None = None) -> np.ndarray | None:
    """The sum of ``take(batch)``, an array of one size, over all batches of ``rows``; None without rows.

    ``tasks`` is ``tasks_of(rows)``, if that is known.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = take(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total], pa.list_(pa.float64()))], ["part", "value"])

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        total = np.sum([v.values.to_numpy() for v in table.sort_by("part")["value"]], axis=0)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "value": pa.array([total], pa.list_(pa.float64()))})

    kind = "part bigint, value array<double>"
    sums = rows.mapInArrow(part, kind)
    tasks = tasks_of(rows) if tasks is None else tasks
    while tasks >= FAN:
        sums = sums.groupBy(F.floor(F.col("part") / FAN).alias("to")).applyInArrow(joined, kind)
        tasks //= FAN
    left = [np.array(r.value) for r in sums.orderBy("part").collect()]  # FAN rows at most
    return np.sum(left, axis=0) if left else None


@dataclass
class Network:
    """Standardisation of inputs, float layers (weights, bias) with ReLU between them, and a softmax temperature."""

    mean: np.ndarray
    spread: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]
    temperature: float = 1.0
    losses: list[float] = field(default_factory=list)

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.spread

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for layer in self.layers for p in layer])

    def set_flat(self, values: np.ndarray) -> None:
        at, out = 0, []
        for w, b in self.layers:
            n = w.size
            out.append((values[at : at + n].reshape(w.shape), values[at + n : at + n + b.size]))
            at += n + b.size
        self.layers = out

    def logits(self, x: np.ndarray) -> np.ndarray:
        for k, (w, b) in enumerate(self.layers):
            x = x @ w + b
            x = np.maximum(x, 0) if k < len(self.layers) - 1 else x
        return x

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, smooth: float) -> np.ndarray:
        """[weighted cross-entropy, gradient ...] summed over rows, for labels smoothed by ``smooth``."""
        held = [x]
        for k, (w, b) in enumerate(self.layers):
            x = x @ w + b
            x = np.maximum(x, 0) if k < len(self.layers) - 1 else x
            held.append(x)
        top = held[-1] - held[-1].max(axis=1, keepdims=True)
        log_p = top - np.log(np.exp(top).sum(axis=1, keepdims=True))
        target = np.full(log_p.shape, smooth / log_p.shape[1])
        target[np.arange(len(y)), y] += 1 - smooth
        loss = -(weight[:, None] * target * log_p).sum()
        delta = weight[:, None] * (np.exp(log_p) - target)
        out = []
        for k in range(len(self.layers) - 1, -1, -1):
            out += [delta.sum(axis=0), (held[k].T @ delta).ravel()]
            if k:
                delta = (delta @ self.layers[k][0].T) * (held[k] > 0)
        return np.concatenate([[loss], *out[::-1]])

    def quantised(self) -> list[Dense]:
        """Int8 layers that take raw inputs: the standardisation goes into the first."""
        (w, b), *rest = self.layers
        first = w / self.spread[:, None]
        return [Dense.quantised(v, c) for v, c in [(first, b - self.mean @ first), *rest]]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def train(rows: DataFrame, *, features: str, label: str, classes: int, hidden: tuple[int, ...] = (32,), steps: int = 40, rate: float = 0.02, balance: float = 0.6, smooth: float = 0.05, decay: float = 1e-5, seed: int = 1) -> Network | None:
    """A network that tells ``label`` (0 to classes - 1) from ``features``; None without usable rows.

    Rows with a null or foreign label, or null entries, are left out; features have one length.  A class of n rows
    weighs as n ** (1 - balance).  ``steps`` steps of Adam on the gradient of all rows, with a rate that falls as a
    cosine.  The same rows give the same network, up to the order of sums.
    """
    own = stored(rows.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y")).filter(f"y BETWEEN 0 AND {classes - 1} AND x IS NOT NULL AND NOT exists(x, v -> v IS NULL)"))

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column(0))
        return np.concatenate([np.bincount(batch.column(1).to_numpy(), minlength=classes), x.sum(axis=0), (x**2).sum(axis=0)])

    tasks = tasks_of(own)
    told = summed(own, moments, tasks)
    if told is None:
        return None
    count, (total, squares) = told[:classes], told[classes:].reshape(2, -1)
    n = count.sum()
    mean = total / n
    spread = np.sqrt(np.maximum(squares / n - mean**2, 0))
    of_class = np.where(count > 0, np.maximum(count, 1) ** -balance, 0)
    of_class = of_class / (of_class * count).sum()
    g = np.random.default_rng(seed)
    sizes = [len(mean), *hidden, classes]
    net = Network(mean, np.where(spread > 1e-9, spread, 1.0), [(g.standard_normal((a, b)) * np.sqrt(2 / a), np.zeros(b)) for a, b in zip(sizes, sizes[1:])])
    first, second = np.zeros_like(net.flat()), np.zeros_like(net.flat())
    for step in range(1, steps + 1):
        got = summed(own, lambda batch, net=net: net.gradient(net.standard(_matrix(batch.column(0))), batch.column(1).to_numpy(), of_class[batch.column(1).to_numpy()], smooth), tasks)
        net.losses.append(float(got[0]))
        grad = got[1:] + decay * net.flat()
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        now = rate * (0.05 + 0.475 * (1 + np.cos(np.pi * step / steps)))
        net.set_flat(net.flat() - now * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8))
    return net


def fit_temperature(rows: DataFrame, net: Network, *, features: str, label: str) -> float:
    """The temperature of ``TEMPERATURES`` under which the labels of ``rows`` are likeliest, by the int8 layers; 1 without rows."""
    layers, classes = net.quantised(), len(net.layers[-1][1])
    own = rows.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y")).filter(f"y BETWEEN 0 AND {classes - 1} AND x IS NOT NULL AND NOT exists(x, v -> v IS NULL)")

    def losses(batch: pa.RecordBatch) -> np.ndarray:
        x, y = _matrix(batch.column(0)), batch.column(1).to_numpy()
        return np.array([-np.log(np.maximum(forward(layers, x, t)[np.arange(len(y)), y], 1e-12)).sum() for t in TEMPERATURES])

    told = summed(own, losses)
    return 1.0 if told is None else float(TEMPERATURES[told.argmin()])
