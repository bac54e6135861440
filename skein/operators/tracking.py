"""Levels that follow a signal: a noise floor by minimum statistics and a slowly adapting drift."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class MinimumFloor:
    """Floor of a level: ``bias`` times the least smoothed value of the last ``parts`` parts of ``part`` frames.

    It falls at once; after ``warm`` frames it rises by the factor ``rise`` a frame at most.
    """

    def __init__(self, *, smooth: float = 0.9, bias: float = 1.7, parts: int = 8, part: int = 20, warm: int = 40, rise: float = 1.05):
        self.smooth, self.bias, self.part, self.warm, self.rise = smooth, bias, part, warm, rise
        self.level, self.least, self.floor, self.n = None, float("inf"), 0.0, 0
        self.done: deque[float] = deque(maxlen=parts)

    def push(self, x: float) -> float:
        self.level = x if self.level is None else self.smooth * self.level + (1 - self.smooth) * x
        self.least = min(self.least, self.level)
        if (self.n + 1) % self.part == 0:
            self.done.append(self.least)
            self.least = float("inf")
        raw = self.bias * min([self.least, *self.done])
        self.floor = raw if self.n < self.warm else min(raw, self.floor * self.rise)
        self.n += 1
        return self.floor


class Drift:
    """Running offset in cents that moves by ``alpha`` towards each reading, within ``most``; what moved over ``step`` is told."""

    def __init__(self, *, alpha: float = 0.1, most: float = 60.0, step: float = 3.0):
        self.alpha, self.most, self.step = alpha, most, step
        self.cents, self.told = 0.0, 0.0

    def push(self, d: float) -> tuple[float, bool]:
        self.cents = max(-self.most, min(self.most, self.cents + self.alpha * (d - self.cents)))
        tell = abs(self.cents - self.told) > self.step
        if tell:
            self.told = self.cents
        return self.cents, tell


def _followed(df: DataFrame, key: str, order: str, value: str, make: Callable, names: list[tuple[str, str]]) -> DataFrame:
    """One state a key, fed in order; rows without a key or value are left out.

    Rows stream through a task in order of key, so a task holds one state and never a key's rows.
    """

    def run(frames):
        last, own = object(), None
        for pdf in frames:
            out = []
            for k, x in zip(pdf[key].tolist(), pdf[value].tolist(), strict=True):
                if k != last:
                    last, own = k, make()
                got = own.push(x)
                out.append(got if isinstance(got, tuple) else (got,))
            yield pd.concat([pdf[[key, order]], pd.DataFrame(out, columns=[n for n, _ in names], index=pdf.index)], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.select(key, order, F.col(value).cast("double").alias(value)).filter(F.col(key).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))
    schema = ", ".join([f"{key} {kinds[key]}", f"{order} {kinds[order]}", *[f"{n} {t}" for n, t in names]])
    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


def noise_floor(df: DataFrame, *, key: str, order: str, value: str, **settings) -> DataFrame:
    """(key, order, floor) by ``MinimumFloor``; ``order`` is unique in a key."""
    return _followed(df, key, order, value, lambda: MinimumFloor(**settings), [("floor", "double")])


def drift(df: DataFrame, *, key: str, order: str, value: str, tol: float = 35.0, **settings) -> DataFrame:
    """(key, order, cents, told) by ``Drift``; readings further than ``tol`` off are left out."""
    near = df.filter(F.abs(value) <= tol)
    return _followed(near, key, order, value, lambda: Drift(**settings), [("cents", "double"), ("told", "boolean")])
