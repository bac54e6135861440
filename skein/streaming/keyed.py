"""Keyed streams: one state class per operator, the same for batches and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.operators.sequential import Suppressor, rate_limit


class RateWindow:
    """A window that opens at a key's first hit and takes ``most`` hits."""

    def __init__(self, window: float, most: int, start: float = float("-inf"), n: int = 0):
        self.window, self.most, self.start, self.n = window, most, start, n

    def push(self, times: list[float]) -> list[bool]:
        out = []
        for t in times:
            if t - self.start >= self.window:
                self.start, self.n = t, 0
            self.n += 1
            out.append(self.n <= self.most)
        return out


def rate_limited_stream(events: DataFrame, *, key: str, id_col: str, seconds: str, window: float, most: int) -> DataFrame:
    """Streaming form of ``sequential.rate_limited``: hits of a key have to arrive in order of time."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = RateWindow(window, most, *(state.get if state.exists else (float("-inf"), 0)))
        for pdf in frames:
            pdf = pdf.sort_values([seconds, id_col])
            yield pd.DataFrame({key: pdf[key], id_col: pdf[id_col], "allowed": own.push(pdf[seconds].astype(float).tolist())})
        state.update((own.start, own.n))

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, allowed boolean"
    return events.select(key, id_col, seconds).groupBy(key).applyInPandasWithState(run, out, "start double, n int", "append", GroupStateTimeout.NoTimeout)


def suppressed_stream(events: DataFrame, *, key: str, id_col: str, seconds: str, message: str, window: float) -> DataFrame:
    """Streaming form of ``sequential.suppress_repeats``: messages of a key have to arrive in order of time."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Suppressor(window, *(state.get if state.exists else (None, float("-inf"))))
        for pdf in frames:
            pdf = pdf.sort_values([seconds, id_col])
            sent = own.push([None if pd.isna(m) else m for m in pdf[message]], pdf[seconds].astype(float).tolist())
            yield pd.DataFrame({key: pdf[key], id_col: pdf[id_col], "sent": sent})
        state.update((own.message, own.at))

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, sent boolean"
    return events.select(key, id_col, seconds, message).groupBy(key).applyInPandasWithState(run, out, f"message {kinds[message]}, at double", "append", GroupStateTimeout.NoTimeout)


def fenced_stream(events: DataFrame, *, key: str, id_col: str, epoch: str) -> DataFrame:
    """Drops rows of an epoch below the highest that the key has had so far."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else -(2**62)
        for pdf in frames:
            pdf = pdf.sort_values(id_col)
            top = pdf[epoch].cummax().clip(lower=seen)
            yield pdf[pdf[epoch] >= top][[key, id_col, epoch]]
            seen = max(seen, int(top.iloc[-1])) if len(top) else seen
        state.update((seen,))

    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    out = ", ".join(f"{c} {kinds[c]}" for c in (key, id_col, epoch))
    return events.select(key, id_col, epoch).groupBy(key).applyInPandasWithState(run, out, "seen bigint", "append", GroupStateTimeout.NoTimeout)


def throttled_levels(samples: DataFrame, *, key: str, at: str, value: str, every: str = "50 milliseconds", late: str = "1 second") -> DataFrame:
    """At most one level message a key and interval: highest peak, root mean square, clipped samples."""
    w = samples.withWatermark(at, late).groupBy(key, F.window(at, every).alias("w"))
    v = F.col(value)
    return w.agg(F.max(F.abs(v)).alias("peak"), F.sqrt(F.avg(v * v)).alias("rms"), F.count_if(F.abs(v) >= 0.999).alias("clipped"), F.count("*").alias("n")).select(key, F.col("w.start").alias("at"), "peak", "rms", "clipped", "n")


__all__ = ["RateWindow", "fenced_stream", "rate_limit", "rate_limited_stream", "suppressed_stream", "throttled_levels"]
