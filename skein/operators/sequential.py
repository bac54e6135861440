"""Operators whose next step depends on the last: one numpy pass over each key, as grouped maps."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.alignment import filled

BAR, GAP = "|", 0.6


def leaders(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Leader clustering in row order: a row joins the first leader it is similar enough to, else it leads.

    Not a transitive closure: rows are compared to leaders only, so clusters do not drift.
    """
    out = np.empty(len(vectors), np.int64)
    heads: list[int] = []
    for i, v in enumerate(vectors):
        if heads and (hit := np.flatnonzero(vectors[heads] @ v >= threshold)).size:
            out[i] = heads[int(hit[0])]
        else:
            out[i] = i
            heads.append(i)
    return out


def leader_clusters(df: DataFrame, *, key: str, id_col: str, vector: str, threshold: float) -> DataFrame:
    """(key, id, leader): rows of each key in order of id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col)
        ids = pdf[id_col].to_numpy()
        lead = leaders(np.array(pdf[vector].tolist(), float), threshold)
        return pd.DataFrame({key: pdf[key].to_numpy(), id_col: ids, "leader": ids[lead]})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(key, id_col, vector).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, leader {kinds[id_col]}")


def event_cost(a: frozenset, b: frozenset) -> float:
    """Cost of pairing two events; a bar (the set of ``BAR``) pairs with bars for free and with nothing else."""
    if BAR in a or BAR in b:
        return 0.0 if BAR in a and BAR in b else 1.0
    return 1 - len(a & b) / max(1, len(a), len(b))


def event_costs(a: list[frozenset], b: list[frozenset]) -> np.ndarray:
    """[a, b] of ``event_cost``, by counts of shared notes."""
    names = {x: k for k, x in enumerate(set().union(*a, *b))}
    sides = []
    for events in (a, b):
        side = np.zeros((len(events), max(len(names), 1)), np.float32)
        rows = np.repeat(np.arange(len(events)), list(map(len, events)))
        side[rows, [names[x] for e in events for x in e]] = 1
        sides.append(side)
    size = [x.sum(axis=1) for x in sides]
    cost = 1 - (sides[0] @ sides[1].T).astype(float) / np.maximum(1, np.maximum(size[0][:, None], size[1][None]))
    bar = [np.array([BAR in e for e in events], bool) for events in (a, b)]
    either, both = bar[0][:, None] | bar[1][None], bar[0][:, None] & bar[1][None]
    return np.where(both, 0.0, np.where(either, 1.0, cost))


def align(a: list[frozenset], b: list[frozenset], gap: float = GAP) -> list[tuple[int | None, int | None]]:
    """Cheapest in-order pairing of two event lists; pairing is preferred to gaps, gaps in b to gaps in a."""
    _, moves = filled(event_costs(a, b)[None], np.full((1, len(a)), gap), np.full((1, len(b)), gap))
    out: list[tuple[int | None, int | None]] = []
    i, j = len(a), len(b)
    while i or j:
        step = moves[0, i, j]
        i, j = i - int(step != 2), j - int(step != 1)
        out.append((i if step != 2 else None, j if step != 1 else None))
    return out[::-1]


def align_events(left: DataFrame, right: DataFrame, *, key: str, order: str, events: str) -> DataFrame:
    """(key, step, a, b): aligned places of two event tables, ``events`` an array of note names each."""

    def run(k: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        sides = [[frozenset(e) for e in p.sort_values(order)[events]] for p in (x, y)]
        pairs = align(*sides)
        return pd.DataFrame({key: [k[0]] * len(pairs), "step": range(len(pairs)), "a": pd.array([p[0] for p in pairs], "Int64"), "b": pd.array([p[1] for p in pairs], "Int64")})

    kind = left.schema[key].dataType.simpleString()
    return left.select(key, order, events).groupBy(key).cogroup(right.select(key, order, events).groupBy(key)).applyInPandas(run, f"{key} {kind}, step int, a bigint, b bigint")


def greedy_match(a: np.ndarray, b: np.ndarray, tol: np.ndarray) -> dict[int, int]:
    """One-to-one pairs within each a's tolerance, nearest first, then by place."""
    d = np.abs(a[:, None] - b[None, :])
    i, j = np.nonzero(d <= tol[:, None])
    used_a: dict[int, int] = {}
    used_b: set[int] = set()
    for k in np.lexsort((j, i, d[i, j])):
        x, y = int(i[k]), int(j[k])
        if x not in used_a and y not in used_b:
            used_a[x] = y
            used_b.add(y)
    return used_a


def longest_rising(values: list[float]) -> list[int]:
    """Places of a longest non-decreasing subsequence (patience sorting)."""
    tails: list[float] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect.bisect_right(tails, v)
        back.append(at[k - 1] if k else -1)
        tails[k:k + 1], at[k:k + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def play_times(system: np.ndarray, x0: np.ndarray, x1: np.ndarray, xc: np.ndarray, spacing: np.ndarray, dur: float, stored: list[tuple[int, float, float]]) -> np.ndarray:
    """When each event of a page is played.

    Without stored times, events are spread evenly by width over the page's systems.  Stored times
    (system, x, t) anchor the nearest events (0.35 spacings, 8 if unknown); anchors that go backwards
    are dropped, the rest interpolates between anchors along the even spread.
    """
    names = np.unique(system)
    low = np.array([x0[system == s].min() for s in names])
    width = np.array([max(1.0, x1[system == s].max() - x0[system == s].min()) for s in names])
    before = np.cumsum(width) - width
    which = np.searchsorted(names, system)
    even = (before[which] + x0 - low[which]) / width.sum() * dur
    known: dict[int, float] = {}
    tol = np.where(spacing > 0, 0.35 * spacing, 8.0)
    for s in names:
        own = np.flatnonzero(system == s)
        rows = [r for r in stored if r[0] == s]
        if rows:
            for i, j in greedy_match(xc[own], np.array([r[1] for r in rows], float), tol[own]).items():
                known[int(own[i])] = float(np.clip(rows[j][2], 0, dur))
    places = sorted(known)
    anchors = [places[i] for i in longest_rising([known[p] for p in places])]
    at = np.array([0.0, *even[anchors], dur])
    t = np.array([0.0, *[known[p] for p in anchors], dur])
    seg = np.searchsorted(anchors, np.arange(len(even)), "left") if anchors else np.zeros(len(even), int)
    span = at[np.minimum(seg + 1, len(at) - 1)] - at[seg]
    share = np.where(span > 1e-9, np.clip((even - at[seg]) / np.where(span > 1e-9, span, 1), 0, 1), 0)
    out = t[seg] + share * (t[np.minimum(seg + 1, len(t) - 1)] - t[seg])
    out[anchors] = [known[p] for p in anchors]
    return np.maximum.accumulate(out)


def rate_limit(times: np.ndarray, window: float, most: int) -> np.ndarray:
    """Whether each hit passes: a window opens at its first hit, and takes ``most`` hits."""
    out = np.zeros(len(times), bool)
    start, n = -np.inf, 0
    for i, t in enumerate(times):
        if t - start >= window:
            start, n = t, 0
        n += 1
        out[i] = n <= most
    return out


def rate_limited(df: DataFrame, *, key: str, order: str, id_col: str, seconds: str, window: float, most: int) -> DataFrame:
    """(key, id, allowed) by the first-hit window of each key.

    Rows stream through a task in order of key and time; two numbers are held, never a key's rows.
    """

    def run(frames):
        last: object = None
        start, n = -np.inf, 0
        for pdf in frames:
            keys, times = pdf[key].tolist(), pdf[seconds].to_numpy(float)
            out = np.zeros(len(pdf), bool)
            for i, (k, t) in enumerate(zip(keys, times.tolist(), strict=True)):
                if k != last or t - start >= window:
                    last, start, n = k, t, 0
                n += 1
                out[i] = n <= most
            yield pd.DataFrame({key: pdf[key], id_col: pdf[id_col], "allowed": out})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ordered = df.select(key, id_col, seconds).repartition(key).sortWithinPartitions(key, seconds, id_col)
    return ordered.mapInPandas(run, f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, allowed boolean")


class Suppressor:
    """Passes a message unless it equals the last one sent and comes within ``window`` of it."""

    def __init__(self, window: float, message: object = None, at: float = float("-inf")):
        self.window, self.message, self.at = window, message, at

    def push(self, messages: list, times: list[float]) -> list[bool]:
        out = []
        for m, t in zip(messages, times, strict=True):
            out.append(m != self.message or t - self.at >= self.window)
            if out[-1]:
                self.message, self.at = m, t
        return out


def suppress_repeats(df: DataFrame, *, key: str, id_col: str, seconds: str, message: str, window: float) -> DataFrame:
    """(key, id, sent): whether each message of a key goes out, in order of time.

    Rows stream through a task in order of key and time; one message is held, never a key's rows.
    """

    def run(frames):
        last, own = object(), Suppressor(window)
        for pdf in frames:
            sent: list[bool] = []
            for k, part in pdf.groupby((pdf[key] != pdf[key].shift()).cumsum(), sort=False):
                first = part[key].iloc[0]
                if first != last:
                    last, own = first, Suppressor(window)
                sent += own.push([None if pd.isna(m) else m for m in part[message]], part[seconds].tolist())
            yield pd.DataFrame({key: pdf[key], id_col: pdf[id_col], "sent": sent})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ordered = df.select(key, id_col, seconds, message).filter(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, seconds, id_col)
    return ordered.mapInPandas(run, f"{key} {kinds[key]}, {id_col} {kinds[id_col]}, sent boolean")
