"""In-order alignments of many short sequences at once: padded to one array and filled by anti-diagonals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of one padded array, about; a larger alignment goes by itself.
CELLS = 1 << 21
#: Costs of leaving a note's mark or a technique's mark without a glyph; the least probability that counts (fixed values).
SKIP, SKIP_SOFT, LEAST = 6.0, 2.5, 1e-4


def align_many(cost: np.ndarray, drop: np.ndarray, skip: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(match [B, M]: the a that each b is paired with or -1, cost [B]) of the cheapest in-order pairings.

    Pairing a[i] and b[j] costs cost[:, i, j], leaving one out drop[:, i] or skip[:, j].  Sequences are as long
    as ``n`` and ``m`` say; what stands beyond is padding.  Of equal ways from the end, pairing goes before leaving an a
    out, and that before leaving a b out.
    """
    best, move = filled(cost, drop, skip)
    size, _, columns = cost.shape
    match = np.full((size, columns), -1)
    every, i, j = np.arange(size), n.copy(), m.copy()
    while (open_ := (i > 0) | (j > 0)).any():
        step = np.where(open_, move[every, i, j], -1)
        paired = step == 0
        match[every[paired], j[paired] - 1] = i[paired] - 1
        i -= (step == 0) | (step == 1)
        j -= (step == 0) | (step == 2)
    return match, best[every, n, m]


def filled(cost: np.ndarray, drop: np.ndarray, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least cost [B, N + 1, M + 1] up to each place, the way there: 0 pair, 1 an a left out, 2 a b left out)."""
    size, rows, columns = cost.shape
    best = np.zeros((size, rows + 1, columns + 1))
    best[:, 1:, 0], best[:, 0, 1:] = np.cumsum(drop, axis=1), np.cumsum(skip, axis=1)
    move = np.zeros(best.shape, np.int8)
    move[:, 1:, 0], move[:, 0, 1:] = 1, 2
    for d in range(2, rows + columns + 1):
        i = np.arange(max(1, d - columns), min(rows, d - 1) + 1)
        j = d - i
        ways = np.stack([best[:, i - 1, j - 1] + cost[:, i - 1, j - 1], best[:, i - 1, j] + drop[:, i - 1], best[:, i, j - 1] + skip[:, j - 1]])
        move[:, i, j] = ways.argmin(axis=0)
        best[:, i, j] = ways.min(axis=0)
    return best, move


def in_blocks(n: np.ndarray, m: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of alignments of like size, whose padded arrays have some ``CELLS`` together."""
    order = np.lexsort((m, n))
    lo = 0
    while lo < len(order):
        hi, wide = lo, 0
        while hi < len(order):
            wide = max(wide, int(m[order[hi]]) + 1)
            if hi > lo and (hi - lo + 1) * (int(n[order[hi]]) + 1) * wide > CELLS:
                break
            hi += 1
        yield order[lo:hi]
        lo = hi


def _padded(rows: list[np.ndarray], width: int, fill: float = 0.0) -> np.ndarray:
    out = np.full((len(rows), width, *rows[0].shape[1:]), fill)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def align_marks(glyphs: DataFrame, marks: DataFrame, *, key: list[str], order: str, probabilities: str, mark: str, soft: str, other: int) -> DataFrame:
    """Which glyph of a string stands for each of its expected marks: (key, order, mark, glyph, cost), glyph and mark being places from 0.

    ``glyphs`` (key, order, array of class probabilities) and ``marks`` (key, order, class, whether it is a
    soft one) are aligned in order: a pair costs -log p of the mark's class, a glyph left out -log p of class
    ``other``, a mark left out ``SKIP``, or ``SKIP_SOFT`` if it is soft.  ``order`` is that of the mark; a mark
    without glyph has a null one; ``cost`` is the string's.  A string is one row; strings of an Arrow batch are aligned together.
    Strings without marks have no rows, those without glyphs no glyph; rows with a null key, order, class or array go.
    """
    whole = [*key, order]
    kinds = {f.name: f.dataType.simpleString() for f in marks.schema.fields}
    g = glyphs.select(*whole, F.col(probabilities).cast("array<double>").alias("p")).dropna()
    g = g.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "p"))), lambda x: x["p"]).alias("glyphs"))
    t = marks.select(*whole, F.col(mark).cast("int").alias("c"), F.coalesce(F.col(soft), F.lit(False)).alias("soft")).dropna()
    t = t.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "c", "soft"))).alias("marks"))
    joined = t.join(g, key, "left").select(*key, "marks", F.coalesce("glyphs", F.array().cast("array<array<double>>")).alias("glyphs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [np.array(x.as_py() or np.empty((0, 1)), float) for x in batch.column(len(key) + 1)]
            listed = batch.column(len(key))
            flat = listed.flatten()
            cls, soft_ = flat.field("c").to_numpy(), flat.field("soft").to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.diff(listed.offsets.to_numpy()))
            n, m = np.array([len(x) for x in p], np.int64), np.diff(ends, prepend=0)
            glyph, total = np.full(len(cls), -1), np.zeros(len(batch))
            for own in in_blocks(n, m):
                costs, drops, skips = [], [], []
                for k in own:
                    mine = slice(ends[k] - m[k], ends[k])
                    logs = -np.log(np.maximum(LEAST, p[k])) if n[k] else np.zeros((0, 1))
                    costs.append(logs[:, cls[mine]] if n[k] else np.zeros((0, m[k])))
                    drops.append(logs[:, other] if n[k] else np.zeros(0))
                    skips.append(np.where(soft_[mine], SKIP_SOFT, SKIP))
                wide, deep = int(m[own].max()), int(n[own].max())
                cost = np.zeros((len(own), deep, wide))
                for k, c in enumerate(costs):
                    cost[k, : c.shape[0], : c.shape[1]] = c
                match, best = align_many(cost, _padded(drops, deep), _padded(skips, wide), n[own], m[own])
                total[own] = best
                for k, row in zip(own, match, strict=True):
                    glyph[ends[k] - m[k] : ends[k]] = row[: m[k]]
            each = np.repeat(np.arange(len(batch)), m)
            place = np.arange(len(cls)) - (ends - m)[each]
            keys = [batch.column(i).take(pa.array(each)) for i in range(len(key))]
            found = pa.array(glyph.astype(np.int32), mask=glyph < 0)
            yield pa.RecordBatch.from_arrays([*keys, flat.field("o"), pa.array(place.astype(np.int32)), found, pa.array(total[each])], [*key, order, "mark", "glyph", "cost"])

    out = ", ".join(f"`{c}` {kinds[c]}" for c in whole)
    return joined.mapInArrow(run, f"{out}, mark int, glyph int, cost double")
