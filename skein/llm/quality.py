"""Quality: kernel ridge regression over document statistics, by random Fourier features.

A whole text becomes a short list of statistics: shares of kinds of bytes and words, repeats, shapes of
lines, and the worst of its windows of words.  Standardised, they are projected on random directions
whose cosines approximate a Gaussian kernel.  Each partition sums its part of the normal equations, one
sum a fold; sums are joined in a tree, and all folds together give the ridge weights.  Every labelled
row is also scored by the weights of the other folds; those scores, counted on a fixed grid, give the
isotonic curve that turns scores into probabilities.  All labelled rows are used, without a sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.language_id import held_out
from skein.llm.merging import merge_tree, reduced
from skein.llm.native import text_key
from skein.llm.store import arrow_batches, given_back, materialise
from skein.llm.textcols import NOT_WHITE, buffers, expand, word_ids, words

#: Words of a window and from one window to the next.
SPAN, STRIDE = 40, 20
#: Random features, width of the kernel in standard deviations a statistic, ridge weight for each row, folds, seed.
FEATURES, WIDTH, RIDGE, FOLDS, SEED = 256, 2.0, 1e-4, 4, 11
#: Standardised statistics beyond this count as this.
FAR = 5.0
#: Cells of a score's grid from -1 to 2, on which the isotonic curve is fitted.
CELLS = 3 << 11
THRESHOLD = 0.7
#: Score of all texts if nothing is labelled.
UNTOLD = 0.5

_B = np.arange(256)
_UPPER, _LOWER = (_B >= 0x41) & (_B <= 0x5A), (_B >= 0x61) & (_B <= 0x7A)
_DIGIT, _HIGH = (_B >= 0x30) & (_B <= 0x39), _B >= 0x80
_STOP = np.isin(_B, list(b".,;:!?'\"()-"))
_SYMBOL = (_B > 0x20) & (_B < 0x7F) & ~(_UPPER | _LOWER | _DIGIT | _STOP)
_KINDS = np.array([_UPPER, _LOWER, _DIGIT, _HIGH, _STOP, _SYMBOL, ~NOT_WHITE, (_B < 0x20) & NOT_WHITE, _B == ord("!")], float)
#: Statistics of a text: shares of kinds of bytes; entropy; sizes; words; lines; windows.
N_STATS = len(_KINDS) + 1 + 4 + 10 + 3 + 6


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _per_doc(flags: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[ptr[1:]] - total[ptr[:-1]]


def statistics(column: pa.Array) -> np.ndarray:
    """[texts, N_STATS] of whole texts; a null or empty text is all zeros."""
    data, offsets = buffers(column)
    n = len(column)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    count = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256)
    p = count / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(axis=1)
    start, end, ptr = words(data, offsets, NOT_WHITE)
    n_words = np.diff(ptr)
    ids, _ = word_ids(data, start, end)
    of = np.repeat(np.arange(n), n_words)

    def within(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind[data], dtype=np.int64)])
        return total[end] - total[start]

    upper, lower, symbol, plain = within(_UPPER), within(_LOWER), within(_SYMBOL), within(_UPPER | _LOWER | _DIGIT | _HIGH)
    length = end - start
    again = np.zeros(len(ids), bool)
    again[1:] = (ids[1:] == ids[:-1]) & (of[1:] == of[:-1])
    flags = np.array([symbol > 0, (upper > 1) & (lower == 0), plain == 0, again, length > 24, upper > lower])
    distinct, most = _vocabulary(of, ids, n)
    stop = np.isin(data[end - 1], list(b".!?")) if len(end) else np.empty(0, bool)
    shares = [_share(_per_doc(f, ptr), n_words) for f in flags]
    shape = [_share(_per_doc(length, ptr), n_words), np.sqrt(_share(_per_doc(length**2, ptr), n_words)), _share(_per_doc(stop, ptr), n_words), _share(distinct, n_words)]
    lines = _lines(data, offsets, n)
    sizes = [np.log1p(size), np.log1p(n_words), np.log1p(distinct), _share(most, n_words)]
    return np.column_stack([_share((count @ _KINDS.T), size[:, None]), entropy, *sizes, *shape, *shares, *lines, *_worst(flags, ptr)])


def _vocabulary(of: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words, uses of the most frequent one) of each text."""
    if not len(ids):
        return np.zeros(n), np.zeros(n)
    pair, uses = np.unique(of.astype(np.int64) * (int(ids.max()) + 1) + ids, return_counts=True)
    owner = pair // (int(ids.max()) + 1)
    most = np.zeros(n)
    np.maximum.at(most, owner, uses)
    return np.bincount(owner, minlength=n).astype(float), most


def _lines(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """(log of the number of lines, log of their mean length, share of distinct ones), empty lines left out."""
    start, end, ptr = words(data, offsets, _B != 0x0A)
    count = np.diff(ptr)
    ids, _ = word_ids(data, start, end)
    distinct, _ = _vocabulary(np.repeat(np.arange(n), count), ids, n)
    return [np.log1p(count), np.log1p(_share(_per_doc(end - start, ptr), count)), _share(distinct, count)]


def _worst(flags: np.ndarray, ptr: np.ndarray) -> list[np.ndarray]:
    """For each kind of word its largest share of a window; windows overlap and cover all words."""
    size = np.diff(ptr)
    step, doc = expand(np.zeros(len(size), np.int64), np.maximum(1, -(-(size - SPAN) // STRIDE) + 1))
    lo = ptr[:-1][doc] + step * STRIDE
    hi = np.minimum(lo + SPAN, ptr[1:][doc])
    out = []
    for f in flags:
        total = np.concatenate([[0], np.cumsum(f)])
        most = np.zeros(len(size))
        np.maximum.at(most, doc, (total[hi] - total[lo]) / SPAN)
        out.append(most)
    return out


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored (doc_id, fold, x): the statistics of each row; equal texts are of one fold."""
    arrow_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(2))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], ["doc_id", "fold", "x"])

    fold = F.pmod(text_key(F.col(text_col)), F.lit(FOLDS)).cast("int")
    rows = docs.select(F.col(id_col).alias("doc_id"), fold.alias("fold"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(given_back(run), f"doc_id {kind}, fold int, x array<double>"), "statistics")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), N_STATS)


@dataclass
class Model:
    """Standardisation, random directions, ridge weights (of all rows and without each fold) and the isotonic curve."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None  # [FEATURES + 1, 1 + FOLDS]
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """[rows, FEATURES + 1]: cosines along random directions, and 1."""
        g = np.random.default_rng(SEED)
        directions = g.standard_normal((N_STATS, FEATURES)) / (WIDTH * np.sqrt(N_STATS))
        shift = g.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -FAR, FAR)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ directions + shift), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(x), UNTOLD)
        return np.clip(np.interp(self.features(x) @ self.weights[:, 0], *self.curve), 0, 1)


def _cell(score: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((score + 1) * (CELLS / 3)), 0, CELLS - 1).astype(np.int64)


def isotonic(cell: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, probabilities), rising: the least-squares monotone fit to counts by cell, by pooling neighbours that fall.

    A pool stands at its mean score; between pools the curve is a line.
    """
    pools: list[list[float]] = []
    order = np.argsort(cell)
    for c, k, g in zip(cell[order].tolist(), n[order].tolist(), good[order].tolist(), strict=True):
        pools.append([k, g, k * ((c + 0.5) * 3 / CELLS - 1)])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    k, g, s = np.array(pools).T
    return s / k, g / k


def _spread(known: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and standard deviation of each statistic, from parts (rows, means, squares less the mean)."""

    def join(values: list[np.ndarray]) -> np.ndarray:
        n = sum(v[0] for v in values)
        mean = sum(v[0] * v[1 : N_STATS + 1] for v in values) / n
        return np.concatenate([[n], mean, sum(v[N_STATS + 1 :] + v[0] * (v[1 : N_STATS + 1] - mean) ** 2 for v in values)])

    def take(value: np.ndarray | None, batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column(0))
        own = np.concatenate([[len(x)], x.mean(axis=0), ((x - x.mean(axis=0)) ** 2).sum(axis=0)])
        return own if value is None else join([value, own])

    done = merge_tree(reduced(known.select("x"), take), join, "spread")
    if done is None:
        return None
    deviation = np.sqrt(done[N_STATS + 1 :] / done[0])
    return done[1 : N_STATS + 1], np.where(deviation > 1e-9, deviation, 1.0)


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Model:
    """Learn from all rows of ``stats`` with a label of 0 or 1 whose id is not held out; the highest label of an id counts."""
    told = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("double").alias("y"))
    known = materialise(stats.join(told.filter(~held_out(F.col("doc_id"))), "doc_id").select("x", "fold", "y"), "known")
    spread = _spread(known)
    if spread is None:
        return Model(np.zeros(N_STATS), np.ones(N_STATS))
    model = Model(*spread)
    d = FEATURES + 1

    def take(value: np.ndarray | None, batch: pa.RecordBatch) -> np.ndarray:
        """[FOLDS, d, d + 1]: the normal equations of each fold, with their right side."""
        value = np.zeros((FOLDS, d, d + 1)) if value is None else value
        z, fold, y = model.features(_matrix(batch.column(0))), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for k in range(FOLDS):
            own = z[fold == k]
            value[k] += own.T @ np.column_stack([own, y[fold == k]])
        return value

    sums = merge_tree(reduced(known, take), lambda values: np.sum(values, axis=0), "equations").reshape(FOLDS, d, d + 1)
    model.weights = np.column_stack([_ridge(sums.sum(axis=0) - (0 if k is None else sums[k])) for k in (None, *range(FOLDS))])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Grid counts of scores by the weights of the other folds."""
        n, good = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
        for batch in batches:
            score = (model.features(_matrix(batch.column(0))) @ model.weights[:, 1:])[np.arange(batch.num_rows), batch.column(1).to_numpy()]
            cell = _cell(score)
            n += np.bincount(cell, minlength=CELLS)
            good += np.bincount(cell, batch.column(2).to_numpy(), CELLS).astype(np.int64)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own]), pa.array(good[own])], ["cell", "n", "good"])

    grid = known.mapInArrow(given_back(others), "cell bigint, n bigint, good bigint").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).toPandas()
    model.curve = isotonic(*(grid[c].to_numpy() for c in ("cell", "n", "good")))
    return model


def _ridge(sums: np.ndarray) -> np.ndarray:
    """Weights from normal equations; the last one, of the constant, is the mean label, so texts far from all others get it."""
    n, mean = sums[-1, -2], sums[-1, -1] / max(sums[-1, -2], 1.0)
    own = sums[:-1, :-2] + RIDGE * max(n, 1.0) * np.eye(FEATURES)
    return np.append(np.linalg.solve(own, sums[:-1, -1] - mean * sums[:-1, -2]), mean)


def predict(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of ``stats``."""
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(_matrix(batch.column(1))))], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(given_back(run), f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def score_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Null and empty texts have statistics of zero and are scored like other texts.  Repeated rows, and
    texts that share an id, are scored and learned from one by one; a null id is not held out and not
    learned from.  Labels other than 0 and 1 are left out; with labels of one kind all scores are that label, and
    without any label ``UNTOLD``.  Other columns are not read.  No rows: no rows.
    """
    stats = with_statistics(docs, id_col, text_col)
    done = predict(stats, fit(stats, labels, label_col, id_col))
    return done.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op11_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all whole texts of ``documents``, learned from the labels that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs, labels)
