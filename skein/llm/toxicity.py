"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is cut into overlapping windows of words.  A word's input joins a hashed word embedding, the
mean of hashed character n-gram embeddings, and the log-odds of its word and of its strongest n-gram
in the training documents.  Both recurrent directions and the attention run over each window, and the
text's score is that of its most toxic window: all windows of the whole text are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.language_id import held_out
from skein.llm.store import arrow_batches, given_back
from skein.llm.textcols import ALNUM, LOWER, buffers, expand, mix64, word_ids, words

#: Words of a window and from one window to the next; hidden units of a direction; attention units.
SPAN, STRIDE, HIDDEN, ATTEND = 40, 20, 12, 12
#: Hashed classes of embeddings and of log-odds, and widths of the embeddings.
BUCKETS, ODDS, WORD_DIM, CHAR_DIM = 1 << 14, 1 << 17, 8, 12
#: Bounds of the training sample: documents of each label, all with their whole texts (scoring has no bound).
TRAIN_TOXIC, TRAIN_CLEAN = 1200, 1800
EPOCHS, BATCH, RATE, SEED = 12, 256, 0.01, 7
#: Standard errors that a log-odds weight is lowered by.
DOUBT = 2.0
THRESHOLD = 0.3
#: Window logit of a text without words, of which nothing can be learned.
WORDLESS = -4.0


def _hash_bytes(terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, n-gram hashes, first n-gram of each word, their number) of distinct words.

    N-grams of 3, 4 and 5 bytes with a mark at both ends of the word; each word has one at least.
    """
    data, offsets = buffers(terms)
    n = len(terms)
    size = np.diff(offsets)
    padded = np.full(len(data) + 2 * n, 1, np.uint64)
    owner = np.repeat(np.arange(n), size)
    padded[np.arange(len(data)) + 2 * owner + 1] = data.astype(np.uint64) + np.uint64(2)
    begin = offsets[:-1] + 2 * np.arange(n)
    length = size + 2
    rolled, grams, of = np.zeros_like(padded), [], []
    for k in range(1, 6):
        shifted = np.zeros_like(padded)
        shifted[: len(padded) - k + 1] = padded[k - 1 :] if k > 1 else padded
        rolled = rolled * np.uint64(0x100000001B3) + shifted
        if k >= 3:
            at, who = expand(begin, np.maximum(length - k + 1, 0))
            grams.append(mix64(rolled[at] * np.uint64(8) + np.uint64(k)))
            of.append(who)
    grams, of = np.concatenate(grams), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    grams, count = grams[order], np.bincount(of, minlength=n)
    first = np.cumsum(count) - count
    whole = np.add.reduceat(mix64(grams), first) if n else np.empty(0, np.uint64)
    return mix64(whole), grams, first, count


@dataclass
class Net:
    """Weights: recurrent ones stacked for both directions as [2, ...]."""

    odds_word: np.ndarray
    odds_char: np.ndarray
    word: np.ndarray
    char: np.ndarray
    wx: np.ndarray  # [2, D, 3H]
    bx: np.ndarray  # [2, 3H]
    uh: np.ndarray  # [2, H, 3H]
    wa: np.ndarray  # [2H, A]
    va: np.ndarray  # [A]
    wo: np.ndarray  # [2H + 1], the last is the bias
    scale: np.ndarray  # logit of a text: scale[0] * its highest window logit + scale[1]

    @classmethod
    def fresh(cls, odds_word: np.ndarray, odds_char: np.ndarray) -> Net:
        g = np.random.default_rng(SEED)
        n = lambda *s, by=0.1: (g.standard_normal(s) * by).astype(np.float32)
        d = WORD_DIM + CHAR_DIM + 2
        return cls(
            odds_word, odds_char, n(BUCKETS, WORD_DIM), n(BUCKETS, CHAR_DIM), n(2, d, 3 * HIDDEN, by=0.2), np.zeros((2, 3 * HIDDEN), np.float32),
            n(2, HIDDEN, 3 * HIDDEN, by=0.2), n(2 * HIDDEN, ATTEND, by=0.2), n(ATTEND, by=0.2), n(2 * HIDDEN + 1, by=0.1), np.array([1.0, 0.0]),
        )

    def inputs(self, h: np.ndarray, grams: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Input vectors of distinct words; some thousand words' n-grams are looked up at a time."""
        out = np.empty((len(h), WORD_DIM + CHAR_DIM + 2), np.float32)
        for lo in range(0, len(h), 4096):
            own = slice(lo, lo + 4096)
            begin = first[lo]
            part = grams[begin : first[own][-1] + count[own][-1]]
            out[own, :WORD_DIM] = self.word[(h[own] % np.uint64(BUCKETS)).astype(np.int64)]
            out[own, WORD_DIM:-2] = np.add.reduceat(self.char[(part % np.uint64(BUCKETS)).astype(np.int64)], first[own] - begin) / count[own][:, None]
            out[own, -2] = self.odds_word[(h[own] % np.uint64(ODDS)).astype(np.int64)]
            out[own, -1] = np.maximum.reduceat(self.odds_char[(part % np.uint64(ODDS)).astype(np.int64)], first[own] - begin)
        return out

    def project(self, x: np.ndarray) -> np.ndarray:
        """[2, words + 1, 3H]: what each word adds to the gates of both directions; the last row is no word."""
        return np.concatenate([x @ self.wx + self.bx[:, None], np.zeros((2, 1, 3 * HIDDEN), np.float32)], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sum of the values of each)."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.diff(rows, prepend=-1))
    return rows[first], np.add.reduceat(values[order], first, axis=0)


def forward(net: Net, projected: np.ndarray, ids: np.ndarray, keep: bool = False):
    """Window logits; ids [windows, SPAN] into ``projected`` [2, words + 1, 3H], whose last row is no word."""
    b, none = len(ids), projected.shape[1] - 1
    mask = (ids != none).astype(np.float32)
    full = mask.all(axis=0)
    states = np.empty((SPAN, b, 2 * HIDDEN), np.float32)
    steps = []
    by_step = np.ascontiguousarray(ids.T)
    for way in (0, 1):
        h = np.zeros((b, HIDDEN), np.float32)
        for t in range(SPAN) if way == 0 else range(SPAN - 1, -1, -1):
            x, u = projected[way].take(by_step[t], axis=0), h @ net.uh[way]
            zr = x[:, : 2 * HIDDEN]
            zr += u[:, : 2 * HIDDEN]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r, n = zr[:, :HIDDEN], zr[:, HIDDEN:], x[:, 2 * HIDDEN :]
            n += r * u[:, 2 * HIDDEN :]
            np.tanh(n, out=n)
            if keep:
                steps.append((way, t, h, z, r, n, u[:, 2 * HIDDEN :]))
            new = h - n
            new *= z
            new += n
            h = new if full[t] else h + mask[:, t : t + 1] * (new - h)
            states[t, :, way * HIDDEN : (way + 1) * HIDDEN] = h
    flat = states.reshape(-1, 2 * HIDDEN)
    hidden = np.tanh(flat @ net.wa)
    a = (hidden @ net.va).reshape(SPAN, b)
    a = np.where(mask.T > 0, a, -1e9)
    a = np.exp(a - a.max(axis=0)) * mask.T
    a /= np.maximum(a.sum(axis=0), 1e-9)
    pooled = (states * a[:, :, None]).sum(axis=0)
    logit = pooled @ net.wo[:-1] + net.wo[-1]
    if not keep:
        return logit
    turn = lambda x: np.ascontiguousarray(x.reshape(SPAN, b, -1).transpose(1, 0, 2))
    return logit, (mask, turn(flat), turn(hidden), np.ascontiguousarray(a.T), pooled, steps)


def backward(net: Net, ids: np.ndarray, cache, dlogit: np.ndarray, n_words: int) -> tuple[dict, np.ndarray]:
    """(gradients of the dense weights, gradient of ``projected``)."""
    mask, flat, hidden, a, pooled, steps = cache
    g = {"wo": np.append(pooled.T @ dlogit, dlogit.sum()).astype(np.float32)}
    dpool = dlogit[:, None] * net.wo[:-1]
    da = np.einsum("bd,btd->bt", dpool, flat)
    da = a * (da - (a * da).sum(axis=1, keepdims=True))
    dh = da[:, :, None] * net.va * (1 - hidden**2)
    g["va"] = np.einsum("bt,bta->a", da, hidden)
    g["wa"] = np.einsum("btd,bta->da", flat, dh)
    dflat = (a[:, :, None] * dpool[:, None, :] + dh @ net.wa.T).reshape(len(ids), SPAN, 2, HIDDEN)
    g["uh"] = np.zeros_like(net.uh)
    dproj = np.zeros((2, n_words + 1, 3 * HIDDEN), np.float32)
    at_step = np.empty((2, SPAN, len(ids), 3 * HIDDEN), np.float32)
    carry, last = None, None
    for way, t, h, z, r, n, un in reversed(steps):
        if way != last:
            carry, last = np.zeros_like(h), way
        m = mask[:, t : t + 1]
        d = carry + dflat[:, t, way]
        dnew = d * m
        dz, dn = dnew * (h - n) * z * (1 - z), dnew * (1 - z) * (1 - n**2)
        dr = dn * un * r * (1 - r)
        du = np.concatenate([dz, dr, dn * r], 1)
        g["uh"][way] += h.T @ du
        carry = d * (1 - m) + dnew * z + du @ net.uh[way].T
        at_step[way, t] = np.concatenate([dz, dr, dn], 1)
    for way in (0, 1):
        rows, total = _summed(ids.T.ravel(), at_step[way].reshape(-1, 3 * HIDDEN))
        dproj[way, rows] = total
    return g, dproj


def cut(ids: np.ndarray, ptr: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows [n, SPAN] of word ids, document of each): they overlap and cover every word."""
    size = np.diff(ptr)
    count = np.maximum(1, -(-(size - SPAN) // STRIDE) + 1)
    k, doc = expand(np.zeros(len(size), np.int64), count)
    start = ptr[:-1][doc] + k * STRIDE
    full = np.append(ids, none).astype(np.int32)
    windows = np.full((len(start), SPAN), none, np.int32)
    for t in range(SPAN):
        ok = start + t < ptr[1:][doc]
        windows[ok, t] = full[start[ok] + t]
    return windows, doc


def train(texts: list[str], toxic: np.ndarray, use_odds: bool = True) -> Net:
    """A network from the training sample.  Without documents of both labels it scores all texts low.

    Without ``use_odds`` the network gets no log-odds as inputs, only embeddings; they still choose
    the windows that it learns from.
    """
    toxic = np.asarray(toxic, bool)
    data, offsets = buffers(pa.array(texts, pa.large_string()))
    data = LOWER[data]
    start, end, ptr = words(data, offsets, ALNUM)
    ids, terms = word_ids(data, start, end)
    del data, start, end
    h, grams, first, count = _hash_bytes(terms)
    odds = []
    for classes, at, of in (((h % np.uint64(ODDS)).astype(np.int64), None, None), ((grams % np.uint64(ODDS)).astype(np.int64), first, count)):
        seen = [np.zeros(ODDS) for _ in (0, 1)]
        for d in range(len(texts)):
            own = np.unique(ids[ptr[d] : ptr[d + 1]])
            own = own if at is None else expand(at[own], of[own])[0]
            seen[int(toxic[d])][np.unique(classes[own])] += 1
        clean, bad = seen[0] + 0.5, seen[1] + 0.5
        weight = np.log(bad / (np.sum(toxic) + 1)) - np.log(clean / (np.sum(~toxic) + 1))
        sure = np.maximum(np.abs(weight) - DOUBT * np.sqrt(1 / clean + 1 / bad), 0)  # a few sightings prove little
        odds.append((np.sign(weight) * np.minimum(sure, 4)).astype(np.float32))
    net = Net.fresh(*(odds if use_odds else map(np.zeros_like, odds)))
    if toxic.all() or not toxic.any():
        net.scale = np.array([0.0, -4.0])
        return net
    none = len(terms)
    windows, of_doc = cut(ids, ptr, none)
    strength = np.append(np.maximum(odds[0][(h % np.uint64(ODDS)).astype(np.int64)], np.maximum.reduceat(odds[1][(grams % np.uint64(ODDS)).astype(np.int64)], first)), -9)
    lead = strength[windows].max(axis=1)
    g = np.random.default_rng(SEED)
    order = np.lexsort((-lead, of_doc))
    rank = np.arange(len(order)) - np.searchsorted(of_doc, of_doc[order], "left")
    best = order[(rank == 0)]  # a toxic document's most telling window; clean ones also lend others
    more = g.permutation(np.flatnonzero(~toxic[of_doc]))[: 2 * len(texts)]
    chosen = np.concatenate([best, more])
    label = toxic[of_doc[chosen]].astype(np.float32)
    sums: dict[str, list] = {}
    squares = {"word": np.full(net.word.shape, 0.1, np.float32), "char": np.full(net.char.shape, 0.1, np.float32)}
    step = 0
    for _ in range(EPOCHS):
        for lo in range(0, len(chosen), BATCH):
            pick = g.integers(0, len(chosen), BATCH) if lo else g.permutation(len(chosen))[:BATCH]
            used, local = np.unique(windows[chosen[pick]], return_inverse=True)
            local = local.reshape(len(pick), SPAN)
            real = used[used != none]
            if len(real) == len(used):
                used = np.append(used, none)
            at, who = expand(first[real], count[real])
            sub = np.cumsum(count[real]) - count[real]
            x = net.inputs(h[real], grams[at], sub, count[real])
            projected = net.project(x)
            logit, cache = forward(net, projected, local, keep=True)
            y = label[pick]
            dlogit = ((_sigmoid(logit) - y) * np.where(y > 0, 2.0, 1.0) / len(pick)).astype(np.float32)
            grad, dproj = backward(net, local, cache, dlogit, len(real))
            dproj = dproj[:, :-1]
            grad["wx"] = x.T @ dproj
            grad["bx"] = dproj.sum(axis=1)
            dx = (dproj @ net.wx.transpose(0, 2, 1)).sum(axis=0)
            step += 1
            for name, value in grad.items():
                m, v = sums.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
                m += 0.1 * (value - m)
                v += 0.001 * (value**2 - v)
                getattr(net, name)[...] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            for name, rows, value in (
                ("word", (h[real] % np.uint64(BUCKETS)).astype(np.int64), dx[:, :WORD_DIM]),
                ("char", (grams[at] % np.uint64(BUCKETS)).astype(np.int64), (dx[:, WORD_DIM : WORD_DIM + CHAR_DIM] / count[real][:, None])[who]),
            ):
                rows, total = _summed(rows, value)
                squares[name][rows] += total**2
                getattr(net, name)[rows] -= 0.05 * total / np.sqrt(squares[name][rows])
    top = score_windows(net, ids, ptr, (h, grams, first, count))
    a, b = 1.0, 0.0
    for _ in range(300):  # the text's probability from its highest window
        e = _sigmoid(a * top + b) - toxic
        a, b = a - 0.5 * float(np.mean(e * top)) / (1 + float(np.mean(top**2))), b - 0.5 * float(np.mean(e))
    net.scale = np.array([a, b])
    return net


def score_windows(net: Net, ids: np.ndarray, ptr: np.ndarray, hashed, block: int = 1024) -> np.ndarray:
    """Each document's highest window logit."""
    x = net.inputs(*hashed)
    projected = net.project(x)
    windows, doc = cut(ids, ptr, len(x))
    out = np.full(len(ptr) - 1, -np.inf)
    for lo in range(0, len(windows), block):
        np.maximum.at(out, doc[lo : lo + block], forward(net, projected, windows[lo : lo + block]))
    out[ptr[1:] == ptr[:-1]] = WORDLESS
    return out


def predict(docs: DataFrame, net: Net, *, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``score`` (0 to 1): the highest of all overlapping windows.

    Null and empty texts, and those without words, have one window without words.  Repeated rows score
    alike; an input column called ``score`` is replaced.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    own = [c for c in docs.columns if c != "score"]
    sent = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = buffers(batch.column(own.index(text_col)))
            data = LOWER[data]
            start, end, ptr = words(data, offsets, ALNUM)
            ids, terms = word_ids(data, start, end)
            top = score_windows(model, ids, ptr, _hash_bytes(terms))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_sigmoid(model.scale[0] * top + model.scale[1]).astype(float))], [*own, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema.fields)
    return docs.select(*own).mapInArrow(given_back(run), f"{kinds}, score double")


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray]:
    """At most about TRAIN_TOXIC and TRAIN_CLEAN labelled documents that are not held out, by a hash of the id; of texts that share an id the first."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    count = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("toxic") == 1, min(1.0, TRAIN_TOXIC / max(count.get(1, 0), 1))).otherwise(min(1.0, TRAIN_CLEAN / max(count.get(0, 0), 1)))
    picked = known.filter(place < share).limit(2 * (TRAIN_TOXIC + TRAIN_CLEAN))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").select("text", "toxic").toPandas()
    return rows["text"].tolist(), rows["toxic"].to_numpy() == 1


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all rows of ``documents``, learned from the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = train(*training_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")))
    done = predict(docs, net)
    return done.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
