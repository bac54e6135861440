"""Suffix-array dedup: removal of byte strings that occur twice, by a logarithmic index family.

Only a sample of the suffixes is indexed: each window of 200 bytes stands for the gram in it with the
least hash, and equal windows share sample and place.  Samples are counted by their gram first, so
text that occurs once leaves the job as a number.  Runs of windows whose bytes are all equal to
another run's are decided by their hash; only runs that share a gram but differ somewhere bring
their bytes to a shard, chosen by the gram.

A shard holds a family of suffix arrays.  Each batch of runs that arrives gets a suffix array of its
windows, is merge-scanned against every level for matches of the full length, and becomes a level
itself; levels of equal size merge, so that n batches leave at most log2(n) + 1 levels.  Grams with
more distinct runs than a shard should hold are settled by window hashes instead, which Spark counts
with map-side aggregation, and which need no group in one place.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.store import arrow_batches, given_back, materialise
from skein.llm.textcols import buffers, expand, mix64

LENGTH, GRAM = 200, 32
#: Bytes of text that are worked on together.
SLICE = 1 << 21
_Q = 0x9E3779B97F4A7C15 | 1
_Q_INV = pow(_Q, -1, 1 << 64)
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE, n) + 1
    if size not in _POWERS:
        _POWERS.clear()
        out = []
        for q in (_Q, _Q_INV):
            x = np.full(size, q, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width``, from prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def samples(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Sampled suffixes of each text, with the windows that each stands for.

    A window is ``length`` bytes of one text; its sample is the gram in it with the least hash, the
    first of equals, so equal windows have samples at the same place.  Runs of windows with one
    sample: doc, first window, number of windows, place of the sample in the first, ``ah`` (hash of the
    gram) and ``ch`` (hash of all bytes of the windows).
    """
    n = len(data)
    q, inverse = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * q[:n], out=total[1:])
    size = np.diff(offsets)
    doc_of = np.flatnonzero(size >= length)
    if not len(doc_of):
        none = np.empty(0, np.int64)
        return {"doc": none, "first": none, "windows": none, "place": none, "ah": none, "ch": none}
    grams = mix64((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    span = length - gram + 1
    keyed = (grams & ~np.uint64((1 << 28) - 1)) | np.arange(len(grams), dtype=np.uint64)
    least = (_sliding_min(keyed, span) & np.uint64((1 << 28) - 1)).astype(np.int64)
    starts, owner = expand(offsets[doc_of], size[doc_of] - length + 1)
    at = least[starts]
    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    first, anchor, doc = starts[new], at[new], doc_of[owner[new]]
    windows = np.diff(np.append(new, len(starts)))
    end = first + windows + length - 1
    body = (total[end] - total[first]) * inverse[first]
    shape = windows.astype(np.uint64) * np.uint64(1 << 20) + (anchor - first).astype(np.uint64)
    return {"doc": doc, "first": first - offsets[doc], "windows": windows, "place": anchor - first, "ah": grams[anchor].view(np.int64), "ch": mix64(body + mix64(shape)).view(np.int64)}


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of runs of rows with about ``SLICE`` bytes."""
    data, offsets = buffers(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class SuffixLevels:
    """A logarithmic family of suffix arrays over windows of ``length`` bytes."""

    def __init__(self, length: int = LENGTH):
        self.length = length
        #: Of each level: text, sorted window starts, owner and index of each window.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.found: list[np.ndarray] = []

    def _keys(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(text, self.length)
        return np.ascontiguousarray(view[starts]).view(f"S{self.length}").ravel()

    def add(self, text: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> None:
        """A new batch: windows of ``text`` at ``starts``; ids of windows that match go to ``found``."""
        keys = self._keys(text, starts)
        order = np.argsort(keys, kind="stable")
        keys, starts, ids = keys[order], starts[order], ids[order]
        same = np.zeros(len(keys) + 1, bool)
        same[1:-1] = keys[1:] == keys[:-1]
        self.found.append(ids[same[1:] | same[:-1]])
        for other, theirs, their_ids in self.levels:
            for lo in range(0, len(theirs), 1 << 18):
                part = self._keys(other, theirs[lo : lo + (1 << 18)])
                a, b = np.searchsorted(keys, part[0], "left"), np.searchsorted(keys, part[-1], "right")
                at = np.minimum(np.searchsorted(part, keys[a:b]), len(part) - 1)
                met = part[at] == keys[a:b]
                self.found.append(ids[a:b][met])
                # of equal windows in a level the first is met; if there are more, all were found when they met
                self.found.append(their_ids[lo : lo + (1 << 18)][np.unique(at[met])])
        self.levels.append((text, starts, ids))
        while len(self.levels) > 1 and 2 * len(self.levels[-1][1]) > len(self.levels[-2][1]):
            self._merge()

    def _merge(self) -> None:
        """The two last levels become one, in one pass over both sorted orders."""
        (ta, sa, ia), (tb, sb, ib) = self.levels[-2], self.levels[-1]
        at = np.zeros(len(sb), np.int64)
        kb = self._keys(tb, sb)
        for lo in range(0, len(sa), 1 << 18):
            at += np.searchsorted(self._keys(ta, sa[lo : lo + (1 << 18)]), kb)
        where = at + np.arange(len(sb))
        rest = np.ones(len(sa) + len(sb), bool)
        rest[where] = False
        starts, ids = np.empty(len(rest), np.int64), np.empty(len(rest), np.int64)
        starts[where], ids[where] = sb + len(ta), ib
        starts[rest], ids[rest] = sa, ia
        self.levels[-2:] = [(np.concatenate([ta, tb]), starts, ids)]


_SAMPLE = "key bigint, ah bigint, ch bigint, first int, windows int, place int"
_RUN = "ah bigint, ch bigint, n bigint, windows int, body binary"
_MATCH = "ah bigint, ch bigint, spans array<int>"
#: Windows of one batch of a shard, windows of a shard, about, and distinct runs of a gram that one shard takes.
BATCH, SHARD, MOST_RUNS = 200_000, 600_000, 20_000
#: Bytes of a text, whose places have to fit their bits.
LONGEST = 1 << 28


def _sampling(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for lo, hi, data, offsets in slices(batch, "text"):
                if np.diff(offsets).max(initial=0) >= LONGEST:
                    raise ValueError(f"a text of {LONGEST} bytes or more; split it first")
                s = samples(data, offsets, length)
                cols = [pa.array(keys[lo:hi][s["doc"]]), pa.array(s["ah"]), pa.array(s["ch"]), *(pa.array(s[c].astype(np.int32)) for c in ("first", "windows", "place"))]
                yield pa.RecordBatch.from_arrays(cols, ["key", "ah", "ch", "first", "windows", "place"])

    return run


def _cutting(length: int):
    """The bytes of the runs that a document lends: rows of (key, text, runs).  Of repeated rows, which follow each other, one lends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys = batch.column("key").to_numpy()
            new = np.append(last is None or keys[0] != last, keys[1:] != keys[:-1]) if len(keys) else np.empty(0, bool)
            last = keys[-1] if len(keys) else last
            batch = batch.filter(pa.array(new))
            if not batch.num_rows:
                continue
            data, offsets = buffers(batch.column("text"))
            runs = batch.column("runs")
            owner = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
            flat = runs.flatten()
            f = {x.name: flat.field(x.name) for x in flat.type}
            lo = offsets[owner] + f["first"].to_numpy()
            size = f["windows"].to_numpy().astype(np.int64) + length - 1
            for i in range(0, len(lo), 20_000):
                at, _ = expand(lo[i : i + 20_000], size[i : i + 20_000])
                ends = np.append(0, np.cumsum(size[i : i + 20_000])).astype(np.int32)
                body = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[at]))])
                yield pa.RecordBatch.from_arrays([*(f[c][i : i + 20_000] for c in ("ah", "ch", "n", "windows")), body], ["ah", "ch", "n", "windows", "body"])

    return run


def _unique_runs(batch: pa.RecordBatch, seen: set) -> np.ndarray:
    own = []
    for i, k in enumerate(zip(batch.column("ah").to_pylist(), batch.column("ch").to_pylist(), strict=True)):
        if k not in seen:
            seen.add(k)
            own.append(i)
    return np.array(own, np.int64)


def _matching(length: int):
    """One shard: runs in batches into a family of suffix arrays; the spans of matched windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, seen = SuffixLevels(length), set()
        ah, ch, n, windows = [], [], [], []
        base = 0

        def feed(text, starts, ids):
            for lo in range(0, len(starts), BATCH):
                s = starts[lo : lo + BATCH]
                levels.add(text[s[0] : s[-1] + length], s - s[0], ids[lo : lo + BATCH])

        for batch in batches:
            own = _unique_runs(batch, seen)
            if not len(own):
                continue
            batch = batch.take(pa.array(own))
            data, offsets = buffers(batch.column("body"))
            w = batch.column("windows").to_numpy().astype(np.int64)
            starts, owner = expand(offsets[:-1], w)
            feed(data, starts, ((owner + base) << 20) | (starts - offsets[owner]))
            base += len(own)
            for out, c in ((ah, "ah"), (ch, "ch"), (n, "n"), (windows, "windows")):
                out.append(batch.column(c).to_numpy())
        if not base:
            return
        found = np.unique(np.concatenate(levels.found))
        ah, ch, n, windows = map(np.concatenate, (ah, ch, n, windows))
        found = found[n[found >> 20] == 1]
        first = np.flatnonzero(np.diff(found, prepend=-2) != 1)
        last = np.append(first[1:], len(found))[: len(first)] - 1
        spans: list[list[int]] = [[0, int(w)] if k > 1 else [] for k, w in zip(n, windows, strict=True)]
        for a, b in zip(found[first].tolist(), found[last].tolist(), strict=True):
            spans[a >> 20] += [a & 0xFFFFF, (b & 0xFFFFF) + 1]
        some = np.array([bool(x) for x in spans])
        yield pa.RecordBatch.from_arrays([pa.array(ah[some]), pa.array(ch[some]), pa.array([x for x in spans if x], pa.list_(pa.int32()))], ["ah", "ch", "spans"])

    return run


def _hashing(length: int):
    """(ah, ch, i, w1, w2): the hash of each window of a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("body"))
            q, inverse = _powers(len(data))
            starts, owner = expand(offsets[:-1], batch.column("windows").to_numpy().astype(np.int64))
            both = []
            for table in (_TABLE, mix64(_TABLE)):
                total = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(table[data] * q[: len(data)], out=total[1:])
                both.append(pa.array(mix64((total[starts + length] - total[starts]) * inverse[starts]).view(np.int64)))
            ah, ch = (pa.array(batch.column(c).to_numpy()[owner]) for c in ("ah", "ch"))
            yield pa.RecordBatch.from_arrays([ah, ch, pa.array((starts - offsets[owner]).astype(np.int32)), *both], ["ah", "ch", "i", "w1", "w2"])

    return run


def _removing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, removed, runs, size = [], [], [], []
        for text, spans in zip(pa.compute.cast(batch.column("text"), pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            text = text or b""
            out, at, gone, count = [], 0, 0, 0
            for x in sorted(spans or (), key=lambda x: x["a"]):
                a, b = x["a"], x["b"]
                if a > at or not count:
                    count += 1
                    out.append(text[at:a])
                if b > at:
                    gone += b - max(a, at)
                    at = b
            out.append(text[at:])
            kept.append(b"".join(out))
            removed.append(gone)
            runs.append(count)
            size.append(len(text))
        cols = [batch.column("doc"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, most_runs: int = MOST_RUNS) -> DataFrame:
    """(key, a, b): byte ranges of the documents (key, text) that repeated strings cover."""
    found = materialise(docs.mapInArrow(given_back(_sampling(length)), _SAMPLE), "samples")
    by_gram = found.groupBy("ah").agg(F.count("*").alias("c"), F.min("ch").alias("lo"), F.max("ch").alias("hi")).filter("c > 1")
    by_gram = materialise(by_gram.select("ah", (F.col("lo") != F.col("hi")).alias("mixed")), "grams")  # a table, so that the join can split a hot gram
    shared = materialise(found.join(by_gram, "ah"), "shared")
    runs = shared.filter("mixed").groupBy("ah", "ch").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "windows")).alias("one"))
    runs = materialise(runs.select("ah", "ch", "n", "one.*"), "runs")
    lent = runs.groupBy("key").agg(F.collect_list(F.struct("ah", "ch", "n", "first", "windows")).alias("runs"))
    bodies = materialise(docs.join(lent, "key").select("key", "text", "runs").mapInArrow(given_back(_cutting(length)), _RUN), "bodies")
    hot = runs.groupBy("ah").count().filter(F.col("count") > most_runs).select("ah")
    shards = max(1, math.ceil((runs.agg(F.sum("windows")).first()[0] or 0) / SHARD))
    light = bodies.join(hot, "ah", "left_anti").repartition(shards, "ah").mapInArrow(given_back(_matching(length)), _MATCH)
    heavy = bodies.join(hot, "ah", "left_semi")
    hashed = heavy.mapInArrow(_hashing(length), "ah bigint, ch bigint, i int, w1 bigint, w2 bigint")
    single = hashed.groupBy("w1", "w2").agg(F.min(F.struct("ah", "ch", "i")).alias("x"), F.max(F.struct("ah", "ch", "i")).alias("y")).filter("x <> y").select("w1", "w2")
    met = hashed.join(single, ["w1", "w2"]).select("ah", "ch", F.array(F.col("i"), F.col("i") + 1).alias("spans"))
    whole = heavy.filter("n > 1").select("ah", "ch", F.array(F.lit(0), F.col("windows")).alias("spans"))
    matched = light.unionAll(met.unionAll(whole).distinct())
    part = shared.filter("mixed").join(matched, ["ah", "ch"]).select("key", "first", F.explode(F.sequence(F.lit(1), (F.size("spans") / 2).cast("int"))).alias("k"), "spans")
    part = part.select("key", (F.col("first") + F.element_at("spans", 2 * F.col("k") - 1)).alias("a"), (F.col("first") + F.element_at("spans", 2 * F.col("k")) + length - 1).alias("b"))
    full = shared.filter("NOT mixed").select("key", F.col("first").alias("a"), (F.col("first") + F.col("windows") + length - 1).alias("b"))
    return full.unionAll(part)


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most_runs: int = MOST_RUNS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs``.

    A byte goes if some ``length``-byte string that covers it also starts elsewhere, in the same text
    or another, all judged on the input.  Null and empty texts: no bytes, kept b''.  ``kept`` is binary,
    as a cut may fall inside a character.  Repeated rows are copies, so their long strings go in all of
    them.  Only the id and the text are read.  A text of ``LONGEST`` bytes or more raises ValueError.
    """
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    spans = repeated_spans(rows.select("key", "text"), length, most_runs).groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    kind = docs.schema[id_col].dataType.simpleString()
    joined = rows.join(spans, "key", "left").select("doc", "text", "spans")
    return joined.mapInArrow(_removing, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` that 200-byte strings repeat."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).drop("kept")
