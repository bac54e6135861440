"""Benchmark decontamination by a positional inverted index over the training texts.

The index is partitioned by documents: each of its rows is a shard with the postings of all words of
some documents, so building and searching it need no exchange and one hot source or word cannot
fill one task with other shards' postings.  A search for exact phrases takes each distinct test phrase, walks the
posting list of the phrase's rarest word in the shard, and intersects it with the lists of the other
words, rarest first, each shifted by the word's offset in the phrase; a proximity search looks how near the other
words stand on either side instead.  The benchmark travels to the
executors in blocks of a fixed size; what a shard returns are hit ranges and item ids, so that any
number of blocks can be merged.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.native import row_key
from skein.llm.store import arrow_batches, given_back, materialise
from skein.llm.textcols import ALNUM, LOWER, buffers, expand, word_ids, words

WINDOW = 10
#: Distinct phrases that are broadcast at once: about 100 MB of them at most.
BLOCK = 200_000
#: Places that one step of an intersection looks at.
STEP = 2_000_000
#: Bytes of text in a shard, or one text if that is longer.
SHARD_BYTES = 8 << 20
SHARD = "doc_ids array<bigint>, keys array<bigint>, row_keys array<bigint>, ptr binary, terms array<binary>, counts binary, postings binary"
_HITS = "doc bigint, key bigint, row_key bigint, n_words bigint, spans array<int>, items array<bigint>"


def _pack(positions: np.ndarray, counts: np.ndarray) -> bytes:
    """Gaps of each term's ascending positions, byte planes apart, so that they compress."""
    gaps = np.diff(positions, prepend=0).astype(np.int64)
    first = (np.cumsum(counts) - counts)[counts > 0]
    gaps[first] = positions[first]
    return np.ascontiguousarray(gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(raw: bytes, counts: np.ndarray) -> np.ndarray:
    gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    total = np.cumsum(gaps)
    first = np.cumsum(counts) - counts
    base = np.where(first > 0, total[np.maximum(first, 1) - 1], 0)
    return total - np.repeat(base, counts)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``SHARD_BYTES`` of text at most, whatever the session's batches are."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SHARD_BYTES, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _portions(batches):
        data, offsets = buffers(batch.column("text"))
        data = LOWER[data]
        start, end, ptr = words(data, offsets, ALNUM)
        ids, terms = word_ids(data, start, end)
        order = np.argsort(ids, kind="stable")
        counts = np.bincount(ids, minlength=len(terms))
        row = {
            "doc_ids": [batch.column("doc").to_pylist()], "keys": [batch.column("key").to_pylist()], "row_keys": [batch.column("row_key").to_pylist()], "ptr": [ptr.astype("<i8").tobytes()],
            "terms": [pc.cast(terms, pa.binary())], "counts": [counts.astype("<i8").tobytes()], "postings": [_pack(order, counts)],
        }
        kinds = {"doc_ids": pa.list_(pa.int64()), "keys": pa.list_(pa.int64()), "row_keys": pa.list_(pa.int64()), "ptr": pa.binary(), "terms": pa.list_(pa.binary()), "counts": pa.binary(), "postings": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array([v.to_pylist() if isinstance(v, pa.Array) else v for v in row[k]], t) for k, t in kinds.items()], list(kinds))


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: one row for each shard of documents, with all postings of all words."""
    arrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.monotonically_increasing_id().alias("key"), row_key(F.col(id_col), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    return materialise(rows.mapInArrow(given_back(_shards), SHARD), "postings", large_rows=True)


class Shard:
    """One row of the index, opened for searching."""

    def __init__(self, row: dict):
        self.docs, self.keys, self.row_keys = row["doc_ids"], row["keys"], row["row_keys"]
        self.ptr = np.frombuffer(row["ptr"], "<i8")
        self.terms = row["terms"]
        counts = np.frombuffer(row["counts"], "<i8")
        self.counts = counts
        self.first = np.cumsum(counts) - counts
        self.positions = _unpack(row["postings"], counts)
        #: Sorted (term, position), where one binary search tells whether a list holds a position.
        self.places = (np.repeat(np.arange(len(counts), dtype=np.int64), counts) << 40) | self.positions

    def lookup(self, vocabulary: pa.Array) -> np.ndarray:
        found = pc.index_in(vocabulary, value_set=self.terms)
        return pc.fill_null(found, -1).to_numpy().astype(np.int64)

    def phrases(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrase, start) of each occurrence of the phrases, rows of term ids of one length."""
        alive = np.flatnonzero((ids >= 0).all(axis=1))
        if not len(alive):
            return
        terms = ids[alive]
        k = terms.shape[1]
        size = self.counts[terms]
        rank = np.argsort(size, axis=1, kind="stable")
        cost = size[np.arange(len(alive)), rank[:, 0]]
        ends = np.cumsum(cost)
        lo = 0
        while lo < len(alive):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, "right")))
            t, r = terms[lo:hi], rank[lo:hi]
            anchor = t[np.arange(hi - lo), r[:, 0]]
            at, owner = expand(self.first[anchor], self.counts[anchor])
            start = self.positions[at] - r[owner, 0]
            ok = start >= 0
            start, owner = start[ok], owner[ok]
            for j in range(1, k):
                if not len(start):
                    break
                off = r[owner, j]
                want = (t[owner, off] << 40) | (start + off)
                i = np.minimum(np.searchsorted(self.places, want), len(self.places) - 1)
                ok = self.places[i] == want
                start, owner = start[ok], owner[ok]
            if len(start):
                ok = np.searchsorted(self.ptr, start, "right") == np.searchsorted(self.ptr, start + k - 1, "right")
                yield alive[lo:hi][owner[ok]], start[ok]
            lo = hi

    def near(self, ids: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(phrase, start, stop): around each occurrence of a phrase's rarest word the shortest span of at most ``width`` words of one document that holds all the phrase's words, in any order; the first of equals."""
        alive = np.flatnonzero((ids >= 0).all(axis=1))
        if not len(alive):
            return
        terms = ids[alive]
        rank = np.argsort(self.counts[terms], axis=1, kind="stable")
        terms = np.take_along_axis(terms, rank, 1)
        ends = np.cumsum(self.counts[terms[:, 0]])
        lo = 0
        while lo < len(alive):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP // 8, "right")))
            t = terms[lo:hi]
            at, owner = expand(self.first[t[:, 0]], self.counts[t[:, 0]])
            at = self.positions[at]
            doc = np.searchsorted(self.ptr, at, "right")
            before, after = np.minimum(at - self.ptr[doc - 1], width), np.minimum(self.ptr[doc] - at, width)
            left, right = np.zeros((0, len(at)), np.int64), np.zeros((0, len(at)), np.int64)
            for j in range(1, t.shape[1]):  # how far the nearest occurrence of each other word is on either side
                want = (t[owner, j] << 40) | at
                i = np.searchsorted(self.places, want)
                y = self.places[np.minimum(i, len(self.places) - 1)] - want
                y = np.where((y >= 0) & (y < after), y, width)
                i = np.searchsorted(self.places, want, "right") - 1
                x = want - self.places[np.maximum(i, 0)]
                x = np.where((x >= 0) & (x <= before) & (i >= 0), x, width)
                ok = np.minimum(x, y) < width
                left, right = np.vstack([left[:, ok], x[ok]]), np.vstack([right[:, ok], y[ok]])
                at, owner, before, after = at[ok], owner[ok], before[ok], after[ok]
                if not len(at):
                    break
            size, start = np.full(len(at), width + 1), np.zeros(len(at), np.int64)
            for x in range(width if len(at) else 0):
                beyond = np.where(left <= x, 0, right).max(axis=0, initial=0)
                shorter = (x + beyond + 1 <= size) & (x + beyond < width)
                size[shorter], start[shorter] = (x + beyond + 1)[shorter], at[shorter] - x
            ok = size <= width
            if ok.any():
                yield alive[lo:hi][owner[ok]], start[ok], (start + size)[ok]
            lo = hi


def phrase_blocks(items: list[tuple[int, str | None]], window: int = WINDOW, block: int = BLOCK) -> Iterator[dict]:
    """Distinct windows of the items in blocks: {vocabulary, by_length: {k: (term rows, item lists)}}."""
    owners: dict[tuple, list[int]] = defaultdict(list)

    def packed() -> dict:
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for p in owners for w in p))}
        lengths = sorted({len(p) for p in owners})
        return {
            "vocabulary": pa.array(vocabulary, pa.binary()),
            "by_length": {k: (np.array([[vocabulary[w] for w in p] for p in owners if len(p) == k]), [sorted(set(o)) for p, o in owners.items() if len(p) == k]) for k in lengths},
        }

    for item, text in items:
        data, offsets = buffers(pa.array([text], pa.large_string()))
        data = LOWER[data]
        raw = data.tobytes()
        start, end, _ = words(data, offsets, ALNUM)
        own = [raw[a:b] for a, b in zip(start, end, strict=True)]
        for i in range(max(1, len(own) - window + 1) if own else 0):
            owners[tuple(own[i : i + window])].append(item)
            if len(owners) >= block:
                yield packed()
                owners.clear()
    if owners:
        yield packed()


def search(index: DataFrame, items: DataFrame, *, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Exact phrase matches: (doc, key, n_words, spans, items) for each document.

    ``spans`` are hit ranges (from, to, from, to ...) in words, ``items`` the items with a window
    in the document.  Items stream to the driver and leave it in blocks of ``block`` windows.
    """
    found, blocks = _in_blocks(index, items, item_col, text_col, window, block, _searcher, _HITS)
    if blocks == 1:
        return found
    joined = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items")]
    return found.groupBy("key").agg(F.first("doc").alias("doc"), F.first("row_key").alias("row_key"), F.first("n_words").alias("n_words"), *joined)


def _in_blocks(index: DataFrame, items: DataFrame, item_col: str, text_col: str, window: int, block: int, task, kinds: str) -> tuple[DataFrame, int]:
    """(what ``task`` finds for all blocks of windows, their number); two blocks at most are held, and each of several is searched before the next is made."""
    spark = index.sparkSession
    rows = ((r[0], r[1]) for r in items.select(F.col(item_col).cast("bigint"), text_col).toLocalIterator())
    blocks = phrase_blocks(rows, window, block)
    one = next(blocks, {"vocabulary": pa.array([], pa.binary()), "by_length": {}})
    other = next(blocks, None)
    if other is None:
        return index.mapInArrow(task(spark.sparkContext.broadcast(one)), kinds), 1
    found, n = None, 0
    while one is not None:
        sent = spark.sparkContext.broadcast(one)
        part = materialise(index.mapInArrow(task(sent), kinds), "hits")
        sent.destroy()
        found, n = part if found is None else found.unionAll(part), n + 1
        one, other = other, next(blocks, None)
    return found, n


def near_matches(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, width: int = 2 * WINDOW, block: int = BLOCK
) -> DataFrame:
    """Proximity matches: (doc_id, row_key, item_id, start, stop).

    A row for each document and item of which some window (``window`` consecutive words, or the whole of
    a shorter item) has all its words, in any order, within ``width`` consecutive words of the document:
    the shortest such span in words, the first of equals.  So a passage with words put in or moved is
    found that has no exact window left.  Null and empty texts have no words; repeated rows have a row
    each; null item ids are left out.  Other columns are not read.
    """
    index = build_index(docs, id_col=id_col, text_col=text_col)
    wanted = benchmark.filter(F.col(item_col).isNotNull()).select(item_col, text_col)
    found, _ = _in_blocks(index, wanted, item_col, text_col, window, block, lambda sent: _near_searcher(sent, width), "key bigint, doc bigint, row_key bigint, item bigint, start bigint, stop bigint")
    best = found.groupBy("key", "item").agg(F.first("doc").alias("doc"), F.first("row_key").alias("row_key"), F.min(F.struct((F.col("stop") - F.col("start")).alias("n"), "start", "stop")).alias("m"))
    return best.select(F.col("doc").alias("doc_id"), "row_key", F.col("item").alias("item_id"), "m.start", "m.stop")


def _near_searcher(block, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _opened(batches):
            ids = shard.lookup(block.value["vocabulary"])
            out = []
            for rows, owners in block.value["by_length"].values():
                size = np.array([len(o) for o in owners])
                flat = np.array([x for o in owners for x in o])
                for phrase, start, stop in shard.near(ids[rows], width):
                    at, who = expand((np.cumsum(size) - size)[phrase], size[phrase])
                    out.append(np.stack([flat[at], start[who], stop[who]]))
            if out:
                item, start, stop = np.concatenate(out, axis=1)
                doc = np.searchsorted(shard.ptr, start, "right") - 1
                order = np.lexsort((start, stop - start, item, doc))
                first = np.flatnonzero((np.diff(doc[order], prepend=-1) != 0) | (np.diff(item[order], prepend=item[order][:1] - 1) != 0))
                own = order[first]
                doc = doc[own]
                cols = [np.array(shard.keys)[doc], pa.array(shard.docs, pa.int64()).take(pa.array(doc)), np.array(shard.row_keys)[doc], item[own], start[own] - shard.ptr[doc], stop[own] - shard.ptr[doc]]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], ["key", "doc", "row_key", "item", "start", "stop"])

    return given_back(run)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i] for n in batch.schema.names}
            yield Shard({n: v.values if n == "terms" else v.as_py() for n, v in row.items()})


def _searcher(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _opened(batches):
            yield _hits(shard, block.value)

    return given_back(run)


def _hits(shard: Shard, block: dict) -> pa.RecordBatch:
    n_docs, n_words = len(shard.docs), int(shard.ptr[-1])
    delta = np.zeros(n_words + 1, np.int32)
    pairs = []
    ids = shard.lookup(block["vocabulary"])
    for k, (rows, owners) in block["by_length"].items():
        size = np.array([len(o) for o in owners])
        flat = np.array([x for o in owners for x in o])
        for phrase, start in shard.phrases(ids[rows]):
            np.add.at(delta, start, 1)
            np.add.at(delta, start + k, -1)
            doc = np.searchsorted(shard.ptr, start, "right") - 1
            met = np.unique(np.stack([doc, phrase]), axis=1)
            at, who = expand((np.cumsum(size) - size)[met[1]], size[met[1]])
            pairs.append(np.stack([met[0][who], flat[at]]))
    hit = np.zeros(n_words + 2, np.int8)
    hit[1:-1] = np.cumsum(delta[:-1]) > 0
    # a document's edges end spans too
    up, down = hit[1:-1] & ~hit[:-2] & 1, hit[1:-1] & ~hit[2:] & 1
    full = shard.ptr[:-1] < shard.ptr[1:]
    a, b = shard.ptr[:-1][full], shard.ptr[1:][full] - 1
    up[a], down[b] = hit[1:-1][a], hit[1:-1][b]
    lo, hi = np.flatnonzero(up), np.flatnonzero(down) + 1
    doc = np.searchsorted(shard.ptr, lo, "right") - 1
    spans: list[list[int]] = [[] for _ in range(n_docs)]
    for d, x, y in zip(doc.tolist(), lo - shard.ptr[doc], hi - shard.ptr[doc], strict=True):
        spans[d] += [int(x), int(y)]
    items: list[list[int]] = [[] for _ in range(n_docs)]
    if pairs:
        for d, x in np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist():
            items[d].append(x)
    return pa.RecordBatch.from_arrays(
        [pa.array(shard.docs, pa.int64()), pa.array(shard.keys, pa.int64()), pa.array(shard.row_keys, pa.int64()), pa.array(np.diff(shard.ptr), pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))],
        ["doc", "key", "row_key", "n_words", "spans", "items"],
    )


def _merged(spans: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [_merged(x) for x in batch.column("spans").to_pylist()]
        items = [sorted(map(str, set(x))) for x in batch.column("items").to_pylist()]
        hit = [sum(x[1::2]) - sum(x[::2]) for x in spans]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(map(len, items), pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([x > 0 for x in hit]), pa.array(spans, pa.list_(pa.int32())), batch.column("row_key"),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "row_key"],
        )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, row_key).

    Null and empty texts have no words and no hits; null and empty items have no windows; an item of
    fewer words than ``window`` is one window.  Repeated rows of either table are judged alike; items
    that share a text all count; null item ids are left out.  Other columns are not read.
    """
    index = build_index(docs, id_col=id_col, text_col=text_col)
    found = search(index, benchmark.filter(F.col(item_col).isNotNull()).select(item_col, text_col), item_col=item_col, text_col=text_col, window=window, block=block)
    kinds = "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, spans array<int>, row_key bigint"
    return found.select("doc", "row_key", "n_words", "spans", "items").mapInArrow(given_back(_finish), kinds)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Exact benchmark windows in all rows of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate(docs, bench).drop("spans", "row_key")


def op2_near_matches(spark, sf_dir: str) -> DataFrame:
    """Proximity matches of benchmark windows in all rows of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")).drop("row_key")


OP2_SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: list_slice(w, i, i + 9))) AS ph FROM b WHERE len(w) > 0),
d AS (SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM documents),
ks AS (SELECT DISTINCT len(ph) AS k FROM win),
g AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS s, unnest(list_transform(range(1, len(w) - k + 2), lambda i: hash(array_to_string(list_slice(w, i, i + k - 1), ' ')))) AS h FROM d, ks WHERE len(w) >= k),
wh AS (SELECT item_id, len(ph) AS k, hash(array_to_string(ph, ' ')) AS h FROM win),
m AS (SELECT DISTINCT g.doc_id, g.s, g.k, wh.item_id FROM g JOIN wh ON g.k = wh.k AND g.h = wh.h),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""
