"""Cross-tokenizer alignment: which tokens of two vocabularies stand for each other.

Each text is encoded by a byte-level BPE (A) and a piece BPE (B).  Their tokens tile the same bytes, so
the ends of both cut a text into pieces that belong to one A and one B token each: the links.  Tasks
gather the links of a block of texts by stripe, a range of A ids, and store them packed.  The numbers
of documents of id pairs are counted stripe by stripe in a dense matrix of A ids by B ids, into
which partial counts are added with ``np.add.at``; row maxima give each A id's best partners.  The
counts then meet the stored links in the same stripes, and each block's scores are added up.

A stripe whose links are large is dealt out in several parts with a copy of its counts, so a token that
all texts use is no single task.  Memory is bounded by a block of texts (or the longest text), a stripe's matrix and
its non-zero cells.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.store import arrow_batches, given_back, materialise
from skein.llm.textcols import buffers

FOLDER = "/opt/tokenizers"
#: A session may name other files here.
A_CONF, B_CONF = "spark.skein.alignment.a", "spark.skein.alignment.b"
#: A ids of a stripe; ids of a vocabulary at most; bytes of text in a block; cells in a row of counts.
STRIPE, IDS, BLOCK, CELLS = 256, 1 << 16, 4 << 20, 1 << 20
#: Packed bytes of a stripe's links that go to one part.
PART = 32 << 20
#: The pattern by which the byte-level vocabulary splits text before its merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LINKS = "block bigint, stripe int, links binary"
_DIGEST = "idx int, doc_id {}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
_CODEC = pa.Codec("zstd", compression_level=1)


def _byte_of_char() -> dict[str, int]:
    """Byte-level alphabets: printable bytes stand for themselves, the others for U+0100 and on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Sides:
    """Both encoders, with the bytes of every token."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece

        self.a_file = a_file
        spec = json.loads(a_file)
        to_byte = _byte_of_char()
        vocab = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec["added_tokens"] if not x["special"]}
        ranks = {bytes(map(to_byte.__getitem__, t)): i for t, i in vocab.items()}
        merges = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        self._ranked = ranks if merges == sorted(merges) and spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} else None
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        pieces = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.bytes_a = np.full(max(ranks.values()) + 1, b"", object)
        self.bytes_a[list(ranks.values())] = list(ranks)
        self.bytes_b = np.array(pieces, object)
        if max(len(self.bytes_a), len(self.bytes_b)) > IDS:
            raise ValueError(f"a vocabulary has more than {IDS} ids")
        self.size_a, self.size_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        #: Decimal ids with what follows them: ',' in a side, '|' between sides, ';' between groups, nothing at the end.
        self.digits = np.array([f"{i}{s}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for s in (",", "|", ";", "")], object)

    @functools.cached_property
    def _quick(self):
        """The same vocabulary as ranks, if ids follow the order of merges: faster, with the same ids."""
        import tiktoken

        return self._ranked and tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=self._ranked, special_tokens={})

    @functools.cached_property
    def _plain(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_buffer(self.a_file)
        made.encode_special_tokens = True
        return made

    def encode_a(self, text: str) -> np.ndarray:
        if self._quick:
            try:
                return self._quick.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            except BaseException as e:  # noqa: BLE001  its pattern's stack is too small for a very long run of white space
                if type(e).__name__ != "PanicException":
                    raise
        return np.array(self._plain.encode(text, add_special_tokens=False).ids, np.int64)

    def encode_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]


@functools.lru_cache(maxsize=1)
def _sides(a_file: bytes, b_file: bytes) -> Sides:
    """Built once a worker."""
    return Sides(a_file, b_file)


def _packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, compressed: high bytes are mostly zero."""
    raw = b"".join(np.ascontiguousarray(a.astype(np.int64)).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays)
    return np.array([len(arrays), *map(len, arrays)], np.int64).tobytes() + _CODEC.compress(raw, asbytes=True)


def _unpacked(data: bytes) -> list[np.ndarray]:
    k = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, k, 8)
    raw = np.frombuffer(_CODEC.decompress(data[8 * (k + 1) :], int(sizes.sum()) * 8), np.uint8)
    at = np.concatenate([[0], np.cumsum(sizes)]) * 8
    return [np.ascontiguousarray(raw[lo:hi].reshape(8, -1).T).view(np.int64).ravel() for lo, hi in itertools.pairwise(at)]


def blocks_of(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(first, end) rows of neighbouring texts that have ``most`` bytes together, or are one text."""
    _, offsets = buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


class Aligned:
    """The tokens of some texts, their groups and links; all texts together, as ranges of one row of bytes."""

    def __init__(self, sides: Sides, texts: list[str | None]):
        n = len(texts)
        full = [i for i, t in enumerate(texts) if t]
        a = [sides.encode_a(" " + texts[i]) for i in full]
        b = sides.encode_b([texts[i] for i in full])
        good = []
        for k, i in enumerate(full):
            whole = (" " + texts[i]).encode()
            good.append(b"".join(sides.bytes_a[a[k]].tolist()) == whole == b"".join(sides.bytes_b[b[k]].tolist()))
        none = np.empty(0, np.int64)
        a, b = ([x for x, ok in zip(s, good, strict=True) if ok] for s in (a, b))
        #: The texts that have tokens, and the number of tokens of each.
        self.own = np.array([i for i, ok in zip(full, good, strict=True) if ok], np.int64)
        self.sides, self.n_a, self.n_b = sides, np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.n_a[self.own], self.n_b[self.own] = list(map(len, a)), list(map(len, b))
        self.a, self.b = np.concatenate([none, *a]), np.concatenate([none, *b])
        end_a, end_b = np.cumsum(sides.size_a[self.a]), np.cumsum(sides.size_b[self.b])
        size = int(end_a[-1]) + 1 if len(end_a) else 1
        in_a, in_b = np.zeros(size, bool), np.zeros(size, bool)
        in_a[end_a] = in_b[end_b] = True
        cuts = np.flatnonzero(in_a | in_b)
        cut_a, cut_b = in_a[cuts], in_b[cuts]
        #: Per link its A token, B token and group; per token its group.
        self.link_a, self.link_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        both = cut_a & cut_b
        group = np.cumsum(both) - both
        self.group_a, self.group_b = group[cut_a], group[cut_b]
        self.doc_of_a = np.repeat(self.own, self.n_a[self.own])
        self.link_doc = self.doc_of_a[self.link_a]
        self.n_links = np.bincount(self.link_doc, minlength=n)
        self.n_groups = np.bincount(self.link_doc[both], minlength=n)

    def groups(self) -> Iterator[tuple[int, str]]:
        """(text, its groups as `a1,a2|b1;a3|b2,b3`)."""
        last = lambda g: np.append(g[1:] != g[:-1], True)[: len(g)]
        # a group's A tokens come first, then its B tokens
        at_a = np.arange(len(self.a)) + np.searchsorted(self.group_b, self.group_a, "left")
        at_b = np.arange(len(self.b)) + np.searchsorted(self.group_a, self.group_b, "right")
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        codes[at_a] = self.a * 4 + last(self.group_a)
        codes[at_b] = self.b * 4 + 2 * last(self.group_b)
        ends = np.cumsum((self.n_a + self.n_b)[self.own])
        codes[ends - 1] += 1
        for i, lo, hi in zip(self.own.tolist(), ends - (self.n_a + self.n_b)[self.own], ends, strict=True):
            yield i, "".join(self.sides.digits[codes[lo:hi]].tolist())

    def stripes(self) -> Iterator[tuple[int, bytes]]:
        """(stripe, packed links): distinct pairs, the number of texts of each, those texts, and how often each has the pair."""
        pair = self.a[self.link_a] * IDS + self.b[self.link_b]
        key = np.sort(pair * len(self.n_a) + self.link_doc)
        first = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.diff(first, append=len(key))
        pair, doc = np.divmod(key[first], max(len(self.n_a), 1))
        stripe = pair // (STRIPE * IDS)
        edge = np.flatnonzero(np.diff(stripe, prepend=-1))
        for lo, hi in itertools.pairwise(np.append(edge, len(stripe))):
            start = np.flatnonzero(np.diff(pair[lo:hi], prepend=-1))
            yield int(stripe[lo]), _packed(pair[lo:hi][start] % (STRIPE * IDS), np.diff(start, append=hi - lo), doc[lo:hi], times[lo:hi])


def tokenizer_files(spark, a_file: str | None = None, b_file: str | None = None) -> tuple[bytes, bytes]:
    """Both vocabulary files, read where the driver runs."""
    a_file = a_file or spark.conf.get(A_CONF, f"{FOLDER}/byte_bpe_50k.json")
    b_file = b_file or spark.conf.get(B_CONF, f"{FOLDER}/piece_bpe_32k.model")
    with open(a_file, "rb") as a, open(b_file, "rb") as b:
        return a.read(), b.read()


def encoded(docs: DataFrame, files: tuple[bytes, bytes], id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """Stored blocks: a row for each text (``stripe`` null) and one for each stripe of a block's links."""
    spark = docs.sparkSession
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast(files)
    kind = docs.schema[id_col].dataType
    schema = f"{_LINKS}, {_DIGEST.format(kind.simpleString())}, groups string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for lo, hi in blocks_of(batch.column(1)):
                block, part = next(numbers), batch.slice(lo, hi - lo)
                done = Aligned(_sides(*sent.value), part.column(1).to_pylist())
                digest, text = [""] * len(part), [""] * len(part)
                for i, s in done.groups():
                    digest[i] = hashlib.sha256(s.encode()).hexdigest()
                    text[i] = s if with_groups else ""
                n = pa.nulls(len(part))
                rows = [pa.array([block] * len(part)), n.cast(pa.int32()), n.cast(pa.binary()), pa.array(np.arange(len(part), dtype=np.int32)), part.column(0)]
                rows += [pa.array(x, pa.int64()) for x in (done.n_a, done.n_b, done.n_groups, done.n_links)] + [pa.array(digest), pa.array(text)]
                yield pa.RecordBatch.from_arrays(rows, names)
                if stripes := list(done.stripes()):
                    n = pa.nulls(len(stripes))
                    links = [pa.array([block] * len(stripes)), pa.array([s for s, _ in stripes], pa.int32()), pa.array([x for _, x in stripes], pa.binary())]
                    links += [n.cast(t) for t in (pa.int32(), part.schema[0].type, *[pa.int64()] * 4, pa.string(), pa.string())]
                    yield pa.RecordBatch.from_arrays(links, names)

    return materialise(docs.select(id_col, text_col).mapInArrow(given_back(run), schema), "aligned")


def _parts(links: DataFrame) -> DataFrame:
    """(stripe, parts): over how many tasks a stripe is dealt; a row for each range of A ids."""
    size = F.sum(F.length("links").cast("long"))
    return links.groupBy("stripe").agg(F.greatest(F.lit(1), F.ceil(size / PART)).cast("int").alias("parts"))


def _dealt(links: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts`` has at most IDS / STRIPE rows."""
    return links.join(F.broadcast(parts), "stripe").withColumn("part", F.pmod(F.xxhash64("block"), F.col("parts")).cast("int"))


def _row(names: list[str], *values) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "links": pa.binary(), "cells": pa.binary(), "scores": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(n, pa.int32())) for n, v in zip(names, values, strict=True)], names)


def counted(links: DataFrame, width: int) -> DataFrame:
    """(stripe, cells): document counts of id pairs, as packed (pair, count, whether the most of its A id).

    Tasks first add up the pairs of the links they read; then a stripe's counts meet, in parts and at
    last in one dense matrix.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for stripe, found in sums.items():
                pair, at = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
                total = np.zeros(len(pair), np.int64)
                np.add.at(total, at, np.concatenate([c for _, c in found]))
                for lo in range(0, len(pair), CELLS):
                    yield _row(["stripe", "part", "cells"], stripe, part_of, _packed(pair[lo : lo + CELLS], total[lo : lo + CELLS]))
            sums.clear()

        part_of = TaskContext.get().partitionId()
        for batch in batches:
            for stripe, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pair, docs, _, _ = _unpacked(blob.as_py())
                sums.setdefault(stripe, []).append((pair, docs))
                held += len(pair)
                if held > 4 * CELLS:
                    yield from flush()
                    held = 0
        yield from flush()

    def dense(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come sorted by stripe and part; one matrix at a time."""
            now, block = None, None

            def done() -> Iterator[pa.RecordBatch]:
                best = block.max(axis=1)
                a, b = np.nonzero(block)
                count = block[a, b]
                for lo in range(0, len(a), CELLS):
                    own = slice(lo, lo + CELLS)
                    more = [count[own] == best[a[own]]] if last else []
                    yield _row(["stripe", "part", "cells"], now[0], 0, _packed(a[own] * IDS + b[own], count[own], *more))

            for batch in batches:
                for stripe, part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if (stripe, part) != now:
                        if now is not None:
                            yield from done()
                        now, block = (stripe, part), np.zeros((STRIPE, width), np.int64)
                    pair, count = _unpacked(blob.as_py())
                    np.add.at(block, (pair // IDS, pair % IDS), count)
            if now is not None:
                yield from done()

        return given_back(run)

    kind = "stripe int, part int, cells binary"
    parts = _parts(links)
    first = links.select("stripe", "links").mapInArrow(given_back(partial), kind)
    split = first.join(F.broadcast(parts), "stripe").select("stripe", F.pmod(F.xxhash64("part"), F.col("parts")).cast("int").alias("part"), "cells")
    split = split.repartition("stripe", "part").sortWithinPartitions("stripe", "part").mapInArrow(dense(False), kind)
    return split.repartition("stripe").sortWithinPartitions("stripe", "part").mapInArrow(dense(True), kind).drop("part")


def scored(links: DataFrame, cells: DataFrame) -> DataFrame:
    """(block, idx, n_best, count_sum): links and counts of a stripe meet in its tasks; a block's scores are then added up."""
    parts = _parts(links)
    copies = cells.join(F.broadcast(parts), "stripe").select("stripe", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("block"), F.col("cells").alias("data"))
    both = copies.unionAll(_dealt(links, parts).select("stripe", "part", "block", F.col("links").alias("data")))
    both = both.repartition("stripe", "part").sortWithinPartitions("stripe", "part", F.col("block").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stripe's counts come before its links."""
        now, found, table = None, [], None
        for batch in batches:
            for stripe, part, block, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if (stripe, part) != now:
                    now, found, table = (stripe, part), [], None
                if block is None:
                    found.append(_unpacked(blob.as_py()))
                    continue
                if table is None:
                    table = [np.concatenate(x) for x in zip(*found, strict=True)]
                    order = np.argsort(table[0])
                    table = [x[order] for x in table]
                pair, texts, doc, times = _unpacked(blob.as_py())
                at = np.searchsorted(table[0], pair)
                n = int(doc.max()) + 1
                best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
                np.add.at(best, doc, times * np.repeat(table[2][at], texts))
                np.add.at(total, doc, times * np.repeat(table[1][at], texts))
                own = np.flatnonzero(total)
                yield _row(["block", "scores"], block, _packed(own, best[own], total[own]))

    def added(key: tuple, table: pa.Table) -> pa.Table:
        idx, best, total = (np.concatenate(x) for x in zip(*(_unpacked(b.as_py()) for b in table["scores"]), strict=True))
        n = int(idx.max()) + 1
        sums = np.zeros((2, n), np.int64)
        np.add.at(sums[0], idx, best)
        np.add.at(sums[1], idx, total)
        return pa.table({"block": pa.array(np.full(n, key[0].as_py())), "idx": pa.array(np.arange(n, dtype=np.int32)), "n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])})

    parts_of = both.mapInArrow(given_back(run), "block bigint, scores binary")
    return parts_of.groupBy("block").applyInArrow(added, "block bigint, idx int, n_best bigint, count_sum bigint")


def _width(files: tuple[bytes, bytes]) -> int:
    return len(_sides(*files).bytes_b)


def pair_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str | None = None, b_file: str | None = None) -> DataFrame:
    """(a, b, docs, best): for each linked id pair its number of documents, and whether no other pair of its A id has more."""
    files = tokenizer_files(docs.sparkSession, a_file, b_file)
    cells = counted(encoded(docs, files, id_col, text_col).filter("stripe IS NOT NULL"), _width(files))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pair, count, best = _unpacked(blob.as_py())
                yield pa.RecordBatch.from_arrays([pa.array((stripe * STRIPE + pair // IDS).astype(np.int32)), pa.array((pair % IDS).astype(np.int32)), pa.array(count), pa.array(best.astype(bool))], ["a", "b", "docs", "best"])

    return cells.mapInArrow(run, "a int, b int, docs bigint, best boolean")


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str | None = None, b_file: str | None = None, with_groups: bool = False) -> DataFrame:
    """One row for each row of ``docs``: its numbers of tokens, groups and links, and how its links score in the corpus.

    Columns: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, and ``groups`` if
    asked for.  A null or empty text, or one that its tokens do not spell, has zeros and an empty
    digest.  Repeated rows, and different texts that share an id, are documents of their own, and each
    counts; equal counts are all best.  Other columns are not read, whatever their names; a null id stays null.  No
    rows: no rows.
    """
    files = tokenizer_files(docs.sparkSession, a_file, b_file)
    stored = encoded(docs, files, id_col, text_col, with_groups)
    links = stored.filter("stripe IS NOT NULL").select("block", "stripe", "links")
    scores = scored(links, materialise(counted(links, _width(files)), "counts"))
    rows = stored.filter("stripe IS NULL").drop("stripe", "links").join(scores, ["block", "idx"], "left")
    zero = F.lit(0).cast("long")
    more = ["groups"] if with_groups else []
    return rows.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", *more
    )


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    """The alignment of all whole texts of ``documents`` between the box's byte-level and piece vocabularies."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
