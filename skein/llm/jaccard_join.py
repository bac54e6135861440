"""N-gram Jaccard join: size-aware, heavy-light, over sets of five-word shingles.

Equal sets are one class from the start, and a task signs a class once, so exact copies cost a row each
and little more.  Between classes, two sets can only be similar if the beginnings of both, in one fixed
order of all shingles, meet: sets of up to ``boundary`` shingles enumerate the fixed-size subsets (pairs)
of a beginning, as several common shingles make few false candidates; larger sets use inverted lists of
single shingles, which are scanned and counted: with a beginning that is longer by k - 1, similar sets
meet in k lists.  Sets near the boundary do both.  The boundary minimises the cost estimated from the
histogram of set sizes.  The order puts shingles seen in many documents last, by powers of two of their
number; which ones those are changes only the cost, never the result, so that list is bounded.

An entry of a list knows its place in its set, so what two sets can still share is bounded, and pairs that
cannot reach the threshold are left out; so are pairs from long lists whose sets differ in more bits of a
parity bitmap than similar sets could.  A list of up to ``dense`` classes gives all its other pairs.  A
longer one would give a square of its size: it is dealt to tasks in parts, and each part's members are
compared to pivots, the members that have the list's shingle earliest.  After components are known, what
remains are the members outside a list's largest component; blocks of them are compared to blocks of
the whole list, across components only.  Every candidate is verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.components import components
from skein.llm.native import row_key
from skein.llm.store import arrow_batches, given_back, materialise
from skein.llm.textcols import LOWER, NOT_WHITE, buffers, expand, mix64, word_ids, words

WORDS, PERCENT = 5, 80
#: Shingles that the order puts last: the most frequent, at most so many (8 MB).
MOST_HOT = 1_000_000
#: A shingle is seen in many documents from here on, and the longest list that gives all pairs.
HOT_DOCS, DENSE = 16, 48
#: Shingles that are counted together while frequent ones are looked for; texts, and their bytes, that are hashed together.
CHUNK, TEXTS, TEXT_BYTES = 4_000_000, 500, 8 << 20
#: Pivots that a part of a long list has in each band of sizes, and the members a part has, about.
PIVOTS, PART = 2, 8192
#: Bits of the parity bitmap of a set that has frequent shingles.
BITS = 1024
#: Rows of lists that are paired together, and members of a block.
RUN_ROWS, BLOCK = 500_000, 1024
_BITS = np.uint64(50)
_LOW = np.uint64((1 << 50) - 1)
_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(doc, 50-bit shingle hash), distinct and ascending; at most ``TEXTS`` texts.

    Words end at ASCII white space, A-Z are lower-cased.  Fewer words than ``size``, but any: one
    shingle of the whole sequence.
    """
    data, offsets = buffers(column)
    data = LOWER[data]
    start, end, ptr = words(data, offsets, NOT_WHITE)
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    ids, terms = word_ids(data, start, end)
    hashes = pd.util.hash_array(np.array(terms.to_pylist() + [None], object)[:-1])[ids]
    count = np.diff(ptr)
    doc = np.repeat(np.arange(len(count)), count)
    rolled = np.zeros(len(hashes), np.uint64)
    for i in range(size):
        shifted = np.zeros_like(hashes)
        shifted[: len(hashes) - i] = hashes[i:]
        rolled = rolled * _P + shifted
    last = ptr[1:][doc] - np.arange(len(doc)) < size
    keep = ~last
    short = np.flatnonzero((count > 0) & (count < size))
    total = count[short].astype(np.uint64)
    for i in range(size - 1):
        more = count[short] > i
        total[more] = total[more] * _P + hashes[ptr[short[more]] + i]
    rolled[ptr[short]] = total
    keep[ptr[short]] = True
    key = np.unique((doc[keep].astype(np.uint64) << _BITS) | (mix64(rolled[keep]) & _LOW))
    return (key >> _BITS).astype(np.int64), key & _LOW


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``TEXTS`` texts and, but for a longer single text, ``TEXT_BYTES``."""
    for batch in batches:
        _, offsets = buffers(batch.column("text"))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(offsets, offsets[lo] + TEXT_BYTES, "right")) - 1
            hi = max(lo + 1, min(hi, lo + TEXTS))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _digests(doc: np.ndarray, shingle: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(class id, set size) of each document; the class id depends on the set alone."""
    size = np.bincount(doc, minlength=n)
    total = np.zeros(n + 1, np.uint64)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    if len(first):
        total[doc[first]] = np.add.reduceat(mix64(shingle + _P), first)
    return mix64(total[:n] + size.astype(np.uint64) * _P).astype(np.int64), size


def _classing(size: int):
    """Documents with their class, and shingles that a chunk of documents holds twice or more."""

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        kind, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
        kind, count = kind[count > 1], count[count > 1]
        none = pa.nulls(len(kind), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(kind.astype(np.int64)), pa.array(count.astype(np.int64))], ["doc", "key", "sid", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in _parts(batches):
            doc, shingle = shingle_sets(batch.column("text"), size)
            sid, n = _digests(doc, shingle, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("key"), pa.array(sid), pa.array(n.astype(np.int64))], ["doc", "key", "sid", "n"])
            held.append(shingle)
            total += len(shingle)
            if total > CHUNK:
                yield from counted(held)
                held, total = [], 0
        yield from counted(held)

    return given_back(run)


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Common shingles that a set of n has with any set that is similar to it."""
    return -(-percent * n // 100)


def meetings(n: np.ndarray) -> np.ndarray:
    """Lists of single shingles in which a set of n has to meet any larger one that is similar."""
    return 2 + n // 40


def _ordered(doc: np.ndarray, shingle: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's shingles in the fixed order, their power of two (0: not frequent) and rank; hot: (shingles, powers of two)."""
    late = np.zeros(len(shingle), np.uint64)
    if len(hot[0]):
        at = np.minimum(np.searchsorted(hot[0], shingle), len(hot[0]) - 1)
        late = np.where(hot[0][at] == shingle, hot[1][at], np.uint64(0))
    key = np.sort((doc.astype(np.uint64) << np.uint64(55)) | (late << _BITS) | shingle)
    first = np.searchsorted(doc, doc, "left")
    return key & _LOW, (key >> _BITS & np.uint64(31)).astype(np.int64), np.arange(len(doc)) - first


def least_common(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that similar sets of these sizes share at least."""
    return -(-percent * (a + b) // (100 + percent))


def _bitmaps(doc: np.ndarray, shingle: np.ndarray, own: np.ndarray, wanted: np.ndarray) -> pa.Array:
    """For each entry of document ``own``, the parity of the number of its shingles in each of ``BITS`` classes; empty unless wanted."""
    some, at = np.unique(own[wanted], return_inverse=True)
    ours = np.isin(doc, some)
    place = np.searchsorted(some, doc[ours]) * BITS + (mix64(shingle[ours]) % np.uint64(BITS)).astype(np.int64)
    odd = np.bincount(place, minlength=len(some) * BITS).reshape(-1, BITS) & 1
    packed = np.packbits(odd.astype(np.uint8), axis=1)[at]
    ends = np.append(0, np.cumsum(wanted * (BITS // 8))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(packed))])


def _alike(n: np.ndarray, m: np.ndarray, one: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m with these bitmaps (objects; empty: unknown) may be similar: they differ in no more shingles than bits."""
    out = np.ones(len(n), bool)
    size = BITS // 8
    known = np.flatnonzero(np.array([len(x) == size and len(y) == size for x, y in zip(one, other, strict=True)], bool))
    for lo in range(0, len(known), 65_536):
        at = known[lo : lo + 65_536]
        x, y = (np.frombuffer(b"".join(z[at]), np.uint64).reshape(len(at), -1) for z in (one, other))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= n[at] + m[at] - 2 * least_common(n[at], m[at], percent)
    return out


def _signing(hot, boundary: int, size: int, percent: int):
    """Entries of lists: (sig: the list, negative for pairs of shingles; part: of a long list, or -1; sid, n: the class and its size; pos: the place of the entry's last shingle; bits: of a list that may be long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[int] = set()
        for batch in _parts(batches):
            doc, shingle = shingle_sets(batch.column("text"), size)
            sid, n = _digests(doc, shingle, batch.num_rows)
            fresh = np.array([i for i, s in enumerate(sid.tolist()) if s not in signed and not signed.add(s)], np.int64)
            ours = np.isin(doc, fresh)
            shingle, late, rank = _ordered(doc[ours], shingle[ours], hot.value)
            doc = doc[ours]
            length = (n - needed(n, percent))[doc]
            single = (rank < length + meetings(n[doc])) & (n[doc] > boundary * percent // 100)
            front = (rank <= length + 1) & (n[doc] <= boundary)
            d, s, r, p = doc[front], shingle[front], rank[front], late[front]
            left = np.minimum(length + 1, n[doc] - 1)[front] - r
            j, i = expand(np.arange(len(d)) + 1, left)
            pair = mix64(s[i] * _P + s[j]) | np.uint64(1 << 63)
            sig = np.concatenate([shingle[single].astype(np.int64), pair.view(np.int64)])
            own = np.concatenate([doc[single], d[i]])
            pos = np.concatenate([rank[single], r[j]])
            power = np.concatenate([late[single], np.minimum(p[i], p[j])])
            parts = -(-(np.int64(2) << power) // PART)
            part = np.where(parts > 1, (mix64(sid[own].view(np.uint64)) % parts.astype(np.uint64)).astype(np.int64), -1)
            cols = [pa.array(sig), pa.array(part.astype(np.int32)), pa.array(sid[own]), pa.array(n[own].astype(np.int32)), pa.array(pos.astype(np.int32)), _bitmaps(doc, shingle, own, power > 0)]
            yield pa.RecordBatch.from_arrays(cols, ["sig", "part", "sid", "n", "pos", "bits"])

    return given_back(run)


def choose_boundary(sizes: list[tuple[int, int]], percent: int, row: float = 1.0, false: float = 0.5) -> int:
    """The set size up to which pairs of shingles are enumerated, from (size, number of sets).

    A row of either index costs ``row``; a single shingle's list holds ``false`` false candidates for
    each row, at ``row`` each, a pair's list none.
    """
    best, at = None, 0
    for b in sorted({0, *(s for s, _ in sizes)}):
        cost = 0.0
        for s, k in sizes:
            length = s - int(needed(np.int64(s), percent)) + 1
            if s <= b:
                cost += k * row * (length + 1) * length / 2
            if s > b * percent // 100:
                cost += k * row * length * (1 + false)
        if best is None or cost < best:
            best, at = cost, b
    return at


def _fits(sig: np.ndarray, n: np.ndarray, pos: np.ndarray, m: np.ndarray, at: np.ndarray, percent: int, boundary: int) -> np.ndarray:
    """Whether sets of sizes n and m that meet in a list, at these places, may be similar and are this list's business.

    A meeting that counts is one of the first k of two sets (two for pairs of shingles), so they share k
    shingles at most up to it, and none but later ones beyond.  ``np.minimum`` and the like broadcast.
    """
    small, large = np.minimum(n, m), np.maximum(n, m)
    met = np.where(sig < 0, 2, meetings(small))
    rest = np.minimum(n - pos, m - at) - 1
    return ((sig < 0) | (large > boundary)) & (100 * small >= percent * large) & (met + rest >= least_common(n, m, percent))


def _lists(batches: Iterator[pa.RecordBatch], dense: int) -> Iterator[tuple[dict[str, np.ndarray], bool, bool]]:
    """Entries without repeats as columns, sorted by list; whether their first list began, and their last one goes on, in another frame.

    Lists of up to ``dense`` rows are never cut; of a longer one, only what fits a frame is held.
    """
    held: dict[str, np.ndarray] = {}
    on, goal = False, RUN_ROWS
    for batch in batches:
        more = {c: batch.column(c).to_numpy(zero_copy_only=c != "bits") for c in ("sig", "part", "sid", "n", "pos", "bits")}
        held = {c: np.concatenate([held[c], more[c]]) for c in more} if held else more
        if len(held["sig"]) < goal:
            continue
        same = (held["sig"] == held["sig"][-1]) & (held["part"] == held["part"][-1])
        cut = int(np.argmax(same))
        within = len(same) - cut > dense + 1
        cut = len(same) - 1 if within else cut
        if cut:
            yield _once({c: x[:cut] for c, x in held.items()}), on, within
            held = {c: x[cut:] for c, x in held.items()}
            on = within
        goal = len(held["sig"]) + RUN_ROWS
    if held and len(held["sig"]):
        yield _once(held), on, False


def _once(frame: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    again = np.ones(len(frame["sig"]), bool)
    again[:1] = False
    for c in ("sig", "part", "sid"):
        again[1:] &= frame[c][1:] == frame[c][:-1]
    return {c: x[~again] for c, x in frame.items()}


def _pairing(percent: int, dense: int, boundary: int):
    """Candidates (a, b, n: meetings needed, c: meetings) and entries of long lists (a: the list, b: the class, n: its size, c: -1 - its place, bits).

    Pairs that share a long list need not be counted there: they are compared by its members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots: dict[int, list[tuple[int, int, int, bytes]]] = {}
        for frame, on, goes_on in _lists(batches, dense):
            sig, part, sid, n, pos, bits = (frame[c] for c in ("sig", "part", "sid", "n", "pos", "bits"))
            n, pos = n.astype(np.int64), pos.astype(np.int64)
            first = np.flatnonzero((np.diff(sig, prepend=sig[:1] - 1) != 0) | (np.diff(part, prepend=part[:1] - 1) != 0))
            count = np.diff(np.append(first, len(sig)))
            long = (count > dense) | (part[first] >= 0)
            long[0] |= on
            long[-1] |= goes_on
            some = (count > 1) & ~long
            member, _ = expand(first[some], count[some])
            until = np.repeat((first + count)[some], count[some])
            j, i = expand(member + 1, until - member - 1)
            i = member[i]
            ok = _fits(sig[i], n[i], pos[i], n[j], pos[j], percent, boundary)
            i, j = i[ok], j[ok]
            a, b = [sid[i]], [sid[j]]
            need = [np.where(sig[i] < 0, 1, meetings(np.minimum(n[i], n[j])))]
            band = np.floor(np.log(n) / np.log(100 / percent)).astype(np.int64)
            for k, (f, c) in enumerate(zip(first[long].tolist(), count[long].tolist(), strict=True)):
                if k or not on or f:
                    pivots = {}
                own = slice(f, f + c)
                for x in np.unique(band[own]).tolist():  # entries come by place, so the first of a band have the shingle earliest
                    known = pivots.setdefault(x, [])
                    at = f + np.flatnonzero(band[own] == x)[: PIVOTS - len(known)]
                    known += zip(sid[at].tolist(), n[at].tolist(), pos[at].tolist(), bits[at].tolist(), strict=True)
                for x, known in pivots.items():
                    near = f + np.flatnonzero(np.abs(band[own] - x) <= 1)
                    for p_sid, p_n, p_pos, p_bits in known:
                        at = near[_fits(sig[near], n[near], pos[near], np.int64(p_n), np.int64(p_pos), percent, boundary) & (sid[near] != p_sid)]
                        at = at[_alike(n[at], np.full(len(at), p_n), bits[at], np.full(len(at), p_bits, object), percent)]
                        a.append(sid[at])
                        b.append(np.full(len(at), p_sid, np.int64))
                        need.append(np.zeros(len(at), np.int64))
            a, b, need = map(np.concatenate, (a, b, need))
            pairs = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "n": need.astype(np.int32)})
            pairs = pairs.groupby(["a", "b"], sort=False, as_index=False).agg(n=("n", "min"), c=("n", "size"))
            at, _ = expand(first[long], count[long])
            cols = [np.append(pairs["a"], sig[at]), np.append(pairs["b"], sid[at]), np.append(pairs["n"], n[at]), np.append(pairs["c"], -1 - pos[at])]
            cols = [pa.array(x.astype(t)) for x, t in zip(cols, (np.int64, np.int64, np.int32, np.int32), strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([b""] * len(pairs) + bits[at].tolist(), pa.binary())], ["a", "b", "n", "c", "bits"])

    return given_back(run)


_MEMBERS = ("sid", "n", "pos", "comp", "bits")


def _crossing(percent: int, boundary: int):
    """Pairs, of a block of a list's members and a block of those outside its largest component, that are in different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, sig in enumerate(batch.column("sig").to_pylist()):
                one, other = (dict(zip(_MEMBERS, (x.to_numpy(zero_copy_only=False) for x in batch.column(c)[k].values.flatten()), strict=True)) for c in ("lost", "every"))
                n, pos, m, at = (x.astype(np.int64) for x in (one["n"][:, None], one["pos"][:, None], other["n"], other["pos"]))
                i, j = np.nonzero((one["comp"][:, None] != other["comp"]) & _fits(np.int64(sig), n, pos, m, at, percent, boundary))
                ok = _alike(n[i, 0], m[j], one["bits"][i], other["bits"][j], percent)
                x, y = one["sid"][i[ok]], other["sid"][j[ok]]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return given_back(run)


def _across(longs: DataFrame, comp: DataFrame, percent: int, boundary: int) -> DataFrame:
    """Candidates (a, b) among entries of long lists (sig, sid, n, pos, bits) that no component joins yet."""
    placed = longs.join(comp.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("comp", F.coalesce("component", "sid"))
    placed = materialise(placed.select("sig", *_MEMBERS), "entries")
    sizes = placed.groupBy("sig", "comp").count().groupBy("sig").agg(F.max_by("comp", F.struct("count", "comp")).alias("home"), F.sum("count").alias("m"), F.max("count").alias("h"))
    placed = placed.join(sizes.filter("m > h"), "sig")

    def blocks(rows: DataFrame, members: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("sid"), F.ceil(F.col(members) / BLOCK))
        return rows.groupBy("sig", block.alias(f"{name}_block")).agg(F.collect_list(F.struct(*_MEMBERS)).alias(name))

    lost = placed.filter("comp <> home").withColumn("r", F.col("m") - F.col("h"))
    met = blocks(lost, "r", "lost").join(blocks(placed, "m", "every"), "sig")
    return met.repartition("sig", "lost_block", "every_block").select("sig", "lost", "every").mapInArrow(_crossing(percent, boundary), "a bigint, b bigint")


def _setting(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            doc, shingle = shingle_sets(batch.column("text"), size)
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            sets = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(shingle.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("sid"), sets], ["sid", "set"])

    return given_back(run)


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The candidate pairs of classes that are similar, by their whole sets: (a, b)."""
    pairs = materialise(pairs.distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("sid")).unionAll(pairs.select(F.col("b").alias("sid"))).distinct()
    texts = classes.join(wanted, "sid", "left_semi").select("sid", "one").join(rows, F.col("one") == F.col("key")).select("sid", "text").dropDuplicates(["sid"])
    sets = materialise(texts.mapInArrow(_setting(size), "sid bigint, set array<bigint>"), "sets")
    full = pairs.join(sets.select(F.col("sid").alias("b"), F.col("set").alias("sb")), "b").join(sets.select(F.col("sid").alias("a"), F.col("set").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return full.withColumn("common", common).filter(100 * F.col("common") >= percent * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def _frequent(seen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, power of two of its number) of the most frequent shingles, ascending; at most ``MOST_HOT``."""
    found = seen.filter("key IS NULL").groupBy("sid").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_DOCS)
    found = materialise(found.select("sid", F.least(F.floor(F.log2("n")), F.lit(31)).cast("int").alias("p")), "frequent")
    least, total = 32, 0
    for p, n in sorted(((r[0], r[1]) for r in found.groupBy("p").count().collect()), reverse=True):
        total += n
        if total > MOST_HOT:
            break
        least = p
    listed = np.fromiter((x for r in found.filter(F.col("p") >= least).toLocalIterator() for x in r), np.uint64).reshape(-1, 2)
    listed = listed[np.argsort(listed[:, 0])]
    return np.ascontiguousarray(listed[:, 0]), np.ascontiguousarray(listed[:, 1])


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, percent: int = PERCENT, dense: int = DENSE) -> DataFrame:
    """(doc_id, n_shingles, component_id, group_id, row_key) for every row of ``docs``.

    Two documents link when their sets' Jaccard similarity is ``percent`` / 100 or more; component_id
    is the smallest id that links reach.  A text that is null or without words has no set and is
    linked with nothing, its own component.  Repeated rows are equal sets; different texts that share an id
    are different documents.  Rows with a null id take part in links, but a component's id is the smallest
    that is not null, if there is one.  Only the id and the text are read, whatever other columns are
    called.  group_id tells components apart whatever their ids (null without a set), row_key is
    ``row_key`` of the row.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), row_key(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    seen = materialise(rows.mapInArrow(_classing(size), "doc bigint, key bigint, sid bigint, n bigint"), "classes")
    own = seen.filter("key IS NOT NULL")
    hot = _frequent(seen)
    classes = own.filter("n > 0").groupBy("sid").agg(F.min("doc").alias("rep"), F.min("key").alias("one"), F.first("n").alias("n"))
    bins = F.when(F.col("n") <= 200, F.col("n")).otherwise(F.floor(F.pow(F.lit(1.1), F.floor(F.log(1.1, F.col("n"))))).cast("bigint"))
    boundary = choose_boundary([(r[0], r[1]) for r in classes.groupBy(bins.alias("s")).count().collect()], percent)
    signed = rows.mapInArrow(_signing(spark.sparkContext.broadcast(hot), boundary, size, percent), "sig bigint, part int, sid bigint, n int, pos int, bits binary")
    lists = signed.repartition("sig", "part").sortWithinPartitions("sig", "part", "pos", "sid")
    found = materialise(lists.mapInArrow(_pairing(percent, dense, boundary), "a bigint, b bigint, n int, c int, bits binary"), "candidates")
    likely = found.filter("c > 0").groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("n").alias("n")).filter("c >= n").select("a", "b")
    links = materialise(_verified(likely, rows, classes, size, percent), "links")
    comp = components(links)
    longs = found.filter("c < 0").select(F.col("a").alias("sig"), F.col("b").alias("sid"), "n", (-1 - F.col("c")).alias("pos"), "bits")
    if not longs.isEmpty():
        more = _verified(_across(longs, comp, percent, boundary), rows, classes, size, percent)
        comp = components(links.unionAll(more))
    comp = materialise(comp.join(classes.select(F.col("sid").alias("node"), "rep"), "node"), "components")
    named = comp.join(comp.groupBy("component").agg(F.min("rep").alias("least")), "component").select("node", "component", "least")
    component = F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id")
    told = classes.select("sid", "rep").join(named.withColumnRenamed("node", "sid"), "sid", "left").select("sid", component, F.coalesce("component", "sid").alias("group_id"))
    placed = own.join(told, "sid", "left")
    return placed.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"), "group_id", F.col("key").alias("row_key")
    )


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Groups of similar documents of the whole table: (doc_id, n_shingles, component_id)."""
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
