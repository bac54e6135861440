"""SentencePiece encoding and decoding: N-best segmentation over the piece lattice.

A forward Viterbi pass gives every place of the lattice the best score that reaches it.  That score
is an exact heuristic for an A* search that runs backward from the end, so complete segmentations
leave its queue in order of their score, best first.  As the heuristic is exact and no two entries of
the queue have a segmentation in common, the queue never needs more entries than segmentations that are
still wanted.  Scores are whole numbers of 2**-20, so sums have no rounding, however long a text is.

Where two neighbouring bytes stand together in no piece of the vocabulary, no edge crosses; so the
lattice falls apart at such places, and each distinct chunk of a few megabytes of text is searched once.
Short chunks go together, forward place by place and backward entry by entry of all their queues; a long one goes by itself.  Nothing is kept between
the blocks of a task, so memory is bounded by a block, or by the longest chunk if that is larger.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.store import arrow_batches, given_back
from skein.llm.textcols import buffers, expand, word_ids

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: A session may name another vocabulary here.
VOCABULARY_CONF = "spark.skein.pieces.vocabulary"
SPACE = "▁"
#: Segmentations that are kept of a text; bytes of text in a block; the longest chunk that is searched together with others.
NBEST, BLOCK, SHORT = 2, 1 << 20, 512
#: What a character that no piece covers costs beyond the worst piece, as in the library's lattice.
UNKNOWN_PENALTY = 10.0
#: A score of one, in whole numbers.
UNIT = 1 << 20
_NEVER, _LEFT, _MOST = np.int64(-(1 << 62)), np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Pieces:
    """A vocabulary: ids and scores of pieces as bytes, where a space stands for the marker; its trie as arrays."""

    def __init__(self, pieces: dict[bytes, tuple[int, float]], byte_ids: list[int], n: int):
        names = sorted(p for p in pieces if p)
        self.byte_ids = np.array(byte_ids, np.int32)
        self.unknown = round((min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY) * UNIT)
        #: Whether a piece, or a character beyond ASCII, may hold the first byte before the second.
        self.joins = np.zeros((256, 256), bool)
        self.joins[:, 0x80:0xC0] = True
        for p in names:
            b = np.frombuffer(p, np.uint8)
            self.joins[b[:-1], b[1:]] = True
        surface = [b""] * n
        for p, (i, _) in pieces.items():
            surface[i] = p
        for b, i in enumerate(byte_ids):
            surface[i] = bytes([b])
        #: The bytes of all pieces in a row, and where those of each id begin and how many they are.
        self.letters = np.frombuffer(b"".join(surface), np.uint8)
        self.width = np.array([len(s) for s in surface], np.int64)
        self.begin = np.cumsum(self.width) - self.width
        self._plant(names, pieces)

    def _plant(self, names: list[bytes], pieces: dict[bytes, tuple[int, float]]) -> None:
        """Nodes are numbered by depth; an edge is the key node * 256 + byte, and keys are sorted."""
        node = np.zeros(len(names), np.int64)
        size = np.array([len(p) for p in names], np.int64)
        keys: list[np.ndarray] = []
        last = 0
        ids, scores = {}, {}
        for depth in range(int(size.max(initial=0))):
            own = np.flatnonzero(size > depth)
            key = node[own] * 256 + np.array([names[i][depth] for i in own.tolist()], np.int64)
            found, at = np.unique(key, return_inverse=True)
            keys.append(found)
            node[own] = last + 1 + at
            last += len(found)
            for i in own[size[own] == depth + 1].tolist():
                ids[int(node[i])], scores[int(node[i])] = pieces[names[i]][0], round(pieces[names[i]][1] * UNIT)
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        self.ids, self.scores = np.full(last + 1, -1, np.int32), np.zeros(last + 1, np.int64)
        self.ids[list(ids)], self.scores[list(scores)] = list(ids.values()), list(scores.values())

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Pieces:
        """The vocabulary of a model file; scores below minus its size (of forbidden pieces) are raised to that."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = (i for i in range(len(model)) if not (model.IsControl(i) or model.IsUnknown(i) or model.IsByte(i) or model.IsUnused(i)))
        pieces = {model.IdToPiece(i).replace(SPACE, " ").encode(): (i, max(model.GetScore(i), -float(len(model)))) for i in ordinary}
        return cls(pieces, [model.PieceToId(f"<0x{b:02X}>") for b in range(256)], len(model))

    def edges(self, text: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, score, id) of all edges between places of the text; no edge leaves a place beyond ``end`` of it.

        A character that is no piece is an edge by itself, of id -1.
        """
        lead = text & 0xC0 != 0x80
        at = np.flatnonzero(lead)
        stop = end[at]
        after = np.minimum(at + np.where(text[at] < 0xC0, 1, np.where(text[at] < 0xE0, 2, np.where(text[at] < 0xF0, 3, 4))), stop)
        known = np.zeros(len(text) + 1, bool)
        node, here, whole, owner = np.zeros(len(at), np.int64), at.copy(), after, at
        out: list[tuple[np.ndarray, ...]] = []
        while len(here):
            key = node * 256 + text[here]
            node = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            ok = self.keys[node] == key if len(self.keys) else np.zeros(len(key), bool)
            node, here, whole, owner, stop = node[ok] + 1, here[ok] + 1, whole[ok], owner[ok], stop[ok]
            piece = self.ids[node] >= 0
            out.append((owner[piece], here[piece], self.scores[node[piece]], self.ids[node[piece]]))
            known[owner[piece & (here == whole)]] = True
            on = here < stop
            node, here, whole, owner, stop = node[on], here[on], whole[on], owner[on], stop[on]
        bare = ~known[at]
        out.append((at[bare], after[bare], np.full(int(bare.sum()), self.unknown), np.full(int(bare.sum()), -1, np.int32)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _spelled(self, text: bytes, start: int, stop: int, piece: int) -> list[int]:
        return [piece] if piece >= 0 else [int(self.byte_ids[b]) for b in text[start:stop]]

    def search(self, text: bytes, n: int = NBEST) -> list[tuple[int, list[int]]]:
        """The ``n`` best segmentations of a chunk (score in whole numbers, ids), best first."""
        if not text:
            return [(0, [])]
        size = len(text)
        start, stop, score, piece = self.edges(np.frombuffer(text, np.uint8), np.full(size, size))
        order = np.lexsort((start, stop))
        start, stop, score, piece = (x[order].tolist() for x in (start, stop, score, piece))
        into = np.searchsorted(np.array(stop), np.arange(size + 2)).tolist()
        best: list[int | None] = [0] + [None] * size
        for j in range(1, size + 1):
            for e in range(into[j], into[j + 1]):
                b = best[start[e]]
                if b is not None and (best[j] is None or b + score[e] > best[j]):
                    best[j] = b + score[e]
        # steps of the search: the edge taken, and the step before, so that a long chunk's ways share what they have in common
        edge, back = [-1], [-1]
        queue: list[tuple[int, int, int, int]] = [(-best[size], size, 0, 0)]
        out = []
        while queue and len(out) < n:
            _, at, step, behind = queue.pop(0)
            if not at:
                ids = []
                while step:
                    ids += self._spelled(text, start[edge[step]], stop[edge[step]], piece[edge[step]])
                    step = back[step]
                out.append((behind, ids))
                continue
            for e in range(into[at], into[at + 1]):
                b = best[start[e]]
                if b is not None and (len(queue) < n - len(out) or -(b + score[e] + behind) < queue[-1][0]):
                    edge.append(e)
                    back.append(step)
                    queue.append((-(b + score[e] + behind), start[e], len(edge) - 1, behind + score[e]))
                    queue.sort()
                    del queue[n - len(out) :]
        return out

    def segmentations(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, n: int = NBEST) -> tuple[np.ndarray, np.ndarray, Callable]:
        """The ``n`` best segmentations of many short chunks, in rows by chunk, best first: (chunks, scores, what spells rows).

        Chunk i is text[start[i] : start[i] + size[i]], in a row and without gaps.  Forward by places, then the A* search
        backward, a step for all chunks at a time.  The last of the results gives, of ascending rows, (ids of all in a row, their numbers).
        """
        chunks = len(size)
        chunk = np.repeat(np.arange(chunks), size)
        u, v, s, piece = self.edges(text, (start + size)[chunk])
        c = chunk[v - 1]
        own = v - start[c]
        u, v = u + c, v + c  # each chunk has one place more than bytes
        order = np.lexsort((u, v, own))
        del chunk, c  # one array at a time from here, as there are many edges
        own = own[order]
        u = u[order]
        v = v[order]
        s = s[order]
        piece = piece[order]
        del order
        where = start + np.arange(chunks)
        best = np.full(len(text) + chunks, _NEVER)
        best[where] = 0
        for lo, hi in _steps(own):
            reach = best[u[lo:hi]] + s[lo:hi]
            reach[best[u[lo:hi]] == _NEVER] = _NEVER
            first = np.flatnonzero(np.diff(v[lo:hi], prepend=-1))
            best[v[lo:hi][first]] = np.maximum.reduceat(reach, first)
        del own
        found, edge, back = _backward(best, u, v, s, where, where + size, n)
        chunk, score, last = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else [()] * 3))
        order = np.argsort(chunk, kind="stable")
        chunk, score, last = chunk[order], score[order], last[order]

        def spelled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            step, taken = last[rows], []
            who = np.flatnonzero(step >= 0)
            while len(who):
                at = step[who]
                taken.append((who, edge[at]))
                step[who] = back[at]
                who = who[back[at] >= 0]
            who = np.concatenate([np.empty(0, np.int64), *(w for w, _ in taken)])
            e = np.concatenate([np.empty(0, np.int64), *(x for _, x in taken)])
            order = np.argsort(who, kind="stable")
            who, e = who[order], e[order]
            bare = piece[e] < 0
            width = np.where(bare, v[e] - u[e], 1)
            ids = np.repeat(piece[e], width)
            if bare.any():
                at, _ = expand(u[e[bare]] - chunk[rows][who[bare]], width[bare])
                ids[np.repeat(bare, width)] = self.byte_ids[text[at]]
            return ids, np.bincount(who, width, len(rows)).astype(np.int64)

        return chunk, score, spelled

    def segment(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The best of the ``segmentations``: (ids of all chunks in a row, their numbers, scores, how far the second best are behind); no second one: -1."""
        chunk, score, spelled = self.segmentations(text, start, size, 2)
        first = np.searchsorted(chunk, np.arange(len(size)))
        second = np.minimum(first + 1, len(chunk) - 1)
        return *spelled(first), score[first], np.where(np.bincount(chunk, minlength=len(size)) > 1, score[first] - score[second], -1)

    def cuts(self, text: np.ndarray) -> np.ndarray:
        """Whether each byte starts a chunk of its own."""
        new = np.ones(len(text), bool)
        new[1:] = ~self.joins[text[:-1], text[1:]]
        return new

    def chunks(self, text: bytes) -> list[bytes]:
        at = np.flatnonzero(self.cuts(np.frombuffer(text, np.uint8))).tolist()
        return [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)] if text else []

    def nbest(self, text: str | None, n: int = NBEST) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a whole text, best first; null and '' have one, of no pieces."""
        rows = [self.search(c, n) for c in self.chunks(b" " + text.encode())] if text else []
        base = sum(r[0][0] for r in rows)
        gaps = sorted((r[0][0] - r[1][0], k) for k, r in enumerate(rows) if len(r) > 1)[: n - 1]
        out = []
        for gap, choice in _choices([[rows[k][0][0] - s for s, _ in rows[k]] for _, k in gaps], n):
            pick = {gaps[x][1]: c for x, c in enumerate(choice)}
            out.append(((base - gap) / UNIT, [i for k, r in enumerate(rows) for i in r[pick.get(k, 0)][1]]))
        return out

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids' pieces."""
        place, _ = expand(self.begin[ids], self.width[ids])
        return self.letters[place]

    def decode(self, ids) -> str:
        """The text of the ids: the exact inverse of every segmentation."""
        whole = self.spell(np.array(ids, np.int64)).tobytes()
        return whole[1:].decode("utf-8", "replace") if whole[:1] == b" " else whole.decode("utf-8", "replace")


def _backward(best: np.ndarray, u: np.ndarray, v: np.ndarray, s: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray, np.ndarray]:
    """A* from the end of each chunk to its begin, every chunk with a queue of its own, for ``n`` segmentations.

    Edges go from u to v, those of one v in a row; ``best`` is what reaches a place.  Returns what leaves the queues
    complete, best first, as (chunks, scores, last steps), and the steps as (edge, step before).  A round takes the
    first entry of each queue and queues what leads to it; of equal entries the newest goes first.
    """
    first = np.flatnonzero(np.diff(v, prepend=-1))
    into, many = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
    into[v[first]], many[v[first]] = first, np.diff(np.append(first, len(v)))
    who, at = np.arange(len(begin)), end.copy()
    behind, step = np.zeros(len(begin), np.int64), np.full(len(begin), -1, np.int64)
    wanted = np.full(len(begin), n)
    found, edge, back, made = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    while len(who):
        top = np.diff(who, prepend=-1) > 0
        done = top & (at == begin[who])
        if done.any():
            found.append((who[done], behind[done], step[done]))
            wanted[who[done]] -= 1
        on, rest = top & ~done, ~top
        e, k = expand(into[at[on]], many[at[on]])
        ok = best[u[e]] != _NEVER
        e, k = e[ok], k[ok]
        whose = np.concatenate([who[on][k], who[rest]])
        place, after = np.concatenate([u[e], at[rest]]), np.concatenate([behind[on][k] + s[e], behind[rest]])
        order = np.argsort(whose, kind="stable")
        value, owner = (best[place] + after)[order], whose[order]
        first, picks = np.flatnonzero(np.diff(owner, prepend=-1)), []
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(owner))))
        for rank in range(int(wanted[owner].max(initial=0))):
            top = np.flatnonzero(value == np.maximum.reduceat(value, first)[group])
            top = top[np.diff(group[top], prepend=-1) > 0]
            top = top[(value[top] > _LEFT) & (rank < wanted[owner[top]])]
            value[top] = _LEFT
            picks.append(top)
        kept = np.concatenate([np.empty(0, np.int64), *picks])
        kept = order[kept[np.argsort(owner[kept], kind="stable")]]
        new = kept < len(e)
        fresh = kept[new]
        edge.append(e[fresh])
        back.append(step[on][k[fresh]])
        before = step[rest]
        step = np.empty(len(kept), np.int64)
        step[new], step[~new] = made + np.arange(len(fresh)), before[kept[~new] - len(e)]
        made += len(fresh)
        who, at, behind = np.concatenate([who[on][k], who[rest]])[kept], place[kept], after[kept]
    return found, np.concatenate(edge), np.concatenate(back)


def _choices(lists: list[list[int]], n: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """The ``n`` least sums of one number of each list, in order, and which those are: a heap over choices, opened left to right."""
    heap, seen = [(0, (0,) * len(lists))], {(0,) * len(lists)}
    while heap and n:
        total, choice = heapq.heappop(heap)
        yield total, choice
        n -= 1
        for x, c in enumerate(choice):
            if c + 1 < len(lists[x]):
                more = (*choice[:x], c + 1, *choice[x + 1 :])
                if more not in seen:
                    seen.add(more)
                    heapq.heappush(heap, (sum(lists[y][z] for y, z in enumerate(more)), more))


def _least(value: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Where the ``n`` least values below ``_MOST`` are of each group, the earliest of equal ones; groups begin at ``first``."""
    value, group, picks = value.copy(), np.repeat(np.arange(len(first)), np.diff(np.append(first, len(value)))), [np.empty(0, np.int64)]
    for _ in range(n):
        at = np.flatnonzero((value == np.minimum.reduceat(value, first)[group]) & (value < _MOST))
        at = at[np.diff(group[at], prepend=-1) > 0]
        value[at] = _MOST
        picks.append(at)
    return np.sort(np.concatenate(picks))


def _steps(own: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of equal values in ascending ``own``."""
    first = np.flatnonzero(np.diff(own, prepend=-1))
    yield from zip(first.tolist(), [*first[1:].tolist(), len(own)][: len(first)], strict=True)


def _blocks(text: np.ndarray, new: np.ndarray, block: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``block`` bytes that begin at chunks."""
    starts = np.flatnonzero(new)
    lo = 0
    while lo < len(text):
        k = int(np.searchsorted(starts, lo + block))
        hi = int(starts[k]) if k < len(starts) else len(text)
        yield lo, hi
        lo = hi


def _searched(vocabulary: Pieces, text: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable]:
    """Segmentations of a block's distinct chunks, in rows by chunk, best first: (which chunk each one is, chunks of the rows, scores, what spells rows)."""
    end = np.append(start[1:], len(text))
    which, terms = word_ids(text, start, end)
    data, offsets = buffers(terms)
    size = np.diff(offsets)
    short = size <= SHORT
    order = np.argsort(~short, kind="stable")  # short ones first, so that their bytes are in a row
    if not short.all():
        at, _ = expand(offsets[:-1][order], size[order])
        data, size = data[at], size[order]
        which = np.argsort(order, kind="stable")[which]
    begin = np.cumsum(size) - size
    k = int(short.sum())
    chunk, score, some = vocabulary.segmentations(data[: int(size[:k].sum())], begin[:k], size[:k], n)
    long = [vocabulary.search(data[a : a + m].tobytes(), n) for a, m in zip(begin[k:].tolist(), size[k:].tolist(), strict=True)]
    rest, shorts = [np.array(ids, np.int32) for x in long for _, ids in x], len(chunk)

    def spelled(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, count = some(rows[rows < shorts])
        more = [rest[r - shorts] for r in rows[rows >= shorts].tolist()]
        return np.concatenate([ids, *more]).astype(np.int32), np.append(count, [len(x) for x in more]).astype(np.int64)

    chunk = np.append(chunk, np.repeat(np.arange(k, len(size)), [len(x) for x in long]))
    return which, chunk, np.append(score, np.array([s for x in long for s, _ in x], np.int64)), spelled


def _segmented(vocabulary: Pieces, column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[tuple[int, np.ndarray]]], np.ndarray]:
    """(ids of the best, ids' offsets by text, scores, (score, ids) of up to ``n`` - 1 others of each, whether decoding all gives the text back) of a column of texts.

    Another segmentation of a text differs in some of the ``n`` - 1 chunks whose second best are least behind; only those are spelled.
    """
    data, offsets = buffers(column)
    texts = len(column)
    size = np.diff(offsets)
    some = (size > 0).astype(np.int64)
    begin = np.append(0, np.cumsum(size + some))
    text = np.full(int(begin[-1]), 0x20, np.uint8)
    inside = np.ones(len(text), bool)
    inside[begin[:-1][some > 0]] = False  # the space before a text
    text[inside] = data
    new = vocabulary.cuts(text)
    new[begin[:-1][some > 0]] = True
    score, count, same = np.zeros(texts, np.int64), np.zeros(texts, np.int64), np.ones(texts, bool)
    pieces, done = [np.empty(0, np.int32)], 0
    #: Of each text: how far a chunk's others are behind, where its best ids begin and end, the others' ids.
    open_: list[list[tuple[list[int], int, int, list[np.ndarray]]]] = [[] for _ in range(texts)]
    for lo, hi in _blocks(text, new, BLOCK):
        start = np.flatnonzero(new[lo:hi])
        which, chunk, won, spelled = _searched(vocabulary, text[lo:hi], start, n)
        top = np.flatnonzero(np.diff(chunk, prepend=-1))
        best, many = top[which], np.diff(np.append(top, len(chunk)))[which]
        doc = np.searchsorted(begin, lo + start, "right") - 1
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        others = _least(np.where(many > 1, won[best] - won[np.minimum(best + 1, len(won) - 1)], _MOST), first, n - 1)
        rows = np.unique(np.append(top, expand(best[others], many[others])[0]))
        ids, each = spelled(rows)
        del spelled  # and with it the block's lattice, before the next is made
        ends = np.append(0, np.cumsum(each))
        at = np.searchsorted(rows, best)
        number = each[at]
        won_ids = ids[expand(ends[at], number)[0]]
        pieces.append(won_ids)
        own = doc[first]
        count[own] += np.add.reduceat(number, first)
        score[own] += np.add.reduceat(won[best], first)
        width = np.append(0, np.cumsum(number))
        whole = text[lo:hi]
        stop = np.append(start[1:], len(whole))
        for k in others.tolist():
            more = [ids[ends[r] : ends[r + 1]].copy() for r in range(at[k] + 1, at[k] + many[k])]
            behind = (won[best[k]] - won[best[k] : best[k] + many[k]]).tolist()
            open_[doc[k]].append((behind, done + int(width[k]), done + int(width[k + 1]), more))
            same[doc[k]] &= all(np.array_equal(vocabulary.spell(x), whole[start[k] : stop[k]]) for x in more)
        done += len(won_ids)
        back = vocabulary.spell(won_ids)
        if not np.array_equal(back, whole):
            letters = np.append(0, np.cumsum(vocabulary.width[won_ids]))[width]
            for d in own.tolist():
                a, b = np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right")
                same[d] &= np.array_equal(back[letters[a] : letters[b]], whole[start[a] : stop[b - 1]])
    ids, ends = np.concatenate(pieces), np.append(0, np.cumsum(count))
    further = [_others(ids, int(ends[d]), int(ends[d + 1]), int(score[d]), x, n) for d, x in enumerate(open_)]
    return ids, ends, score, further, same


def _others(ids: np.ndarray, lo: int, hi: int, score: int, chunks: list[tuple[list[int], int, int, list[np.ndarray]]], n: int) -> list[tuple[int, np.ndarray]]:
    """(score, ids) of the segmentations of a text after the best, which is ids[lo:hi]."""
    chunks = sorted(chunks, key=lambda x: (x[0][1], x[1]))[: n - 1]
    out = []
    for gap, choice in list(_choices([x[0] for x in chunks], n))[1:]:
        taken = sorted((chunks[x][1], chunks[x][2], chunks[x][3][c - 1]) for x, c in enumerate(choice) if c)
        parts, at = [], lo
        for a, b, other in taken:
            parts += [ids[at:a], other]
            at = b
        out.append((score - gap, np.concatenate([*parts, ids[at:hi]])))
    return out


def _encoded(vocabulary: Pieces, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ids' offsets by text, scores, gaps, whether decoding gives the text back) of a column of texts; no second best: a gap below 0."""
    ids, ends, score, others, same = _segmented(vocabulary, column, 2)
    return ids, ends, score / UNIT, _gaps(score, others) / UNIT, same


def _gaps(score: np.ndarray, others: list[list[tuple[int, np.ndarray]]]) -> np.ndarray:
    return np.array([a - x[0][0] if x else -1 for a, x in zip(score.tolist(), others, strict=True)], np.int64)


def _digest(ids: np.ndarray) -> str:
    return hashlib.sha256(np.ascontiguousarray(ids.astype("<i4"))).hexdigest()


def vocabulary_path(spark) -> str:
    """The session's vocabulary file: ``spark.skein.pieces.vocabulary``, or else ``VOCABULARY``."""
    return spark.conf.get(VOCABULARY_CONF, VOCABULARY)


def encode(docs: DataFrame, *, text_col: str = "text", n: int = NBEST, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Every row of ``docs`` with the ``n`` best segmentations of its whole text.

    ``ids`` (if ``with_ids``), ``n_pieces``, ``ids_sha256`` (of the ids as little-endian 32-bit) and ``score`` of the best,
    ``margin`` (how far the second best is behind; null if there is none or ``n`` is 1), ``others`` (the same four of
    the further ones, best first; fewer than ``n`` - 1 if the text has no more) and ``round_trip`` (whether
    decoding each of them gives the text back, which holds for all texts).  Null and empty texts have no pieces.  A
    literal marker character is spelled in bytes, so it survives.  Repeated rows are encoded alike;
    input columns named like an output column are replaced.  Of segmentations with the same score any
    may be taken, always the same for the same chunk.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    one = {"ids": "array<int>", "n_pieces": "bigint", "ids_sha256": "string", "score": "double"}
    if not with_ids:
        del one["ids"]
    added = one | {"margin": "double", "others": f"array<struct<{', '.join(f'{k}: {v}' for k, v in one.items())}>>", "round_trip": "boolean"}
    own = [c for c in docs.columns if c not in ("ids", *added)]
    needed = own if text_col in own else [*own, text_col]
    sent = spark.sparkContext.broadcast(Pieces.load(path or vocabulary_path(spark)))

    def listed(pieces: np.ndarray, ends: np.ndarray, score: np.ndarray) -> list[pa.Array]:
        digest = [_digest(pieces[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        ids = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(pieces))] if with_ids else []
        return [*ids, pa.array(np.diff(ends)), pa.array(digest, pa.string()), pa.array(score / UNIT)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, ends, score, others, same = _segmented(sent.value, batch.column(text_col), n)
            flat = [x for further in others for x in further]
            size = np.append(0, np.cumsum([len(ids) for _, ids in flat])).astype(np.int64)
            each = listed(np.concatenate([np.empty(0, np.int32), *(ids for _, ids in flat)]), size, np.array([s for s, _ in flat], np.int64))
            each = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in others])), pa.int32()), pa.StructArray.from_arrays(each, list(one)))
            gaps = _gaps(score, others)
            cols = [*listed(pieces, ends, score), pa.array(gaps / UNIT, mask=gaps < 0), each, pa.array(same)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *cols], [*own, *added])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema.fields)
    return docs.select(*needed).mapInArrow(given_back(run), ", ".join([kinds, *(f"{k} {v}" for k, v in added.items())]))


def encode_nbest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = NBEST, path: str | None = None) -> DataFrame:
    """(id, rank, score, ids): the ``n`` best segmentations of each whole text.

    Null and empty texts have one, of no pieces; repeated rows have theirs each.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    sent = spark.sparkContext.broadcast(Pieces.load(path or vocabulary_path(spark)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("id"), batch.column("text"), strict=True):
                found = sent.value.nbest(text.as_py(), n)
                cols = [pa.array([key.as_py()] * len(found), batch.schema.field("id").type), pa.array(range(len(found)), pa.int32()), pa.array([s for s, _ in found]), pa.array([i for _, i in found], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, ["id", "rank", "score", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(given_back(run), f"id {kind}, rank int, score double, ids array<int>")


def decode(rows: DataFrame, *, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Every row with ``text``, decoded from its ids; null ids give null, no ids ''."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(Pieces.load(path or vocabulary_path(spark)))
    own = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if not i.is_valid else sent.value.decode(i.values.to_numpy()) for i in batch.column(own.index(ids_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*own, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema.fields)
    return rows.select(*own).mapInArrow(given_back(run), f"{kinds}, text string")


def op6_pieces(spark, sf_dir: str) -> DataFrame:
    """The pieces of every whole text of ``documents``, best and second best, as counts, digests and scores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = encode(docs, with_ids=False)
    return done.select("doc_id", "n_pieces", "ids_sha256", "score", "margin", "round_trip", "others")
