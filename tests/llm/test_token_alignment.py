import collections
import hashlib
import os
import random

import pytest

from skein.llm import token_alignment as ta

BASE = os.environ.get("SKEIN_TESTDATA", "/root/testdata")
pytestmark = pytest.mark.skipif(not os.path.isdir(ta.FOLDER), reason="no vocabularies")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Brute:
    """Straight from the definition, with the libraries' own encoders and all pairs of a group compared."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{ta.FOLDER}/byte_bpe_50k.json")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{ta.FOLDER}/piece_bpe_32k.model")
        letters = ta._byte_of_char()
        self.bytes_a = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab().items() if t != "<|endoftext|>"}

    def bytes_b(self, i):
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(self, text):
        if not text:
            return [], []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text)
        whole = (" " + text).encode()
        ok = b"".join(map(self.bytes_a.get, a)) == whole == b"".join(map(self.bytes_b, b))
        return (a, b) if ok else ([], [])

    def document(self, text):
        """(A ids, B ids, groups, links)."""
        a, b = self.tokens(text)
        ends = []
        for ids, of in ((a, self.bytes_a.get), (b, self.bytes_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(of(i)), i))
                at += len(of(i))
            ends.append(own)
        cuts = sorted({e for _, e, _ in ends[0]} & {e for _, e, _ in ends[1]})
        groups, links, lo, at = [], [], 0, [0, 0]
        for hi in cuts:
            x, y = [], []
            for side, (out, own) in enumerate(((x, ends[0]), (y, ends[1]))):
                while at[side] < len(own) and own[at[side]][0] < hi:
                    out.append(own[at[side]])
                    at[side] += 1
            groups.append(",".join(str(t[2]) for t in x) + "|" + ",".join(str(t[2]) for t in y))
            links += [(p[2], q[2]) for p in x for q in y if max(p[0], q[0]) < min(p[1], q[1])]
            lo = hi
        return a, b, groups, links

    def table(self, rows):
        done = [(i, *self.document(t)) for i, t in rows]
        count = collections.Counter(p for *_, links in done for p in set(links))
        most = collections.defaultdict(int)
        for (a, _), n in count.items():
            most[a] = max(most[a], n)
        out = []
        for i, a, b, groups, links in done:
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
            out.append((i, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), digest))
        return out, {(*p, n, n == most[p[0]]) for p, n in count.items()}


@pytest.fixture(scope="module")
def brute():
    return Brute()


def same(got, want):
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got) == order(want)


def texts():
    g = random.Random(5)
    letters = "abcdefg  .,\n\t'éß漢字😀▁ﬁ½0123ＡB"
    made = ["".join(g.choice(letters) for _ in range(g.randrange(1, 120))) for _ in range(60)]
    rare = ["".join(chr(c) if not 0xD800 <= c < 0xE000 else "x" for c in (g.choice((g.randrange(0x250), g.randrange(0x110000), 32, 0x2028)) for _ in range(40))) for _ in range(40)]
    return made + rare + [None, "", " ", "  ", "\n", "a", "<s>x</s><unk><|endoftext|>", "▁a b", "a\x00b", "The cat sat on the mat. " * 50, "the", "the", " the", "The  the"]


def test_against_brute_force(spark, docs, brute):
    rows = list(enumerate(texts()))
    rows += [(7, "the other text of an id"), (7, "the other text of an id"), (None, "no id"), (None, None)]
    want, pairs = brute.table(rows)
    frame = docs(rows).repartition(5)
    same(ta.align(frame).select(COLUMNS).collect(), want)
    assert {tuple(r) for r in ta.pair_counts(frame).collect()} == pairs
    groups = {r.doc_id: r.groups for r in ta.align(frame, with_groups=True).collect() if r.doc_id not in (7, None)}
    assert all(groups[i] == ";".join(brute.document(t)[2]) for i, t in rows[:-4] if i != 7)


def test_many_blocks_and_parts(spark, docs, brute, monkeypatch):
    """Blocks of few texts, stripes dealt over several tasks and counts in several rows give the same."""
    monkeypatch.setattr(ta, "PART", 200)
    g = random.Random(2)
    words = ["the", "of", "transformer", "zurück", "été", "naïve", "x1"]
    rows = [(i, " ".join(g.choice(words) for _ in range(30))) for i in range(200)]
    frame = docs(rows).repartition(7)
    stored = ta.encoded(frame, ta.tokenizer_files(spark)).filter("stripe IS NOT NULL")
    assert ta._parts(stored).agg({"parts": "max"}).first()[0] > 1
    same(ta.align(frame).select(COLUMNS).collect(), brute.table(rows)[0])


def test_blocks_cover_all_rows():
    import pyarrow as pa

    column = pa.array(["x" * n for n in (3, 0, 9, 1, 1, 1, 20)] + [None])
    cut = list(ta.blocks_of(column, 5))
    assert [i for lo, hi in cut for i in range(lo, hi)] == list(range(8)) and (2, 3) in cut


def test_packing():
    import numpy as np

    for arrays in ([np.array([], np.int64)], [np.arange(5), np.array([-3, 1 << 40])]):
        assert all((x == y).all() and len(x) == len(y) for x, y in zip(arrays, ta._unpacked(ta._packed(*arrays)), strict=True))


def test_very_long_texts(spark, docs, brute):
    rows = [(1, "word and Wort " * 40_000), (2, " " * 200_000), (3, "a" * 300_000), (4, "漢" * 100_000)]
    want, _ = brute.table([(i, t[: len(t) // 40]) for i, t in rows])  # all pairs of a group are too many for the whole
    same(ta.align(docs([(i, t[: len(t) // 40]) for i, t in rows])).select(COLUMNS).collect(), want)
    got = {r.doc_id: r for r in ta.align(docs(rows)).collect()}
    for i, t in rows:
        a, b = brute.tokens(t)
        assert (got[i].n_a, got[i].n_b) == (len(a), len(b)) and got[i].n_links == len(a) + len(b) - got[i].n_groups


def test_no_rows(spark, docs):
    assert ta.align(docs([])).columns == COLUMNS and ta.align(docs([])).count() == 0
    assert ta.align(docs([(1, None)])).first()[1:] == (0, 0, 0, 0, 0, 0, "")


@pytest.mark.skipif(not os.path.isdir(f"{BASE}/sf0.001"), reason="no test tables")
def test_the_query_against_brute_force(spark, brute):
    path = f"{BASE}/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    same(ta.op12_token_alignment(spark, path).select(COLUMNS).collect(), brute.table(rows)[0])
