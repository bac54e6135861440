import hashlib
import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import language_id, pieces, toxicity

A, B = "der die das und nicht ein ich wir haben sein ", "the and not one we have are this that with "


def model(spark):
    rows = [(A * 5, "de"), (B * 5, "en"), (None, "en"), ("x", None)]
    return language_id.train(spark.createDataFrame(rows, "text string, lang string"))


def test_language(spark, docs):
    m = model(spark)
    assert m[0] == ["de", "en"]
    rows = [(1, A), (2, B.upper()), (3, None), (4, ""), (5, "123 !!"), (6, A * 3 + B * 3), (7, "ich " * 30000)]
    got = {r.doc_id: r for r in language_id.predict(docs(rows), m).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 7)] == ["de", "en", "und", "und", "und", "de"]
    assert set(got[6].lang_mix) == {"de", "en"} and abs(got[6].lang_mix["de"] - 0.5) < 0.15
    assert got[3].score == 0 and got[1].score > 0.9
    assert language_id.predict(docs([]), m).count() == 0
    assert language_id.predict(docs(rows[:1]), ([], np.zeros((language_id.CLASSES, 0)))).first().lang_pred == "und"


def test_mixture_is_em():
    g = np.random.default_rng(0)
    p = g.dirichlet(np.ones(50), 2).T
    counts = g.multinomial(4000, p @ [0.3, 0.7])
    kind = np.flatnonzero(counts)
    pi = language_id.mixture(np.zeros(len(kind), int), kind, counts[kind], 1, np.log(p), steps=200)
    assert abs(pi[0, 0] - 0.3) < 0.05 and abs(pi.sum() - 1) < 1e-9


def test_held_out_share(spark):
    import zlib

    got = [r[0] for r in spark.range(200).select(language_id.held_out(F.col("id"))).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)]


def test_gradients():
    g = np.random.default_rng(3)
    net = toxicity.Net.fresh(np.zeros(toxicity.ODDS, np.float32), np.zeros(toxicity.ODDS, np.float32))
    for name in ("wx", "bx", "uh", "wa", "va", "wo"):
        setattr(net, name, getattr(net, name).astype(float) * 3)
    x = g.standard_normal((5, toxicity.WORD_DIM + toxicity.CHAR_DIM + 2))
    ids = g.integers(0, 6, (4, toxicity.SPAN))
    ids[0, 7:] = 5
    weight = g.standard_normal(4)
    value = lambda: float(toxicity.forward(net, net.project(x), ids) @ weight)
    _, cache = toxicity.forward(net, net.project(x), ids, keep=True)
    grad, dproj = toxicity.backward(net, ids, cache, weight, 5)
    grad["wx"], grad["bx"] = x.T @ dproj[:, :-1], dproj[:, :-1].sum(axis=1)
    for name, own in grad.items():
        w = getattr(net, name)
        at = tuple(g.integers(0, s) for s in w.shape)
        old = w[at]
        w[at] = old + 1e-3
        up = value()
        w[at] = old - 1e-3
        down = value()
        w[at] = old
        assert abs((up - down) / 2e-3 - own[at]) < 2e-2 * max(1, abs(own[at])), name


def test_toxicity_learns_and_scores(docs):
    g = np.random.default_rng(1)
    plain = [f"word{i}" for i in range(80)]
    texts, labels = [], []
    for i in range(500):
        w = g.choice(plain, 90).tolist()
        if i % 4 == 0:
            w[g.integers(0, 90)] = f"vile{g.integers(0, 9)}"
        texts.append(" ".join(w))
        labels.append(i % 4 == 0)
    net = toxicity.train(texts[:400], np.array(labels[:400]))
    rows = [(i, t) for i, t in enumerate(texts[400:])] + [(900, None), (901, ""), (902, "..."), (903, "word1 " * 50000 + "vile3 " + "word2 " * 100)]
    got = {r.doc_id: r.score for r in toxicity.predict(docs(rows), net).collect()}
    right = [(got[i] >= toxicity.THRESHOLD) == labels[400 + i] for i in range(100)]
    assert np.mean(right) > 0.95 and got[903] >= toxicity.THRESHOLD
    assert all(0 <= got[i] < toxicity.THRESHOLD for i in (900, 901, 902))
    assert toxicity.predict(docs([]), net).count() == 0


def test_windows_cover_all_words():
    ids, ptr = np.arange(100), np.array([0, 0, 3, 100])
    windows, doc = toxicity.cut(ids, ptr, 100)
    assert doc.tolist()[:2] == [0, 1] and set(windows[doc == 2].ravel()) - {100} == set(range(3, 100))
    assert toxicity.train(["a b"], np.array([False])).scale[0] == 0


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces.load()


@pytest.fixture(scope="module")
def listed():
    """The vocabulary's pieces as the library lists them: {bytes: (id, score)}, ids of bytes, score of an unknown character."""
    sentencepiece = pytest.importorskip("sentencepiece")
    m = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    own = {m.IdToPiece(i).replace("▁", " ").encode(): (i, max(m.GetScore(i), -float(len(m)))) for i in range(len(m)) if not (m.IsControl(i) or m.IsUnknown(i) or m.IsByte(i) or m.IsUnused(i))}
    return own, [m.PieceToId(f"<0x{b:02X}>") for b in range(256)], min(s for _, s in own.values()) - 10


def brute_paths(listed, text):
    """All segmentations of a chunk."""
    own, byte_ids, unknown = listed
    if not text:
        return [(0.0, ())]
    out = []
    first = text.decode()[0].encode()
    for k in range(1, len(text) + 1):
        if text[:k] in own:
            i, s = own[text[:k]]
            out += [(s + a, (i, *b)) for a, b in brute_paths(listed, text[k:])]
    if first not in own:
        out += [(unknown + a, (*(byte_ids[x] for x in first), *b)) for a, b in brute_paths(listed, text[len(first) :])]
    return out


def test_nbest_of_chunks(vocabulary, listed):
    for chunk in (" hello", " ab", " naïve", "  x", "日本", " ▁q", "aaaaaaaa"):
        every = sorted((-s, i) for s, i in brute_paths(listed, chunk.encode()))
        got = vocabulary.search(chunk.encode(), 5)
        assert [s / pieces.UNIT for s, _ in got] == [-s for s, _ in every[:5]]
        assert len({tuple(i) for _, i in got}) == len(got) and all((-s / pieces.UNIT, tuple(i)) in every for s, i in got)


def test_short_chunks_together_are_as_each_alone(vocabulary, listed):
    g = random.Random(8)
    chunks = ["".join(g.choices("aeinst é日🎸x", k=g.randrange(1, 9))).encode() for _ in range(60)] + [b"a", "▁".encode()]
    size = np.array([len(c) for c in chunks])
    ids, count, score, gap = vocabulary.segment(np.frombuffer(b"".join(chunks), np.uint8), np.cumsum(size) - size, size)
    ends = np.append(0, np.cumsum(count))
    for k, c in enumerate(chunks):
        every = sorted((-s, i) for s, i in brute_paths(listed, c))
        assert (-score[k] / pieces.UNIT, tuple(ids[ends[k] : ends[k + 1]].tolist())) in every and -score[k] / pieces.UNIT == every[0][0]
        assert gap[k] == ((every[1][0] - every[0][0]) * pieces.UNIT if len(every) > 1 else -1)
        assert ids[ends[k] : ends[k + 1]].tolist() == vocabulary.search(c, 2)[0][1]


def test_short_chunks_leave_the_queue_best_first(monkeypatch):
    """The search for many chunks at once gives what the queue of each alone gives."""
    g = random.Random(3)
    words = {bytes(g.choices(b"abc", k=g.randrange(1, 4))): None for _ in range(20)}
    vocabulary = pieces.Pieces({w: (256 + i, -float(g.randrange(1, 9))) for i, w in enumerate(words)}, list(range(256)), 256 + len(words))
    chunks = [bytes(g.choices(b"abc", k=g.randrange(1, 9))) for _ in range(60)]
    size = np.array([len(c) for c in chunks])
    got, real = {}, pieces._backward

    def five(*args):
        found, edge, back = real(*args[:-1], 5)
        for who, score, _ in found:
            for k, x in zip(who.tolist(), score.tolist(), strict=True):
                got.setdefault(k, []).append(x)
        return real(*args)

    monkeypatch.setattr(pieces, "_backward", five)
    _, _, score, gap = vocabulary.segment(np.frombuffer(b"".join(chunks), np.uint8), np.cumsum(size) - size, size)
    for k, c in enumerate(chunks):
        want = [x for x, _ in vocabulary.search(c, 5)]
        assert got[k] == want and score[k] == want[0] and gap[k] == (want[0] - want[1] if len(want) > 1 else -1)


def test_long_chunks(vocabulary):
    """No cut for 300,000 bytes; ties all along."""
    began = time.time()
    (best, ids), (second, _) = vocabulary.search(b"a" * 300_000, 2)
    assert time.time() - began < 30 and vocabulary.decode(ids) == "a" * 300_000 and best >= second
    ids, ends, score, _, same = pieces._encoded(vocabulary, pa.array(["a" * 299_999, None, "b" * 700, "b" * 700]))
    assert same.all() and np.diff(ends)[1] == 0 and score[2] == score[3] and vocabulary.decode(ids[: ends[1]]) == "a" * 299_999


def test_blocks_do_not_matter(vocabulary, monkeypatch):
    texts = pa.array(["one two three " * 30, "", "x" * 90, None, "four five"])
    whole = pieces._encoded(vocabulary, texts)
    monkeypatch.setattr(pieces, "BLOCK", 40)
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces._encoded(vocabulary, texts), strict=True))


def test_nbest_of_texts(vocabulary, listed):
    text = "an old hat"
    rows = [brute_paths(listed, c) for c in vocabulary.chunks(b" " + text.encode())]
    every = sorted((sum(s for s, _ in c) for c in itertools.product(*rows)), reverse=True)
    got = vocabulary.nbest(text, 4)
    assert [s for s, _ in got] == every[:4]
    assert all(vocabulary.decode(i) == text for _, i in got)


def test_round_trip(spark, docs, vocabulary):
    texts = ["", None, " ", "  two  spaces ", "▁ literal ▁", "tab\tnew\nline", "日本語 emoji 🎸", "a" * 30000, "x " * 20000, "repeat", "repeat"]
    done = pieces.encode(docs(list(enumerate(texts))))
    back = {r.doc_id: r for r in pieces.decode(done.drop("text")).collect()}
    assert all(back[i].text == (t or "") and back[i].round_trip for i, t in enumerate(texts))
    assert back[0].n_pieces == 0 and back[1].n_pieces == 0 and back[0].margin is None
    assert back[9].ids == vocabulary.nbest("repeat", 1)[0][1] == back[10].ids
    assert pieces.encode(docs([])).count() == 0
    two = {(r.id, r.rank): r for r in pieces.encode_nbest(docs([(9, "repeat")]), n=2).collect()}
    assert abs(two[9, 0].score - two[9, 1].score - back[9].margin) < 1e-6


@pytest.mark.parametrize("n", [1, 2, 4])
def test_encode_gives_all_that_are_wanted(spark, docs, vocabulary, listed, n):
    """The n best segmentations of whole texts, as brute force finds them; each decodes to the text."""
    texts = ["an old hat", "aaa", "q", "日本 ▁", "old old old", "", None]
    got = {r.doc_id: r for r in pieces.encode(docs(list(enumerate(texts))), n=n).collect()}
    for d, t in enumerate(texts):
        rows = [brute_paths(listed, c) for c in vocabulary.chunks(b" " + t.encode())] if t else []
        every = sorted((sum(s for s, _ in c) for c in itertools.product(*rows)), reverse=True)
        found = [got[d], *got[d].others]
        assert [r.score for r in found] == every[:n] and got[d].margin == (every[0] - every[1] if min(n, len(every)) > 1 else None)
        assert len({tuple(r.ids) for r in found}) == len(found) and all(vocabulary.decode(r.ids) == (t or "") for r in found) and got[d].round_trip
        assert all(r.n_pieces == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() for r in found)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_others_of_texts_in_many_blocks(vocabulary, monkeypatch, block):
    monkeypatch.setattr(pieces, "BLOCK", block)
    texts = ["one two three " * 30, "", "x" * 900 + " end", "four five", None, "one two three " * 30]
    for n in (2, 3):
        ids, ends, score, others, same = pieces._segmented(vocabulary, pa.array(texts), n)
        assert same.all()
        for d, t in enumerate(texts):
            got = [(score[d] / pieces.UNIT, ids[ends[d] : ends[d + 1]].tolist()), *((s / pieces.UNIT, i.tolist()) for s, i in others[d])]
            assert got == vocabulary.nbest(t, n)


def test_library_decodes_the_same(vocabulary):
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.VOCABULARY)
    for text in ("Hello world, this is it.", "naïve café"):
        assert lib.decode(vocabulary.nbest(text, 1)[0][1]) == text


def test_word_hashes_do_not_depend_on_neighbours():
    a = toxicity._hash_bytes(pa.array([b"alpha", b"b", b"gamma"], pa.large_binary()))[0]
    b = toxicity._hash_bytes(pa.array([b"gamma", b"alpha"], pa.large_binary()))[0]
    assert a[0] == b[1] and a[2] == b[0]
