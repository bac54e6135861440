import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from skein.llm import components, decontaminate, embedding_dedup, jaccard_join, suffix_dedup

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(rows, items, window=10):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = {}
    for d, t in rows:
        w, hit, met = words(t), set(), set()
        for g, owners in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    met |= owners
        out[d] = (len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(map(str, met))).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontaminate(spark, docs, block):
    g = random.Random(3)
    vocab = [f"w{i}" for i in range(12)] + ["É", "naïve", "007"]
    items = [(i, " ".join(g.choices(vocab, k=n))) for i, n in enumerate([3, 14, 10, 25, 1])] + [(5, None), (6, ""), (7, "W0, w1!"), (12, "...")]
    rows = [(d, " ".join(g.choices(vocab, k=60)) + "\n" + (items[d % 5][1].upper() if d % 2 else "")) for d in range(20)] + [(90, None), (91, ""), (92, "w0 w1 " * 4000)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in decontaminate.decontaminate(docs(rows), bench, block=block).collect()}
    assert got == brute_hits(rows, items)


def test_decontaminate_empty(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminate(docs([]), none).count() == 0
    assert decontaminate.decontaminate(docs([(1, "a b")]), none).first()[1:5] == (2, 0, 0, hashlib.sha256(b"").hexdigest())


def test_stored_shards_are_read_one_by_one(spark, docs):
    """Each shard is a row group of its own, without its bytes as statistics."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        index = decontaminate.build_index(docs([(d, f"w{d} " * 4) for d in range(30)]).coalesce(1))
        files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = [m.row_group(k) for m in files for k in range(m.num_row_groups)]
    assert len(groups) == 15 and all(g.num_rows == 1 and not g.column(g.num_columns - 1).is_stats_set for g in groups)
    assert sorted(x for r in index.select("doc_ids").collect() for x in r.doc_ids) == list(range(30))


def test_large_batches_are_several_shards(monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 40, raising=False)
    texts = ["a b", None, "", "long " * 100, *["x y " * 4] * 6]
    batch = pa.table({"doc": pa.array(range(10), pa.int64()), "key": pa.array(range(10), pa.int64()), "row_key": pa.array(range(10), pa.int64()), "text": texts}).to_batches()[0]
    shards = list(decontaminate._shards(iter([batch, batch.slice(0, 0)])))
    assert [s.column("doc_ids")[0].as_py() for s in shards] == [[0, 1, 2], [3], [4, 5], [6, 7], [8, 9]]
    assert [np.diff(np.frombuffer(s.column("ptr")[0].as_py(), "<i8")).tolist() for s in shards] == [[2, 0, 0], [100], [8, 8], [8, 8], [8, 8]]


def brute_near(rows, items, width, window=10):
    out = {}
    for d, t in rows:
        w = words(t)
        for i, text in items:
            own = words(text)
            for k in range(max(1, len(own) - window + 1) if own else 0):
                need = set(own[k : k + window])
                for n in range(1, min(width, len(w)) + 1):
                    found = [s for s in range(len(w) - n + 1) if need <= set(w[s : s + n])]
                    if found:
                        out[d, i] = min(out.get((d, i), (n, found[0])), (n, found[0]))
                        break
    return {(d, i, s, s + n) for (d, i), (n, s) in out.items()}


@pytest.mark.parametrize(("block", "width"), [(200_000, 20), (3, 14), (200_000, 1)])
def test_proximity(spark, docs, block, width):
    """Words put in, left out and moved; repeated words; spans never cross documents."""
    g = random.Random(13)
    vocab = [f"w{i}" for i in range(14)]
    items = [(1, " ".join(vocab[:12])), (2, "w3 w4 w3"), (3, "w13"), (4, " ".join(g.choices(vocab, k=30))), (5, None), (6, "")]
    rows = [(d, " ".join(g.choices(vocab, k=g.randrange(1, 50)))) for d in range(25)]
    moved = " ".join(vocab[5:0:-1] + ["x", "y"] + vocab[5:12])
    rows += [(60, "a b " + moved + " c"), (61, "W3 z w4"), (62, "w3"), (63, "w4"), (64, None), (65, ""), (66, moved.upper())]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = [(r.doc_id, r.item_id, r.start, r.stop) for r in decontaminate.near_matches(docs(rows), bench, width=width, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_near(rows, items, width)
    assert width < 14 or {(60, 1), (66, 1)} <= {(d, i) for d, i, _, _ in got}
    assert decontaminate.near_matches(docs([]), bench).count() == 0


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                a, b = root(x), root(y)
                comp[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("dense", [48, 2])
def test_jaccard(docs, dense):
    g = random.Random(5)
    rows, n = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE two "), (5, "one two three four five"), (6, "One two three four five")], 10
    for size in (6, 8, 9, 15, 30, 60, 200):
        base = [f"v{g.randrange(300)}" for _ in range(size)]
        for _ in range(7):
            own = list(base)
            for _ in range(g.randrange(4)):
                own[g.randrange(size)] = f"n{g.randrange(9)}"
            rows.append((n, " ".join(own)))
            n += 1
    line = " the same passage of words that many of these documents share with one another here "
    rows += [(n + k, " ".join(f"u{g.randrange(999)}" for _ in range(40)) + line) for k in range(12)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(docs(rows), dense=dense).collect()}
    assert got == brute_groups(rows)


def test_jaccard_edges(docs):
    assert jaccard_join.similar_groups(docs([])).count() == 0
    twice = jaccard_join.similar_groups(docs([(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f")])).collect()
    assert [r.component_id for r in twice] == [4, 4, 4]


def test_jaccard_repeats_and_shared_ids(docs):
    """Repeated rows cost nothing and texts that share an id stay apart."""
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(None, near)] * 3000 + [(None, near + " more")] * 2000 + [(5, "a text that is like no other one here"), (5, near + " even")]
    got = jaccard_join.similar_groups(docs(rows)).collect()
    assert len(got) == 5002 and {(r.n_shingles, r.component_id) for r in got} == {(16, 5), (17, 5), (5, 5)}
    by = {r.n_shingles: r.group_id for r in got}
    assert by[16] == by[17] != by[5]


def test_jaccard_salted_lists(docs, monkeypatch):
    """A list of near copies that is dealt in parts, over several frames, links as brute force does."""
    monkeypatch.setattr(jaccard_join, "PART", 8)
    monkeypatch.setattr(jaccard_join, "RUN_ROWS", 50)
    g = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for n in range(140):
        own = list(base)
        for _ in range(1 + n % 5):
            own[g.randrange(120)] = f"e{g.randrange(9999)}"
        rows.append((n, " ".join(own)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(docs(rows), dense=4).collect()}
    assert got == brute_groups(rows)


def test_components(spark):
    g = random.Random(1)
    edges = [(g.randrange(60), g.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    comp = {}
    for a, b in edges:
        if a is not None and a != b:
            comp.setdefault(a, a)
            comp.setdefault(b, b)
    for _ in range(99):
        for a, b in edges:
            if a in comp and b in comp and a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == comp


def brute_bytes(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = {}
    for _, t in texts:
        for k in range(len(t) - length + 1):
            count[t[k : k + length]] = count.get(t[k : k + length], 0) + 1
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        kept = bytes(b for b, x in zip(t, gone) if not x)
        runs = sum(x and (k == 0 or not gone[k - 1]) for k, x in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, kept))
    return sorted(out)


@pytest.mark.parametrize(("length", "most"), [(200, 20_000), (64, 20_000), (64, 1)])
def test_suffix(docs, length, most):
    g = random.Random(9)
    text = lambda n: "".join(g.choice("abcdé \n") for _ in range(n))
    p, q = text(260), text(300)
    rows = [(1, text(90) + p + text(80)), (2, text(50) + p[20:] + text(10)), (3, p[:230] + q), (4, text(30) + q + text(30)), (5, None), (6, ""), (7, text(150)), (8, "a" * 500), (9, text(40) + "a" * 210), (10, q), (10, q), (11, text(5) + p[5:210] + text(9) + p[5:210])]
    got = sorted(tuple(r)[:4] + (bytes(r.kept),) for r in suffix_dedup.dedup_substrings(docs(rows), length=length, most_runs=most).collect())
    assert got == brute_bytes(rows, length)


def test_suffix_empty(docs):
    assert suffix_dedup.dedup_substrings(docs([])).count() == 0


def test_suffix_levels():
    g = np.random.default_rng(2)
    texts = [g.integers(0, 3, 400).astype(np.uint8) + 97 for _ in range(9)]
    levels = suffix_dedup.SuffixLevels(8)
    seen = {}
    for k, t in enumerate(texts):
        starts = np.arange(len(t) - 7)
        levels.add(t, starts, starts + 1000 * k)
        for s in starts:
            seen.setdefault(t[s : s + 8].tobytes(), []).append(s + 1000 * k)
    assert set(np.concatenate(levels.found).tolist()) == {x for v in seen.values() if len(v) > 1 for x in v}
    assert len(levels.levels) <= 5


def brute_vectors(rows, threshold=0.98):
    out = []
    for i, (vid, v, label) in enumerate(rows):
        n = 0
        for j, (_, w, other) in enumerate(rows):
            n += i != j and linked(v, w, label, other, threshold)
        out.append(n)
    comp = list(range(len(rows)))
    for _ in rows:
        for i, (_, v, a) in enumerate(rows):
            for j, (_, w, b) in enumerate(rows):
                if linked(v, w, a, b, threshold):
                    comp[i] = comp[j] = min(comp[i], comp[j], key=lambda k: rows[k][0])
    return sorted((r[0], n, rows[c][0], r[0] == rows[c][0]) for r, n, c in zip(rows, out, comp))


def linked(v, w, a, b, threshold):
    good = lambda x: x is not None and all(y is not None and np.isfinite(y) for y in x) and any(x)
    if a is None or a != b or not good(v) or not good(w) or len(v) != len(w):
        return False
    v, w = np.array(v, float), np.array(w, float)
    return v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold


@pytest.mark.parametrize("shard", [8192, 40])
def test_vectors(spark, shard):
    g = np.random.default_rng(4)
    base = g.standard_normal((30, 8))
    rows = [(i, (base[i % 30] + g.standard_normal(8) * 0.12).astype(np.float32).tolist(), i % 2) for i in range(110)]
    rows += [(200, rows[3][1], 1), (201, rows[3][1], 1), (202, None, 1), (203, [0.0] * 8, 1), (204, [float("nan")] + [1.0] * 7, 1), (205, [None] + [1.0] * 7, 1), (206, rows[3][1], None), (207, [1.0, 2.0], 1), (208, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 as shard", "2 as cid")
    got = sorted(tuple(r)[:4] for r in embedding_dedup.near_duplicates(df, shard=shard).collect())
    assert got == brute_vectors(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_graph_recall():
    g = np.random.default_rng(6)
    v = g.standard_normal((3000, 16))
    unit = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    graph = embedding_dedup.Graph.build(unit, np.arange(3000))
    ids, _ = graph.search(unit[:200], 48)
    true = np.argsort(-(unit[:200] @ unit.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids.tolist(), true.tolist())]) > 0.9


@pytest.mark.parametrize("rows", [5, 5000])
def test_many_repeated_rows_without_an_id(spark, rows):
    """One text of repeats, in rows that nothing tells apart, and one that shares a passage with it."""
    text, other = "abcdefg " * 190, "x" * 30 + "abcdefg " * 60 + "y" * 30
    frame = spark.createDataFrame([(None, text)] * rows + [(1, other), (2, "z" * 150)], "doc_id bigint, text string").repartition(4)
    began = time.time()
    got = {(r.doc_id, r.n_removed, r.n_spans, len(r.kept)) for r in suffix_dedup.dedup_substrings(frame).collect()}
    assert got == {(None, len(text), 1, 0), (1, 480, 1, 60), (2, 0, 0, 150)} and time.time() - began < 90
