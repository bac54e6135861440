import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.llm import quality

BASE = os.environ.get("SKEIN_TESTDATA", "/root/testdata")


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def plain_statistics(text):
    """Some of the statistics, straight from their definition."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    lines = [x for x in data.split(b"\n") if x]
    again = [i > 0 and words[i] == words[i - 1] for i in range(len(words))]
    worst = 0.0
    for lo in range(0, max(1, len(words) - quality.SPAN + quality.STRIDE), quality.STRIDE):
        worst = max(worst, sum(again[lo : lo + quality.SPAN]) / quality.SPAN)
    return {
        0: sum(65 <= b <= 90 for b in data) / max(len(data), 1),
        9: -sum(data.count(b) / len(data) * math.log2(data.count(b) / len(data)) for b in set(data)),
        10: math.log1p(len(data)),
        11: math.log1p(len(words)),
        12: math.log1p(len(set(words))),
        13: max((words.count(w) for w in set(words)), default=0) / max(len(words), 1),
        14: sum(map(len, words)) / max(len(words), 1),
        16: sum(w[-1:] in (b".", b"!", b"?") for w in words) / max(len(words), 1),
        17: len(set(words)) / max(len(words), 1),
        21: sum(again) / max(len(words), 1),
        24: math.log1p(len(lines)),
        26: len(set(lines)) / max(len(lines), 1),
        30: worst,
    }


def test_statistics_against_plain_ones():
    g = random.Random(1)
    texts = [None, "", " ", "\n\n", "a", "A A A a", "é é\né é\n", "x" * 5000, "No no no! Yes?\nNo no no! Yes?"]
    texts += [" ".join(g.choice(["the", "of", "!!", "of.", "ABC", "a|b", "\n", "ß", "\x00"]) for _ in range(g.randrange(200))) for _ in range(60)]
    x = quality.statistics(pa.array(texts))
    assert x.shape == (len(texts), quality.N_STATS) and np.isfinite(x).all() and not x[:2].any()
    for row, text in zip(x, texts, strict=True):
        assert all(row[k] == pytest.approx(v, abs=1e-9) for k, v in plain_statistics(text).items())
    assert (quality.statistics(pa.array(texts[5:20])) == x[5:20]).all() and quality.statistics(pa.array([], pa.string())).shape == (0, quality.N_STATS)


def test_isotonic_against_its_formula():
    g = np.random.default_rng(2)
    for _ in range(50):
        k = int(g.integers(1, 12))
        cell = g.permutation(quality.CELLS)[:k]
        n = g.integers(1, 5, k)
        good = np.array([g.integers(0, m + 1) for m in n])
        order = np.argsort(cell)
        c, m, y = cell[order], n[order], good[order]
        best = [max(min(y[j : e + 1].sum() / m[j : e + 1].sum() for e in range(i, k)) for j in range(i + 1)) for i in range(k)]
        at, value = quality.isotonic(cell, n, good)
        assert (np.diff(at) > 0).all() and (np.diff(value) > 0).all() and set(np.round(value, 12)) == set(np.round(best, 12))
        assert sum(m) * np.average(best, weights=m) == pytest.approx(y.sum()) and ((at >= c[0] * 3 / quality.CELLS - 1) & (at <= (c[-1] + 1) * 3 / quality.CELLS - 1)).all()


def test_fit_is_ridge_over_all_rows(spark, docs):
    g = random.Random(4)
    rows = [(i, " ".join(g.choice(["good", "prose", "and", "words"] if i % 3 else ["###", "BAD", "***"]) for _ in range(g.randrange(5, 90)))) for i in range(300)]
    frame = docs(rows).repartition(6)
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(300)] + [(1, None), (2, 7), (None, 1), (5, 0)], "doc_id bigint, quality int")
    model = quality.fit(quality.with_statistics(frame), labels)
    own = [i for i in range(300) if not held_out(i)]
    x, y = quality.statistics(pa.array([rows[i][1] for i in own])), np.array([i % 3 > 0 for i in own], float)
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1))
    z = model.features(x)[:, :-1]
    want = np.linalg.solve(z.T @ z + quality.RIDGE * len(own) * np.eye(quality.FEATURES), z.T @ (y - y.mean()))
    assert np.allclose(z @ model.weights[:-1, 0], z @ want, atol=1e-6) and model.weights[-1, 0] == pytest.approx(y.mean())
    got = quality.score_quality(frame, labels).collect()
    assert len(got) == 300 and all(r.predicted == (1 if r.doc_id % 3 else 0) for r in got if r.held_out)


def test_kernel_is_gaussian():
    g = np.random.default_rng(0)
    x = g.standard_normal((40, quality.N_STATS))
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    model = quality.Model(np.zeros(quality.N_STATS), np.ones(quality.N_STATS))
    z = model.features(x)[:, :-1]
    assert np.abs(z @ z.T - np.exp(-far / (2 * quality.WIDTH**2 * quality.N_STATS))).mean() < 0.06


def test_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = [(1, None), (2, ""), (3, "a"), (3, "b"), (3, "b"), (None, "x"), (4, "long text " * 60_000)]
    got = quality.score_quality(docs(rows), none).collect()
    assert len(got) == 7 and all(r.score == quality.UNTOLD and r.predicted == 0 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
    for label in (0, 1):
        told = spark.createDataFrame([(i, label) for i in range(10)], "doc_id bigint, quality int")
        assert all(r.score == label == r.predicted for r in quality.score_quality(docs(rows), told).collect())
    assert quality.score_quality(docs([]), none).columns == ["doc_id", "held_out", "score", "predicted"] and quality.score_quality(docs([]), none).count() == 0


@pytest.mark.skipif(not os.path.isdir(f"{BASE}/sf0.1"), reason="no test tables")
def test_held_out_documents(spark):
    path = f"{BASE}/sf0.1"
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{path}/labels.parquet").filter("quality IS NOT NULL").collect()}
    rows = quality.op11_quality(spark, path).collect()
    assert len(rows) == spark.read.parquet(f"{path}/documents.parquet").count() and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and r.doc_id in known]
    bad, good = ([r for r in judged if known[r.doc_id] == k] for k in (0, 1))
    assert sum(r.predicted == 0 for r in bad) >= 0.95 * len(bad) > 100 and sum(r.predicted == 1 for r in good) >= 0.99 * len(good)
    unlabelled = spark.read.parquet(f"{path}/labels.parquet").filter("false")
    held = quality.score_quality(spark.read.parquet(f"{path}/documents.parquet").limit(5).withColumn("lang", F.lit(None)), unlabelled)
    assert held.count() == 5
