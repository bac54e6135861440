import os

import numpy as np
import pytest

from skein.llm import embedding_whitening as ew

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, n int, component string"
BASE = os.environ.get("SKEIN_TESTDATA", "/root/testdata")


def table(spark, vectors, parts=5):
    return spark.createDataFrame([(i, v, 1, "a", 2, "b") for i, v in enumerate(vectors)], SCHEMA).repartition(parts)


def brute(vectors):
    """By eigenvectors of the covariance, in whole numbers and doubles."""
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    value, axes = np.linalg.eigh(c.T @ c / n)
    value, axes = value[::-1], axes[:, ::-1]
    return x, n, ((n * x - s) ** 2).sum(axis=1), value, c @ axes / np.sqrt(np.maximum(value, 1e-300))


def check(got, vectors, k):
    x, n, deviation, value, white = brute(vectors)
    assert len(got) == len(vectors) * k and all(r.n == n and r.deviation == deviation[r.vec_id] for r in got)
    for c in range(1, k + 1):
        own = sorted((r for r in got if r.component == c), key=lambda r: r.vec_id)
        w = np.array([r.whitened for r in own])
        assert np.allclose(w * np.sign(w[np.abs(w).argmax()]), white[:, c - 1] * np.sign(white[np.abs(w).argmax(), c - 1]), atol=1e-7)
        assert all(abs(r.explained / (value[c - 1] / value.sum()) - 1) < 1e-9 and r.identity_error < 1e-9 for r in own)


def test_equals_eigenvectors_of_the_covariance(spark):
    g = np.random.default_rng(3)
    vectors = (g.standard_normal((700, 12)) @ g.standard_normal((12, 12)) + 5).tolist()
    vectors += vectors[:40]  # repeated rows count
    check(ew.whiten(table(spark, vectors, 40)).collect(), [*vectors], 8)


def test_many_partitions_merge_in_rounds(spark):
    g = np.random.default_rng(4)
    vectors = g.standard_normal((300, 3)).tolist()
    check(ew.whiten(table(spark, vectors, 150)).collect(), vectors, 3)


def test_unusable_vectors_and_extra_columns(spark):
    inf, nan = float("inf"), float("nan")
    good = [[0.0, 1.0], [2.0, 0.5], [-1.0, 4.0]]
    rows = table(spark, [*good, None, [None, 1.0], [nan, 0.0], [inf, 1.0], [1.0, -inf]])
    got = ew.whiten(rows).collect()
    assert {r.vec_id for r in got} == {0, 1, 2}
    check(got, good, 2)
    assert ew.whiten(rows.filter("vec_id > 2")).collect() == [] and ew.whiten(table(spark, [[], []])).count() == 0
    assert ew.whiten(rows.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_no_variance(spark):
    for vectors in ([[1.0, 2.0]], [[1.0, 2.0]] * 5):
        got = ew.whiten(table(spark, vectors)).collect()
        assert len(got) == 2 * len(vectors) and all(r.whitened is None and r.explained == 0 and r.identity_error is None and r.deviation == 0 for r in got)
    got = ew.whiten(table(spark, [[1.0, 2.0, 3.0], [2.0, 4.0, 6.0], [4.0, 8.0, 12.0]])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in got) and all(r.identity_error < 1e-9 for r in got)
    assert sum(r.whitened**2 for r in got if r.component == 1) == pytest.approx(3)


def test_sums_and_deviations_are_exact_beyond_doubles(spark):
    big = [[float(2**40)], [0.0], [0.0]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(big)], "vec_id bigint, embedding array<double>")
    n, sums = ew.exact_sums(ew.whole_vectors(rows, "embedding"))
    assert (n, sums) == (3, [2**50 + 300_000])
    with pytest.raises(Exception, match="too large for a long"):
        ew.whiten(rows).collect()
    with pytest.raises(Exception, match="too large to be a whole"):
        ew.whiten(spark.createDataFrame([(1, [1e300])], "vec_id bigint, embedding array<double>")).collect()
    assert ew.Centre.of(3, [0]).deviations(np.array([[10**9]]))[0] == 9 * 10**18
    assert ew.Centre.of(7, [10**9 + 3]).deviations(np.array([[10**8 + 11]]))[0] == (7 * (10**8 + 11) - 10**9 - 3) ** 2


def test_vectors_of_different_lengths(spark):
    with pytest.raises(Exception, match="differ in length"):
        ew.whiten(table(spark, [[1.0], [1.0, 2.0]], 1)).collect()
    with pytest.raises(Exception, match="differ in length"):
        ew.whiten(table(spark, [[1.0], [1.0, 2.0]], 2)).collect()


@pytest.mark.skipif(not os.path.isdir(f"{BASE}/sf0.01"), reason="no test tables")
def test_the_query_against_brute_force(spark):
    path = f"{BASE}/sf0.01"
    kept = [r for r in spark.read.parquet(f"{path}/embeddings.parquet").collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]
    at = {r.vec_id: i for i, r in enumerate(kept)}
    assert len(at) == len(kept)
    got = [type(r)(**{**r.asDict(), "vec_id": at[r.vec_id]}) for r in ew.op13_whitening(spark, path).collect()]
    check(got, [r.embedding for r in kept], 8)
