import collections

import numpy as np
import pytest

from skein.llm import embedding_dedup


def clusters(seed, sizes, dim=24, spread=0.01):
    """Tight groups far from each other: neighbour lists stay within a group, and the graph falls into parts."""
    g = np.random.default_rng(seed)
    return np.concatenate([g.standard_normal(dim) + spread * g.standard_normal((n, dim)) for n in sizes])


def brute(v, q, threshold=0.98):
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    return {(a, b) for a, b in np.argwhere(unit(q) @ unit(v).T >= threshold).tolist()}


def found(v, q, told=None, **how):
    graph = embedding_dedup.Graph.build(embedding_dedup._unit(v), np.arange(len(v)))
    blocks = list(embedding_dedup.range_search(graph, v, q, 0.98, told=told, **how))
    pairs = [x for a, b, _ in blocks for x in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(set(pairs)) == len(pairs)
    return set(pairs)


def test_links_beside_the_audit_are_found():
    """Few queries have links, and none of those that a fixed step would audit."""
    v = clusters(1, [40] * 100)
    q = np.random.default_rng(2).standard_normal((640, 24))
    q[5::40] = v[100::240][:16] + 1e-3
    want = brute(v, q)
    assert want and found(v, q) == want


@pytest.mark.parametrize("sizes", [[20] * 20 + [1] * 20, [20] * 2 + [1] * 3])
def test_small_shards_are_exact(sizes):
    v = clusters(3, sizes)
    assert found(v, v, same=True) == {(a, b) for a, b in brute(v, v) if a != b}


def test_large_groups_do_not_outweigh_small_ones():
    """Mean recall of the queries with links, apart from the pairs of vectors with themselves."""
    v = clusters(4, [600] + [2] * 1000)
    want = brute(v, v)
    got = found(v, v, same=True)
    near = collections.defaultdict(list)
    for a, b in want:
        if a != b:
            near[a].append(b)
    own = [near[i] for i in range(600, 1000)]
    assert got <= want and np.mean([np.mean([(600 + i, b) in got for b in x]) for i, x in enumerate(own) if x]) >= 0.97


@pytest.mark.parametrize("sizes", [[3] * 200 + [1] * 7592, [3000] + [40] * 60 + [1] * 2792])
def test_recall_on_full_shards(sizes):
    """Shards of 8192 with few and with many links; the audit's own figure agrees."""
    v, told = clusters(5, sizes), {}
    assert len(v) == 8192
    graph = embedding_dedup.Graph.build(embedding_dedup._unit(v), np.arange(len(v)))
    links = embedding_dedup.Links(len(v), len(v), True, np.ones(len(v), np.int64), np.ones(len(v), np.int64))
    for q, p, whole in embedding_dedup.range_search(graph, v, v, 0.98, same=True, told=told):
        links.add(q, p, whole)
    unit = embedding_dedup.normal(v)
    true = np.concatenate([(unit[lo : lo + 512] @ unit.T >= 0.98).sum(axis=1) - 1 for lo in range(0, len(v), 512)])
    got, _ = links.counts()
    assert (got <= true).all() and (got[true > 0] / true[true > 0]).mean() >= 0.99
    assert told["queries"] >= 256 and told["found"] / told["queries"] >= 0.99 and told["asked"] == 8192
    assert told["whole"] <= 0.5 * 8192
    ends = np.cumsum(sizes)
    for lo, hi in zip(ends - sizes, ends, strict=True):
        assert len(set(links.root[lo:hi].tolist())) == 1


@pytest.mark.parametrize("n", [300, 8192])
def test_the_graph_is_asked_and_answers(monkeypatch, n):
    """Random vectors with few links: every query asks the graph, and links come from it alone."""
    g = np.random.default_rng(6)
    v = g.standard_normal((n, 64))
    v[n - 20 :] = v[:20] + 0.05 * g.standard_normal((20, 64))
    asked, told = [], {}
    search = embedding_dedup.Graph.search
    monkeypatch.setattr(embedding_dedup.Graph, "search", lambda self, q, *more: asked.append(len(q)) or search(self, q, *more))
    want = {(a, b) for a, b in brute(v, v) if a != b}
    got = found(v, v, same=True, told=told)
    assert sum(asked) >= n and told["whole"] == 0 and told["asked"] == n
    assert got <= want and len(want) == 40 and len(got | {(b, a) for a, b in got}) >= 0.95 * len(want)


def test_very_large_and_very_small_components(spark):
    rows = [(1, [1e200, 2e200], 1), (2, [2e200, 4e200], 1), (3, [5e-324, 1e-323], 1), (4, [1e-200, -1e-200], 1), (5, [1.0, 2.0], 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 0, 4), (5, 3, 1)]


def test_vectors_that_share_an_id(spark):
    rows = [(7, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (9, [0.0, 1.001], 1), (None, [1.0, 0.001], 1), (3, [-1.0, 0.0], 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), shard=2).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id) for r in got) == [(-1, 1, 7), (3, 0, 3), (7, 1, 7), (7, 1, 7), (9, 1, 7)]
    assert all(r.recall == 1.0 for r in got)
