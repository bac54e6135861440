"""Embedding near-dedup: navigable small-world graphs per shard, verified cosines, components.

Equal vectors are one class from the start.  Classes of a label are dealt to shards of a bounded
size; each shard gets a hierarchical navigable small-world graph, stored as one row.  Every class
queries every shard of its label (each pair of shards once, as links are symmetric), as a join of
bounded rows: a graph and a block of queries.  An audit of bounded size compares some queries, and probes made
to link with vectors of the shard, to what the graph finds; beams widen until its recall is as wanted.  Queries
whose beam is full of hits have more links than a beam holds and are compared to the whole shard.
Candidates are verified by cosine in double precision.  A task counts
links and joins components block by block, so pairs of a dense group are never listed; it returns a count
and one edge a class, what its audit measured, and how many queries went beyond the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.components import components
from skein.llm.store import given_back, materialise
from skein.llm.textcols import mix64

THRESHOLD = 0.98
#: Vectors of a shard (about 8 MB of 64 doubles), neighbours of a node, first beam, audited queries and probes of a shard, recall.
SHARD, DEGREE, BEAM, AUDIT, RECALL = 8192, 16, 64, 256, 0.99
#: Random far neighbours of a node, besides its near ones.
FAR = 4
#: Times that a beam is widened by, and the share of a shard from which a beam costs more than the whole.
WIDER, WHOLE = 4, 0.1
#: Queries that are compared to a whole shard together.
ROWS = 512
_SLACK = 1e-5
_GRAPH = "grp bigint, shard int, n int, dim int, ids binary, sizes binary, vectors binary, layers array<binary>, links array<binary>"


def normal(x: np.ndarray) -> np.ndarray:
    """Unit vectors in doubles; the largest component is made 1 first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return normal(x).astype(np.float32)


class Graph:
    """Layers of neighbour lists over unit vectors; layer 0 has all nodes."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray], links: list[np.ndarray]):
        self.unit, self.layers, self.links = unit, layers, links

    @classmethod
    def build(cls, unit: np.ndarray, ids: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> Graph:
        """Nodes enter in batches as large as the graph, at most 512; levels come from a hash of the id."""
        draw = (mix64(ids.astype(np.uint64)) >> np.uint64(11)).astype(float) / 2**53
        level = np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(degree)).astype(int)
        layers, links = [], []
        for depth in range(int(level.max()) + 1 if len(level) else 0):
            own = np.flatnonzero(level >= depth)
            if depth and len(own) < 4:
                break
            layers.append(own)
        graph = cls(unit, [], [])
        for own in reversed(layers):
            width = degree * (2 if len(own) == len(unit) else 1)
            links.insert(0, graph._layer(own, width, degree, beam))
            graph.layers.insert(0, own)
            graph.links.insert(0, links[0])
        return graph

    def _layer(self, own: np.ndarray, width: int, degree: int, beam: int) -> np.ndarray:
        """Neighbour lists of one layer (places in ``own``, -1 for none)."""
        links = np.full((len(own), width), -1, np.int32)
        near = np.full((len(own), width), -2.0, np.float32)
        v = self.unit[own]
        done = 0
        while done < len(own):
            size = min(max(done, 64), 512, len(own) - done)
            new = np.arange(done, done + size)
            found, sims = [], []
            if done:
                ids, s = beam_search(v, links, v[new], self._entries(own[:done], v[:done], v[new]), max(beam, degree))
                found.append(ids[:, :degree])
                sims.append(s[:, :degree])
            inner = v[new] @ v[new].T
            np.fill_diagonal(inner, -2)
            k = min(degree, size - 1)
            if k > 0:
                top = np.argpartition(-inner, k - 1, axis=1)[:, :k]
                found.append(new[top])
                sims.append(np.take_along_axis(inner, top, 1))
            if found:
                ids, s = np.concatenate(found, 1), np.concatenate(sims, 1)
                order = np.argsort(-s, axis=1, kind="stable")[:, :degree]
                ids, s = np.take_along_axis(ids, order, 1), np.take_along_axis(s, order, 1)
                a = np.repeat(new, ids.shape[1])
                ok = (ids.ravel() >= 0) & (s.ravel() > -2)
                a, b, w = a[ok], ids.ravel()[ok], s.ravel()[ok]
                _connect(links, near, np.append(a, b), np.append(b, a), np.append(w, w))
            done += size
        far = np.random.default_rng(2).integers(0, len(own), (len(own), FAR)).astype(np.int32)
        return np.concatenate([links, far], axis=1)  # tight groups far from each other would else be graphs of their own

    def _entries(self, inserted: np.ndarray, v: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Where a layer's search starts: the best nodes of the layer above that it has."""
        if self.layers:
            at = np.flatnonzero(np.isin(inserted, self.layers[0]))
            at = at if len(at) else np.array([0])
        else:
            at = np.arange(min(len(v), 64))
        s = queries @ v[at].T
        k = min(4, len(at))
        return at[np.argpartition(-s, k - 1, axis=1)[:, :k]]

    def search(self, queries: np.ndarray, beam: int, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, similarities) of up to ``beam`` nodes for each query, best first; ``places`` of queries that are nodes are entries too."""
        if not self.layers:
            return np.empty((len(queries), 0), np.int64), np.empty((len(queries), 0), np.float32)
        top = self.layers[-1][:256]
        s = queries @ self.unit[top].T
        k = min(4, len(top))
        entry = top[np.argpartition(-s, k - 1, axis=1)[:, :k]]
        for own, links in zip(self.layers[:0:-1], self.links[:0:-1], strict=True):
            ids, _ = beam_search(self.unit[own], links, queries, np.searchsorted(own, entry), 4)
            entry = own[np.where(ids >= 0, ids, ids[:, :1])]
        if places is not None:
            entry = np.concatenate([places[:, None], entry], axis=1)
        return beam_search(self.unit, self.links[0], queries, entry, beam)


def _connect(links: np.ndarray, near: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
    """Add edges a -> b of weight w; a full list keeps its nearest, and each neighbour once."""
    touched = np.unique(a)
    width = links.shape[1]
    old = np.repeat(touched, width)
    a, b, w = np.append(old, a), np.append(links[touched].ravel(), b), np.append(near[touched].ravel(), w)
    ok = b >= 0
    a, b, w = a[ok], b[ok], w[ok]
    _, first = np.unique(a * np.int64(len(links)) + b, return_index=True)
    a, b, w = a[first], b[first], w[first]
    order = np.lexsort((b, -w, a))
    a, b, w = a[order], b[order], w[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a, "left")
    ok = rank < width
    links[touched], near[touched] = -1, -2.0
    links[a[ok], rank[ok]], near[a[ok], rank[ok]] = b[ok], w[ok]


def beam_search(v: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search for many queries together; each step opens up to ``at_once`` nodes of each beam."""
    out_ids, out_sims = [], []
    beam = min(beam, len(v))
    for lo in range(0, len(queries), 256):
        q = queries[lo : lo + 256]
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), len(v) + 1), bool)
        seen[:, -1] = True
        ids = entry[lo : lo + 256].astype(np.int64)
        ids = np.where(_repeats(ids), -1, ids)
        seen[rows, ids] = True
        sims = np.where(ids >= 0, np.einsum("qd,qkd->qk", q, v[ids]), -2.0).astype(np.float32)
        opened = ids < 0
        while True:
            left = np.where(opened, -3.0, sims)
            k = min(at_once, left.shape[1])
            pick = np.argpartition(-left, k - 1, axis=1)[:, :k]
            ok = np.take_along_axis(left, pick, 1) > -3
            if not ok.any():
                break
            np.put_along_axis(opened, pick, True, 1)
            new = np.where(ok[:, :, None], links[np.take_along_axis(ids, pick, 1)], -1).reshape(len(q), -1).astype(np.int64)
            new = np.where(seen[rows, new], -1, new)
            new = np.where(_repeats(new), -1, new)
            seen[rows, new] = True
            s = np.where(new >= 0, np.einsum("qd,qkd->qk", q, v[new]), -2.0).astype(np.float32)
            ids, sims, opened = np.concatenate([ids, new], 1), np.concatenate([sims, s], 1), np.concatenate([opened, new < 0], 1)
            if ids.shape[1] > beam:
                keep = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
                ids, sims, opened = (np.take_along_axis(x, keep, 1) for x in (ids, sims, opened))
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        fill = beam - ids.shape[1]
        out_ids.append(np.pad(ids, ((0, 0), (0, fill)), constant_values=-1) if fill > 0 else ids)
        out_sims.append(np.pad(sims, ((0, 0), (0, fill)), constant_values=-2) if fill > 0 else sims)
    return np.concatenate(out_ids), np.concatenate(out_sims)


def _repeats(ids: np.ndarray) -> np.ndarray:
    order = np.argsort(ids, axis=1, kind="stable")
    s = np.take_along_axis(ids, order, 1)
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = s[:, 1:] == s[:, :-1]
    out = np.empty_like(again)
    np.put_along_axis(out, order, again, 1)
    return out


def _probes(base: np.ndarray, threshold: float, picked: np.ndarray) -> np.ndarray:
    """Unit vectors whose cosine with the picked vectors of a shard is just above the threshold, in random directions."""
    g = np.random.default_rng(1)
    own = base[picked]
    off = g.standard_normal(own.shape)
    off -= (off * own).sum(axis=1, keepdims=True) * own
    size = np.linalg.norm(off, axis=1, keepdims=True)
    near = threshold + 0.02 * (1 - threshold)
    return np.where(size > 1e-9, near * own + np.sqrt(1 - near * near) * off / np.maximum(size, 1e-9), own)


def _good_beam(graph: Graph, exact: np.ndarray, base: np.ndarray, threshold: float, beam: int, recall: float, audit: int, same: bool, told: dict) -> int | None:
    """The first beam whose recall is good enough on an audit of bounded size, or None if such a beam costs more than the whole shard.

    Audited are ``audit`` random queries with their true links, and ``audit`` probes: vectors made to link
    with random ones of the shard, so that a shard with few links, or none, is audited too.  Nothing but the
    beam's width comes of it.
    """
    g = np.random.default_rng(0)
    own = g.permutation(len(exact))[:audit]
    true = exact[own] @ base.T >= threshold
    if same:
        true[np.arange(len(own)), own] = False
    picked = g.permutation(len(base))[:audit]
    asked, probes = exact[own].astype(np.float32), _probes(base, threshold, picked).astype(np.float32)
    row, place = np.nonzero(np.concatenate([true, np.zeros((len(picked), len(base)), bool)]))
    row, place = np.append(row, len(own) + np.arange(len(picked))), np.append(place, picked)
    size = np.bincount(row, minlength=len(own) + len(picked))
    while True:
        ids, sims = (np.concatenate(x) for x in zip(graph.search(asked, beam, own if same else None), graph.search(probes, beam), strict=True))
        full = _full(ids, sims, threshold, beam, len(base))
        hit = full[row] | (ids[row] == place[:, None]).any(axis=1)
        share = np.bincount(row, hit, len(size))[size > 0] / size[size > 0]
        linked = share[: np.count_nonzero(size[: len(own)])]
        told |= {"queries": len(share), "found": float(share.sum()), "beam": beam}
        if share.mean() >= recall and (not len(linked) or linked.mean() >= recall):
            return beam
        if beam >= len(base) or beam * WIDER > max(WHOLE * len(base), BEAM):
            told["found"] = float(len(share))
            return None
        beam *= WIDER


def _full(ids: np.ndarray, sims: np.ndarray, threshold: float, beam: int, n: int) -> np.ndarray:
    """Queries whose beam is full of hits, and may have more."""
    return (sims[:, -1] >= threshold - _SLACK) & (ids[:, -1] >= 0) if beam < n else np.zeros(len(ids), bool)


def range_search(
    graph: Graph, vectors: np.ndarray, queries: np.ndarray, threshold: float, beam: int = BEAM, recall: float = RECALL, audit: int = AUDIT, same: bool = False, told: dict | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(query, place, whole) in blocks: the pairs found with cosine >= threshold, verified in doubles, and whether the queries were compared to the whole shard.

    Each query is in the pairs of one kind only, and every query asks the graph.  An audit of bounded size
    widens the beam first.  Queries whose beam is full of hits are then compared to the whole shard, and so
    are all if no beam of at most ``WHOLE`` of the shard is good enough; ``told`` gets their number
    (``whole``), that of all queries (``asked``), and the audit's queries, sum of shares found and beam.
    ``same``: the queries are the shard's own vectors, whose pairs with themselves are left out.
    """
    exact, base = normal(queries), normal(vectors)
    told = {} if told is None else told
    wide = _good_beam(graph, exact, base, threshold, beam, recall, audit, same, told)
    todo = []
    for lo in range(0, len(exact) if wide else 0, ROWS):
        part = exact[lo : lo + ROWS].astype(np.float32)
        ids, sims = graph.search(part, wide, lo + np.arange(len(part)) if same else None)
        full = _full(ids, sims, threshold, wide, len(base))
        q, place = np.nonzero((sims >= threshold - _SLACK) & ~full[:, None])
        p = ids[q, place]
        q = q + lo
        ok = (np.einsum("nd,nd->n", exact[q], base[p]) >= threshold) & ((q != p) | (not same))
        todo.append(lo + np.flatnonzero(full))
        yield q[ok], p[ok], False
    todo = np.concatenate(todo) if wide else np.arange(len(exact))
    told |= {"asked": len(exact), "whole": len(todo)}
    for lo in range(0, len(todo), ROWS):
        own = todo[lo : lo + ROWS]
        q, p = np.nonzero(exact[own] @ base.T >= threshold)
        q = own[q]
        yield (q[q != p], p[q != p], True) if same else (q, p, True)


class Links:
    """Link counts and components of a block, without lists of pairs."""

    def __init__(self, n: int, m: int, same: bool, sizes: np.ndarray, q_sizes: np.ndarray):
        self.n, self.same, self.sizes, self.q_sizes = n, same, sizes, q_sizes
        self.base, self.query = np.zeros(n), np.zeros(m)
        self.root = np.arange(n if same else n + m)
        self.whole = np.zeros(m, bool)
        self.kept: list[np.ndarray] = []

    def add(self, q: np.ndarray, p: np.ndarray, whole: bool) -> None:
        self._join(q if self.same else q + self.n, p)
        if not self.same:
            self.query += np.bincount(q, self.sizes[p], len(self.query))
            self.base += np.bincount(p, self.q_sizes[q], self.n)
        elif whole:  # these queries' own counts are complete; the others are told of them
            self.whole[q] = True
            self.query += np.bincount(q, self.sizes[p], len(self.query))
            self.kept.append(np.stack([p, q]))
        else:
            self.kept += [np.stack([q, p]), np.stack([p, q])]
        if sum(x.shape[1] for x in self.kept) > 8_000_000:
            self.kept = [self._pairs()]

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (up := self.root[self.root] != self.root).any():
                self.root[up] = self.root[self.root[up]]

    def _pairs(self) -> np.ndarray:
        """Of the pairs kept, the different ones of queries whose counts are not complete."""
        q, p = np.concatenate([np.empty((2, 0), np.int64), *self.kept], axis=1)
        key = np.unique((q * np.int64(self.n) + p)[~self.whole[q]])
        return np.stack([key // self.n, key % self.n])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(of the shard's vectors, of the queries)."""
        if not self.same:
            return self.base, self.query
        q, p = self._pairs()
        self.query += np.bincount(q, self.sizes[p], len(self.query))
        return self.query, np.zeros(0)


def _building(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("cid")
    vectors = np.array(rows["embedding"].tolist(), float)
    ids = rows["cid"].to_numpy(np.int64)
    graph = Graph.build(_unit(vectors), ids)
    return pd.DataFrame(
        {
            "grp": [rows["grp"].iloc[0]], "shard": [rows["shard"].iloc[0]], "n": [len(rows)], "dim": [vectors.shape[1]], "ids": [ids.tobytes()],
            "sizes": [rows["size"].to_numpy(np.int64).tobytes()], "vectors": [vectors.tobytes()],
            "layers": [[x.astype("<i8").tobytes() for x in graph.layers]], "links": [[x.tobytes() for x in graph.links]],
        }
    )


def _querying(threshold: float, recall: float):
    """Rows of a block: kind 0, a class's links (a, n); kind 1, an edge of a component (a, b); kind 2, an audit (a: the group, b: queries, n: millionths found); kind 3, (a: the group, b: queries, n: those compared to the whole shard)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                vectors = np.frombuffer(r.vectors).reshape(r.n, r.dim)
                ids, sizes = np.frombuffer(r.ids, np.int64), np.frombuffer(r.sizes, np.int64)
                layers = [np.frombuffer(x, "<i8") for x in r.layers]
                graph = Graph(_unit(vectors), layers, [np.frombuffer(x, np.int32).reshape(len(own), -1) for own, x in zip(layers, r.links, strict=True)])
                same = r.shard == r.q_shard
                queries = np.frombuffer(r.q_vectors).reshape(r.q_n, r.dim)
                q_ids, q_sizes = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.q_sizes, np.int64)
                told: dict = {}
                links = Links(r.n, r.q_n, same, sizes, q_sizes)
                for q, p, whole in range_search(graph, vectors, queries, threshold, recall=recall, same=same, told=told):
                    links.add(q, p, whole)
                every = ids if same else np.append(ids, q_ids)
                count = np.concatenate(links.counts()).astype(np.int64)
                some = np.flatnonzero(count)
                yield pd.DataFrame({"a": every[some], "b": -1, "n": count[some], "kind": 0})
                moved = np.flatnonzero(links.root != np.arange(len(links.root)))
                yield pd.DataFrame({"a": every[moved], "b": every[links.root[moved]], "n": 0, "kind": 1})
                yield pd.DataFrame({"a": [r.grp] * 2, "b": [told["queries"], told["asked"]], "n": [round(told["found"] * 1e6), told["whole"]], "kind": [2, 3]})

    return given_back(run)


def near_duplicates(
    table: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, shard: int = SHARD, recall: float = RECALL
) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall, whole_share) for every row of ``table``.

    Rows link when their labels are equal and not null, their vectors of one length, and the cosine
    reaches ``threshold``.  Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing.  Equal vectors always link; repeated rows are vectors of their own.  component_id is
    the smallest id reached (a null id is never one, unless it is alone), kept says that it is the row's
    own; vectors that share an id are different vectors.  recall is what the audits of the label's shards
    measured in the mean, and whole_share the share of its queries that were compared to a whole shard (null without a
    label or a vector).  Other columns are not read.
    """
    spark = table.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    v = F.col("v")
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    able = F.coalesce(F.col("label").isNotNull() & v.isNotNull() & finite, F.lit(False))
    same_zero = F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    rows = rows.select("id", F.when(able, F.xxhash64("label", F.size("v"))).alias("grp"), F.when(able, F.xxhash64("label", same_zero)).alias("cid"), F.when(able, v).alias("v"))
    classes = rows.filter("cid IS NOT NULL").groupBy("grp", "cid").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("v").alias("embedding"))
    classes = materialise(classes, "vectors")
    parts = classes.groupBy("grp").agg(F.ceil(F.count("*") / shard).alias("parts"))
    dealt = classes.join(parts, "grp").select("grp", F.pmod(F.xxhash64(F.lit(7), "cid"), "parts").cast("int").alias("shard"), "cid", "size", "embedding")
    graphs = materialise(dealt.groupBy("grp", "shard").applyInPandas(_building, _GRAPH), "graphs")
    asking = graphs.select("grp", F.col("shard").alias("q_shard"), F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("sizes").alias("q_sizes"), F.col("vectors").alias("q_vectors"))
    asking = asking.withColumn("shard", F.explode(F.sequence(F.lit(0), "q_shard")))
    pairs = graphs.join(asking, ["grp", "shard"]).repartition("grp", "shard", "q_shard")
    met = materialise(pairs.mapInPandas(_querying(threshold, recall), "a bigint, b bigint, n bigint, kind int"), "met")
    counts = met.filter("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("near"))
    audits = met.filter("kind = 2").groupBy(F.col("a").alias("grp")).agg(F.try_divide(F.sum("n"), F.sum("b") * 1_000_000).alias("recall"))
    beyond = met.filter("kind = 3").groupBy(F.col("a").alias("grp")).agg((F.sum("n") / F.sum("b")).alias("whole_share"))
    audits = audits.join(beyond, "grp")
    comp = components(met.filter("kind = 1").select("a", "b"))
    comp = materialise(comp.join(classes.select(F.col("cid").alias("node"), "rep"), "node"), "components")
    least = comp.groupBy("component").agg(F.min("rep").alias("least"))
    named = comp.join(least, "component").select(F.col("node").alias("cid"), F.lit(True).alias("linked"), "least")
    info = classes.select("grp", "cid", "size", "rep").join(named, "cid", "left").join(counts, "cid", "left").join(audits, "grp", "left")
    component = F.when(F.col("linked"), F.col("least")).otherwise(F.col("rep"))
    info = info.select("cid", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), component.alias("component"), "recall", "whole_share")
    done = rows.select("id", "cid").join(info, "cid", "left")
    component = F.coalesce("component", "id")
    return done.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), "recall", "whole_share"
    )


def op10_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all rows of ``embeddings``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("recall", "whole_share")


def op10_search_audit(spark, sf_dir: str) -> DataFrame:
    """What the audits of ``embeddings`` measured for each label: recall, and the share of queries beyond the graph."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    labels = table.select("vec_id", "label").filter("label IS NOT NULL")
    done = near_duplicates(table).filter("recall IS NOT NULL").select("vec_id", "recall", "whole_share", "n_links")
    return labels.join(done, "vec_id").groupBy("label").agg(F.count("*").alias("vectors"), F.sum("n_links").alias("links"), F.max("recall").alias("recall"), F.max("whole_share").alias("whole_share"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
       WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS (SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT r, vec_id AS c FROM v UNION SELECT l.b, reach.c FROM reach JOIN l ON l.a = reach.r),
comp AS (SELECT r, min(c) AS component_id FROM reach GROUP BY r),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN comp USING (r) LEFT JOIN n ON n.a = v.r
"""
