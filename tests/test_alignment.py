"""Alignments of many strings at once against one by one."""

import random

import numpy as np
import pytest

from skein.operators import alignment

GLYPHS, MARKS = "page int, string int, x double, p array<double>, y int", "page int, string int, x double, c int, soft boolean, y int"


def one_by_one(p, marks, other):
    """Straight from the definition, by a memo over places from the end."""
    lp = [[-np.log(max(1e-4, q)) for q in row] for row in p]
    best = {}
    for i in range(len(p) + 1):
        for j in range(len(marks) + 1):
            ways = []
            if i and j:
                ways.append((best[i - 1, j - 1][0] + lp[i - 1][marks[j - 1][0]], 0))
            if i:
                ways.append((best[i - 1, j][0] + lp[i - 1][other], 1))
            if j:
                ways.append((best[i, j - 1][0] + (2.5 if marks[j - 1][1] else 6), 2))
            best[i, j] = min(ways) if ways else (0.0, -1)
    match, i, j = [None] * len(marks), len(p), len(marks)
    while i or j:
        step = best[i, j][1]
        if step == 0:
            match[j - 1] = i - 1
        i, j = i - (step != 2), j - (step != 1)
    return match, best[len(p), len(marks)][0]


@pytest.mark.parametrize("cells", [1 << 21, 60])
def test_marks(spark, monkeypatch, cells):
    monkeypatch.setattr(alignment, "CELLS", cells)
    g = random.Random(2)
    glyphs, marks, want = [], [], {}
    for page in range(12):
        for string in range(6):
            classes = [g.randrange(5) for _ in range(g.randrange(0, 9))]
            own = [(c, g.random() < 0.3) for c in classes]
            p = []
            for c in classes:
                if g.random() < 0.8:
                    p.append(np.random.default_rng(g.randrange(10**6)).dirichlet([8 if k == c else 0.5 for k in range(6)]).tolist())
                if g.random() < 0.2:
                    p.append([0.0] * 5 + [1.0])
            glyphs += [(page, string, float(k), q, 1) for k, q in enumerate(p)]
            marks += [(page, string, k * 2.0, *m, 1) for k, m in enumerate(own)]
            match, cost = one_by_one(p, own, 5)
            want |= {(page, string, k): (x, round(cost, 9)) for k, x in enumerate(match)}
    g.shuffle(glyphs)
    marks += [(None, 1, 0.0, 1, False, 1), (1, 1, None, 1, False, 1)]
    ask = lambda a, b: alignment.align_marks(a, b, key=["page", "string"], order="x", probabilities="p", mark="c", soft="soft", other=5)
    a, b = spark.createDataFrame(glyphs, GLYPHS).repartition(3), spark.createDataFrame(marks, MARKS).repartition(3)
    got = ask(a, b).collect()
    assert {(r.page, r.string, r.mark): (r.glyph, round(r.cost, 9)) for r in got} == want and len(got) == len(want) and all(r.x == 2 * r.mark for r in got)
    assert ask(a, b.limit(0)).count() == 0 and all(r.glyph is None for r in ask(a.limit(0), b).collect())


def test_kernel_prefers_pairs():
    match, cost = alignment.align_many(np.array([[[1.2]]]), np.array([[0.6]]), np.array([[0.6]]), np.array([1]), np.array([1]))
    assert match.tolist() == [[0]] and cost[0] == pytest.approx(1.2)
