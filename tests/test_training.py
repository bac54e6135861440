"""Gradients against differences, whole-table steps against one array, held-out accuracy."""

import numpy as np

from skein.functions.nets import forward
from skein.operators import training

SCHEMA = "i int, x array<float>, y int"


def rows(seed, n, classes=4, dim=6):
    g = np.random.default_rng(seed)
    centre = np.random.default_rng(0).standard_normal((classes, dim)) * 2
    y = g.integers(0, classes, n)
    return [(i, (centre[k] + g.standard_normal(dim)).astype(np.float32).tolist(), int(k)) for i, k in enumerate(y)]


def test_gradient_is_that_of_the_loss():
    g = np.random.default_rng(1)
    net = training.Network(np.zeros(5), np.ones(5), [(g.standard_normal((5, 4)), g.standard_normal(4)), (g.standard_normal((4, 3)), g.standard_normal(3))])
    x, y, w = g.standard_normal((7, 5)), g.integers(0, 3, 7), g.random(7)
    told, at = net.gradient(x, y, w, 0.1), net.flat()
    for k in range(len(at)):
        ends = []
        for d in (1e-6, -1e-6):
            net.set_flat(at + d * (np.arange(len(at)) == k))
            ends.append(net.gradient(x, y, w, 0.1)[0])
        assert abs((ends[0] - ends[1]) / 2e-6 - told[1 + k]) < 1e-5


def test_sums_do_not_depend_on_partitions(spark):
    frame = spark.createDataFrame([(float(i),) for i in range(500)], "v double")
    for parts in (1, 7, 60):
        assert training.summed(frame.repartition(parts), lambda b: np.array([b.column(0).to_numpy().sum(), b.num_rows])).tolist() == [124750.0, 500.0]
    assert training.summed(frame.limit(0), lambda b: np.zeros(1)) is None


def test_held_out_accuracy(spark):
    bad = [(-1, None, 1), (-2, [None] * 6, 1), (-3, [0.0] * 6, None), (-4, [0.0] * 6, 9)]
    known = spark.createDataFrame(rows(1, 600) + bad, SCHEMA).repartition(5)
    net = training.train(known, features="x", label="y", classes=4, hidden=(16,), steps=30)
    assert net.losses[-1] < 0.6 * net.losses[0]
    net.temperature = training.fit_temperature(known, net, features="x", label="y")
    held = rows(2, 400)
    x, y = np.array([r[1] for r in held]), np.array([r[2] for r in held])
    p = forward(net.quantised(), x, net.temperature)
    assert (p.argmax(axis=1) == y).mean() > 0.9 and (p.argmax(axis=1) == net.logits(net.standard(x)).argmax(axis=1)).mean() > 0.98
    assert training.TEMPERATURES[0] < net.temperature < training.TEMPERATURES[-1]


def test_nothing_to_learn_from(spark):
    assert training.train(spark.createDataFrame([], SCHEMA), features="x", label="y", classes=3) is None
    one = training.train(spark.createDataFrame([(1, [1.0, 1.0], 2)], SCHEMA), features="x", label="y", classes=3, steps=5)
    assert one.logits(one.standard(np.ones((1, 2)))).argmax() == 2
    assert training.fit_temperature(spark.createDataFrame([], SCHEMA), one, features="x", label="y") == 1.0
