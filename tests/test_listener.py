import numpy as np

from skein.sources.synthetic import pluck
from skein.functions import dsp
from skein.streaming import listener as ls

RATE = 48000
PLUCKS = ((0.6, 40), (1.3, 45), (2.0, 50), (2.7, 57))


def sound(plucks=PLUCKS, seconds=3.4):
    out = np.zeros(int(seconds * RATE), np.float32)
    for t, m in plucks:
        own = pluck(m, seconds - t - 0.01)
        out[int(t * RATE) : int(t * RATE) + len(own)] += own
    return out + np.random.default_rng(0).standard_normal(len(out)).astype(np.float32) * 1e-4


def accepted(y, notes, **how):
    own = ls.Listener([ls.Target(str(i), n) for i, n in enumerate(notes)], ls.Settings(**how))
    return [(m["id"], m["t"]) for m in own.push(y) if m["kind"] == "accept"]


def test_follows_plucks_and_declines_neighbours():
    y = sound()
    got = accepted(y, [(m,) for _, m in PLUCKS])
    assert [i for i, _ in got] == list("0123") and all(abs(t - want) < 0.06 for (_, t), (want, _) in zip(got, PLUCKS))
    for shift in (-1, 1):
        assert accepted(y, [(m + shift,) for _, m in PLUCKS]) == []
    assert accepted(np.random.default_rng(1).standard_normal(RATE).astype(np.float32) * 1e-4, [(40,)]) == []


def test_chunks_do_not_matter():
    y = sound(PLUCKS[:2], 2.0)
    whole = ls.Listener([ls.Target("0", (40,)), ls.Target("1", (45,))]).push(y)
    own = ls.Listener([ls.Target("0", (40,)), ls.Target("1", (45,))])
    cut = [m for a in range(0, len(y), 777) for m in own.push(y[a : a + 777])]
    assert cut == whole[: len(cut)] and len(cut) >= len(whole) - 1


def test_satisfied():
    assert ls.satisfied((40, 45), {40, 45}, True, "lenient") and not ls.satisfied((40, 45), {40}, False, "lenient") and ls.satisfied((40, 45, 50), {40, 45}, False, "lenient")
    assert not ls.satisfied((40,), {40}, True, "strict") and ls.satisfied((40, 52), {40}, False, "bass") and not ls.satisfied((40, 52), {52}, False, "bass")


def test_batch_equals_stream(spark, tmp_path):
    y = sound(PLUCKS[:2], 2.0)
    chunks = [("s", i, y[a : a + 24000].tolist()) for i, a in enumerate(range(0, len(y), 24000))]
    schema = "session string, seq int, samples array<float>"
    events = spark.createDataFrame([("s", 0, "a", [40]), ("s", 1, "b", [45])], "session string, idx int, id string, notes array<int>")
    batch = [tuple(r) for r in ls.follow(spark.createDataFrame(chunks, schema), events).orderBy("t", "kind", "id").collect()]
    for i, c in enumerate(chunks):
        spark.createDataFrame([c], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = ls.follow_stream(stream, {"s": [("a", (40,)), ("b", (45,))]}).writeStream.format("memory").queryName("heard").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("heard").orderBy("t", "kind", "id").collect()] == batch and sum(r[1] == "accept" for r in batch) == 2


def test_kernels():
    t = np.arange(4096) / RATE
    hz, clear = dsp.pitch(np.sin(2 * np.pi * 220 * t) + 0.5 * np.sin(2 * np.pi * 440 * t), RATE)
    assert abs(hz - 220) < 0.5 and clear > 0.9
    g = np.random.default_rng(2)
    a, x = g.random((30, 6)), np.array([0, 1.5, 0, 0.2, 3, 0])
    assert np.allclose(dsp.nnls(a, a @ x, rounds=5000), x, atol=1e-3)
    assert dsp.level(np.array([1.0, -0.5], np.float32)) == (float(np.sqrt(0.625)), 1.0, 1)
