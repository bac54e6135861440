import datetime
import random
import shutil

from skein.operators import ordered, sequential
from skein.streaming import commits, keyed


def run_stream(spark, tmp_path, batches, schema, make):
    name = f"out_{random.randrange(10**9)}"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    g = random.Random(3)
    data = sorted((g.uniform(0, 100), i, g.randrange(3)) for i in range(60))
    rows = [(k, i, t) for t, i, k in data]
    schema = "k int, i int, t double"
    out = run_stream(spark, tmp_path, [rows[:20], rows[20:45], rows[45:]], schema, lambda s: keyed.rate_limited_stream(s, key="k", id_col="i", seconds="t", window=10, most=2))
    batch = sequential.rate_limited(spark.createDataFrame(rows, schema), key="k", order="t", id_col="i", seconds="t", window=10, most=2)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def test_fence_stream_equals_batch(spark, tmp_path):
    g = random.Random(5)
    rows = [(g.randrange(2), i, g.randrange(i // 4 + 1)) for i in range(40)]
    schema = "k int, i int, e bigint"
    out = run_stream(spark, tmp_path, [rows[:15], rows[15:]], schema, lambda s: keyed.fenced_stream(s, key="k", id_col="i", epoch="e"))
    batch = ordered.epoch_fence(spark.createDataFrame(rows, schema), "k", "i", "e")
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


PAGES = "page bigint, at double"


def test_commits_are_written_once(spark, tmp_path):
    """Batches run again after their ledger entry, or after a crash before it; a batch without entry is not read."""
    target = f"file://{tmp_path}/out"
    rows = [(i, (i * 37 % 101) / 7) for i in range(101)]
    first, second = (spark.createDataFrame(r, PAGES).repartition(3) for r in (rows[:23], rows[23:]))
    read = lambda: commits.committed(spark, target, PAGES).collect()
    assert read() == []
    commits.commit_batch(first, 0, target, ["at"])
    commits.commit_batch(first.limit(3), 0, target, ["at"])  # a replay that the ledger stops
    want = {(p, k // 5) for k, (p, _) in enumerate(sorted(rows[:23], key=lambda r: r[1]))}
    assert {(r.page, r.commit) for r in read()} == want and len(read()) == 23
    commits.commit_batch(second, 1, target, ["at"])
    shutil.rmtree(f"{tmp_path}/out/ledger/batch=1")  # as if the driver was lost before the entry
    assert len(read()) == 23
    commits.commit_batch(second, 1, target, ["at"])
    assert sorted(r.page for r in read()) == list(range(101)) and max(r.commit for r in read()) == 15
    commits.commit_batch(first.limit(0), 2, target, ["at"])
    assert len(read()) == 101


def test_committed_stream(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(10 * i + k, float(k)) for k in range(7)], PAGES).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    pages = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    target = f"file://{tmp_path}/out"
    for _ in (0, 1):  # started again, it finds nothing new
        q = commits.committing(pages, target, ["at"]).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = commits.committed(spark, target, PAGES).collect()
        assert sorted((r.page % 10, r.commit) for r in got) == sorted((k, k // 5) for k in range(7) for _ in range(3)) and {r.batch for r in got} == {0, 1, 2}


def test_onset_stream_equals_batch_and_pairs(spark, tmp_path):
    g = random.Random(7)
    base = datetime.datetime(2024, 1, 1)
    at = lambda s: base + datetime.timedelta(milliseconds=int(s * 1000))
    onsets = [(g.choice("ab"), i, at(g.uniform(0, 60))) for i in range(50)] + [(None, 90, at(5)), ("a", 91, None)]
    events = [(g.choice("ab"), i, at(g.uniform(0, 60))) for i in range(30)]
    early, late = datetime.timedelta(milliseconds=30), datetime.timedelta(seconds=3)
    want = sorted((o, e) for k, o, t in onsets for q, e, s in events if k == q and t and s - early <= t <= s + late)
    frames = {}
    for name, rows, schema in (("o", onsets, "k string, onset int, heard timestamp"), ("e", events, "k string, event int, armed timestamp")):
        frames[name] = spark.createDataFrame(rows, schema)
        frames[name].coalesce(1).write.parquet(str(tmp_path / name))
    met = lambda o, e: commits.onsets_of_events(o, e, key="k", onset_at="heard", armed_at="armed", watermark="2 minutes")
    assert sorted((r.onset, r.event) for r in met(frames["o"], frames["e"]).collect()) == want and len(want) > 20
    streams = [spark.readStream.schema(frames[n].schema).parquet(str(tmp_path / n)) for n in "oe"]
    q = met(*streams).writeStream.format("memory").queryName("onset_pairs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.onset, r.event) for r in spark.table("onset_pairs").collect()) == want


def test_throttled_levels(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [("a", base + datetime.timedelta(milliseconds=20 * i), v) for i, v in enumerate([0.5, -1.0, 0.25, 0.1, 0.3])]
    got = keyed.throttled_levels(spark.createDataFrame(rows, "k string, at timestamp, v double"), key="k", at="at", value="v").orderBy("at").collect()
    assert [(r.peak, r.clipped, r.n) for r in got] == [(1.0, 1, 3), (0.3, 0, 2)] and abs(got[0].rms - ((0.25 + 1 + 0.0625) / 3) ** 0.5) < 1e-12
