"""Edge cases of the small rules, stored pages, settled readings, centres and suppressed messages."""

import random

from pyspark.sql import functions as F

from skein.functions import rules
from skein.operators import content, joins, ordered, ranks, sequential, settling
from skein.streaming import keyed
from tests.test_streaming import run_stream


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_settings_and_rates(spark):
    n, s = F.lit(None).cast("double"), lambda x: rules.parse_rate(F.lit(x))
    assert one(spark, *[rules.clamp_speed(c) for c in (n, F.lit(0.0), F.lit(0.125), F.lit(9.0), F.lit(1.005))]) == (1.0, 1.0, 0.25, 2.0, 1.0)
    assert one(spark, *[rules.clean_bpm(c) for c in (n, F.lit(19.4), F.lit(19.5), F.lit(400.4), F.lit(400.5))]) == (0, 0, 20, 400, 0)
    assert one(spark, s("30000/1001"), s("25/0"), s("25"), s("x/2"), s("-1/2"), rules.parse_rate(F.lit(None).cast("string"))) == (30000 / 1001, 0, 0, 0, 0, 0)


def test_ranges(spark):
    ask = lambda h: rules.byte_range(F.lit(h).cast("string"), F.lit(100))
    got = one(spark, *[ask(h) for h in (None, "bytes=0-9", "bytes=90-", "bytes=-5", "bytes=-500", "bytes=-0", "bytes=50-999", "bytes=100-", "bytes=9-3", "bytes=-", "bytes=0-9\n", "bytes=99999999999999999999-")])
    assert [tuple(g) for g in got] == [(200, 0, 99), (206, 0, 9), (206, 90, 99), (206, 95, 99), (206, 0, 99), (416, None, None), (206, 50, 99)] + [(416, None, None)] * 5


def test_times_and_addresses(spark):
    now = F.lit(1717243200)
    ago = lambda s: rules.how_long_ago(now - s, now)
    assert one(spark, ago(59), ago(60), ago(90), ago(7200), ago(86400), ago(3 * 86400), ago(7 * 86400), rules.how_long_ago(F.lit(None).cast("bigint"), now)) == (
        "just now", "1 minute ago", "2 minutes ago", "2 hours ago", "yesterday", "3 days ago", "2024-05-25", "")
    assert one(spark, *[rules.age_days(F.lit(v), now) for v in ("2024.06.01", "2024.05.01.9", "2025.01.01", "v2024.05.01", "2024.13.40")]) == (1, 32, 0, None, None)
    assert one(spark, rules.client_ip(F.lit(" 1.2.3.4 , 5"), F.lit("a")), rules.client_ip(F.lit(" ,5"), F.lit("a")), rules.client_ip(F.lit("1.2.3.4"), F.lit("a"), False), rules.client_ip(F.lit(None).cast("string"), F.lit(None).cast("string"))) == ("1.2.3.4", "a", "a", "unknown")
    assert one(spark, rules.spread_times(F.lit(0.0), F.lit(10.0), F.lit(3)), rules.spread_times(F.lit(0.0), F.lit(10.0), F.lit(0)), rules.spread_times(F.lit(5.0), F.lit(1.0), F.lit(2))) == ([0, 5, 10], [5], [5, 5])
    assert [tuple(p) for p in one(spark, rules.parse_sequence(F.lit(" 3:b 1:a\n3:a ")))[0]] == [(1, "a"), (3, "b"), (3, "a")]
    assert one(spark, rules.parse_sequence(F.lit(None).cast("string")), rules.parse_sequence(F.lit(" "))) == ([], [])


def test_pages_keep_stored_files(spark):
    pages = spark.createDataFrame([(1, i, "aabbccddee" if i % 2 else "0011223344") for i in range(1, 5)] + [(2, i, f"{i:010d}") for i in range(1, 1002)] + [(1, 9, None)], "s int, p int, h string")
    stored = spark.createDataFrame([(1, 1, "old1.png", "aabbccddee"), (1, 2, "old2.png", "aabbccddee"), (1, 3, "gone.png", "ff"), (3, 1, "other.png", "ff")], "s int, p int, n string, h string")
    placed = content.place_pages(pages, stored, sheet="s", position="p", sha1="h", name="n")
    got = {(r.s, r.p): (r.n, r.reused) for r in placed.collect()}
    assert [got[1, p] for p in (1, 2, 3, 4)] == [("old2.png", True), ("page-002-00112233.png", False), ("old2.png", True), ("page-002-00112233.png", True)]
    assert got[2, 7] == ("page-0007-00000000.png", False) and len(got) == 1005
    assert sorted(map(tuple, content.stale_pages(placed, stored, sheet="s", name="n").collect())) == [(1, "gone.png"), (1, "old1.png")]


def test_readers_settle(spark):
    a = spark.createDataFrame([(1, 0, ["x", "y?"]), (1, 1, ["z", "x"]), (2, 0, ["x"]), (3, 0, ["x"])], "p int, o int, t array<string>")
    b = spark.createDataFrame([(1, 0, ["y", "x?"]), (1, 1, ["x", "z"]), (2, 0, ["x"]), (2, 1, ["y"])], "p int, o int, t array<string>")
    assert sorted(map(tuple, settling.promote(a, b, page="p", order="o", tokens="t").collect())) == [(1, 0, ["x?", "y?"]), (1, 1, ["z", "x?"])]
    pairs = a.join(b.withColumnRenamed("t", "u"), ["p", "o"], "full")
    assert sorted(map(tuple, settling.agreement(pairs, "p", "t", "u").collect())) == [(1, 2, 2), (2, 2, 1), (3, 1, 0)]


def test_peaks_go_to_centres(spark):
    g = random.Random(1)
    rows = sorted({round(g.uniform(1, 40), 2) for _ in range(25)})
    bounds = [(1, c, c * 0.95, c * 1.06) for c in rows] + [(2, 5.0, 4.0, 6.0)]
    peaks = [(1, round(g.uniform(0.9, 44), 2), i) for i in range(300)] + [(3, 1.0, 1)]
    want = {(k, c): 0 for k, c, _, _ in bounds}
    for k, f, m in peaks[:-1]:
        r = max([i for i, c in enumerate(rows) if c <= f], default=0)
        best = r + 1 if r + 1 < len(rows) and f > rows[r] and rows[r + 1] / f < f / rows[r] else r
        for i in (best, r + 1 if best == r else r):
            if i < len(rows) and bounds[i][2] <= f <= bounds[i][3]:
                want[k, rows[i]] = max(want[k, rows[i]], m)
                break
    got = ordered.nearest_centre(spark.createDataFrame(peaks, "k int, f double, m int"), spark.createDataFrame(bounds, "k int, c double, lo double, hi double"), key="k", at="f", size="m", centre="c", low="lo", high="hi")
    assert {(r.k, r.c): r.m for r in got.collect()} == want


def test_stamps_words_and_sweeps(spark):
    p = spark.createDataFrame([(1, 1.0, 5.0), (1, 2.1, 5.0), (1, 1.0, 6.5), (2, 1.0, 5.0), (1, -0.5, 4.5)], "k int, a double, b double")
    stamps = spark.createDataFrame([(1, 0.5, 5.5), (1, 0.5, 5.5)], "k int, a double, b double")
    assert sorted(map(tuple, joins.not_stamped(p, stamps, key="k", start="a", end="b").collect())) == [(1, 2.1, 5.0), (2, 1.0, 5.0)]
    marks = spark.createDataFrame([(1, i, x, x + 2, n) for i, (x, n) in enumerate([(0, "I"), (3, "n"), (6, "t"), (20, "5"), (23, "7"), (26, "a"), (40, "b"), (43, "c"), (7, ".")])], "k int, i int, x0 int, x1 int, n string")
    kept = ordered.drop_words(marks, "k", ["x0", "i"], x0="x0", x1="x1", big=F.col("n") != ".", letter=F.col("n").rlike("[A-Za-z]"), gap=1.0)
    assert "".join(sorted(r.n for r in kept.collect())) == ".57abc"
    s = spark.createDataFrame([(1, 0, 10.0, 20.0), (1, 1, 0.0, 30.0), (1, 2, 7.0, 7.0)], "k int, i int, a double, b double")
    q = spark.createDataFrame([(1, f) for f in (-1.0, 10 / 41, 20 / 41, 2.0)] + [(2, 0.5)], "k int, f double")
    got = ordered.sweep_at(s, q, key="k", order="i", x0="a", x1="b", share="f").orderBy("f").collect()
    assert [(r.system, round(r.x, 6)) for r in got] == [(0, 10.0), (0, 20.0), (1, 10.0), (2, 8.0)]


def test_suppressed_stream_equals_batch(spark, tmp_path):
    g = random.Random(7)
    rows = sorted(((g.randrange(2), i, i * 0.3, g.choice(["a", "a", "b", None])) for i in range(60)), key=lambda r: r[2])
    schema = "k int, i int, t double, m string"
    names = {"key": "k", "id_col": "i", "seconds": "t", "message": "m", "window": 1.0}
    batch = sorted(map(tuple, sequential.suppress_repeats(spark.createDataFrame(rows, schema), **names).collect()))
    want, last = [], {}
    for k, i, t, m in rows:
        sent = k not in last or last[k][0] != m or t - last[k][1] >= 1.0
        last[k] = (m, t) if sent else last[k]
        want.append((k, i, sent))
    assert batch == sorted(want)
    out = run_stream(spark, tmp_path, [rows[:20], rows[20:45], rows[45:]], schema, lambda s: keyed.suppressed_stream(s, **names))
    assert sorted(map(tuple, out.collect())) == batch


def test_empty_tables(spark):
    p = spark.createDataFrame([], "s int, p int, h string, n string")
    placed = content.place_pages(p, p, sheet="s", position="p", sha1="h", name="n")
    assert placed.count() == 0 and content.stale_pages(placed, p, sheet="s", name="n").count() == 0
    e = spark.createDataFrame([], "k int, i int, t double, m string")
    assert sequential.suppress_repeats(e, key="k", id_col="i", seconds="t", message="m", window=1).count() == 0


def test_frames(spark):
    rect = lambda *c: rules.even_rect(*[F.lit(v).cast("double") for v in c], F.lit(101), F.lit(50))
    got = one(spark, rect(-3.0, 7.9, 500.0, 1.0), rect(200.0, 49.0, 5.0, 5.0), rect(None, 0, 9, 9), rect(float("nan"), 0, 9, 9), rect(float("inf"), 0, 9, 9))
    assert [None if g is None else tuple(g) for g in got] == [(0, 6, 100, 2), (98, 48, 2, 2), None, None, None]
    small = rules.even_rect(*[F.lit(0.0)] * 4, F.lit(1), F.lit(50))
    assert one(spark, small, rules.low_resolution(F.lit(539), F.lit(None).cast("int")), rules.low_resolution(F.lit(600), F.lit(1080)), rules.low_resolution(F.lit(648), F.lit(1080)), rules.low_resolution(F.lit(0), F.lit(720))) == (None, True, True, False, False)
    assert one(spark, rules.local_gain(F.lit(50), F.lit(60), F.lit(80)), rules.local_gain(F.lit(250), F.lit(10), F.lit(200)), rules.local_gain(F.lit(255), F.lit(100), F.lit(150))) == (66, 255, 255)
    kind = lambda *c: rules.pair_class(*[F.lit(float(v)) for v in c], floor=10.0, ratio=0.2, minor=0.05, cell=9)
    assert one(spark, kind(2, 1, 1, 99), kind(2.5, 10, 5, 0), kind(6, 100, 5, 9), kind(6, 100, 5, 8), rules.decibels(F.lit(0.0))) == ("IDENTICAL", "TRANSITION", "TRANSITION", "STABLE", -200.0)
    assert rules.knobs(-1)["ratio"] == 0.25 and rules.knobs(0.5)["cell_floor"] == 24 and rules.knobs(2)["cell_floor"] == 10


def test_present(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(11)] + [("a", None), (None, 5.0), ("b", 0.0)], "k string, v double")
    got = {(r.k, r.v): r.present for r in ranks.present(df, "k", "v").collect()}
    assert len(got) == 14 and got[None, 5.0] and not got["b", 0.0] and not got["a", None]
    assert [v for v in range(11) if got["a", float(v)]] == list(range(2, 11))
