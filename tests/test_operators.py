import random
import unicodedata
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skein.functions import numeric, text
from skein.functions.nets import Dense, forward
from skein.operators import joins, library, ordered, ranks, raster, scoring, sequential
from skein.sources import synthetic


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def series(spark):
    g = random.Random(7)
    data = [(k, t, float(g.choice([1, 1, 1, 5, 9, 40])), g.random() < 0.5) for k in (1, 2, None) for t in range(g.randrange(1, 40))]
    return data, spark.createDataFrame(data, "k int, t int, v double, m boolean")


def by_key(data):
    out = {}
    for r in data:
        out.setdefault(r[0], []).append(r)
    return out


def test_half_up_is_not_round(spark):
    got = spark.createDataFrame([(-2.5,), (2.5,), (-0.05,)], "x double").select(numeric.half_up(F.col("x")), numeric.half_up(F.col("x"), 10)).collect()
    assert [r[0] for r in got] == [-2.0, 3.0, 0.0] and got[0][1] == -2.5


def test_majority_repeats_edges(series):
    data, df = series
    want = []
    for own in by_key(data).values():
        m = [r[3] for r in own]
        padded = m[:1] * 3 + m + m[-1:] * 3
        want += [(r[0], r[1], sum(padded[i : i + 7]) > 3) for i, r in enumerate(own)]
    got = [(r.k, r.t, r.majority) for r in ordered.majority(df, "k", "t", "m").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_raster_majority_agrees(series):
    data, df = series
    own = by_key(data)[1]
    got = raster.majority(np.array([[r[3]] for r in own]))[:, 0].tolist()
    assert got == [r.majority for r in ordered.majority(df.filter("k = 1"), "k", "t", "m").orderBy("t").collect()]


def test_segment_runs_leaves_null_pairs_out(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate([1.0, 1.0, None, 1.0, 1.0, 1.0])], "k int, t int, v double")
    assert rows(ordered.segment_runs(df.filter("t < 3"), "k", "t", "v"), "k") == []
    assert rows(ordered.segment_runs(df, "k", "t", "v"), "start_f", "end_f", "n_frames") == [(0, 5, 4)]


def test_evidence_and_extremes(spark):
    g = random.Random(5)
    data = [(k, i, g.randrange(60), g.choice(["a", "b", "c", None])) for k in (1, None) for i in range(40)]
    df = spark.createDataFrame(data, "k int, i int, s int, kind string")
    want = [(k, i, len({q for j, _, t, q in data if j == k and q is not None and s - 7 <= t <= s})) for k, i, s, _ in data]
    assert sorted(((r.k, r.i, r.alive) for r in ordered.evidence(df, "k", "s", "kind", ttl=7).collect()), key=str) == sorted(want, key=str)
    want = [(k, i, min([t for j, _, t, _ in data if j == k and s - 9 <= t <= s - 2], default=None)) for k, i, s, _ in data]
    assert sorted(((r.k, r.i, r.low) for r in ordered.range_extremes(df.withColumn("v", F.col("s")), "k", "s", "v", since=9, until=2).collect()), key=str) == sorted(want, key=str)


def test_rate_limit_streams(spark):
    g = random.Random(6)
    data = [(k, i, g.randrange(500)) for i, k in enumerate(g.choices(range(5), k=300))]
    df = spark.createDataFrame(data, "k int, i int, s int")
    want = []
    for k in range(5):
        own = sorted((s, i) for j, i, s in data if j == k)
        ok = sequential.rate_limit(np.array([s for s, _ in own], float), 40, 2)
        want += [(k, i, bool(x)) for (_, i), x in zip(own, ok)]
    assert rows(sequential.rate_limited(df, key="k", order="s", id_col="i", seconds="s", window=40, most=2), "k", "i", "allowed") == sorted(want)


def test_running_sums_over_many_ranges(spark):
    g = random.Random(8)
    data = [(k, v, g.randrange(5)) for k in (1, 2, None) for v in g.sample(range(1000), 90)]
    df = spark.createDataFrame(data, "k int, v int, n int")
    got = ranks.running(df, ["k"], "v", {"n": "upto"}, {"n": "total"}, ranges=7)
    want = [(k, v, sum(m for j, w, m in data if j == k and w <= v), sum(m for j, _, m in data if j == k)) for k, v, _ in data]
    assert sorted(((r.k, r.v, r.upto, r.total) for r in got.collect()), key=str) == sorted(want, key=str)


def test_titles_sort_as_people_do(spark):
    titles = ["étude 10", "Etude 9", "ETUDE 9 b12", "etude 9 B2", "zebra", "Äpfel 007", "apfel 8"]
    got = [r.t for r in spark.createDataFrame([(x,) for x in titles], "t string").orderBy(text.natural_key(F.col("t"))).collect()]
    assert got == ["Äpfel 007", "apfel 8", "Etude 9", "etude 9 B2", "ETUDE 9 b12", "étude 10", "zebra"]


def test_events_of_notes(spark):
    given = ["1:g7 2:5r7", "1:X 3:0?", "2:1 2:3", "|", "1:0 nonsense", "6:h12b14~?", "1:(5)b7", ""]
    got = {r.e: r.p for r in spark.createDataFrame([(x,) for x in given], "e string").select("e", text.parse_event(F.col("e")).alias("p")).collect()}
    first = got["1:g7 2:5r7"].notes
    assert first[0].grace and first[0].tech == ["grace"] and first[1].release and first[1].bend == 7
    assert got["1:X 3:0?"].notes[0].muted and got["1:X 3:0?"].notes[1].unsure and got["|"].bar and got["|"].notes == []
    assert got["6:h12b14~?"].notes[0].tech == ["~", "b", "h"]
    assert all(got[x] is None for x in ("2:1 2:3", "1:0 nonsense", "1:(5)b7", ""))


def test_top_hat_1d(series):
    data, df = series
    want = []
    for own in by_key(data).values():
        v = [r[2] for r in own]
        low = [min(v[max(0, i - 2) : i + 3]) for i in range(len(v))]
        want += [(r[0], r[1], v[i] - max(low[max(0, i - 2) : i + 3])) for i, r in enumerate(own)]
    got = [(r.k, r.t, r.top_hat) for r in ordered.top_hat(df, "k", "t", "v", 2).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_segment_runs_state_machine(series):
    data, df = series
    want = []
    for own in by_key(data).values():
        v = [r[2] for r in own]
        start = 0
        for i in range(1, len(v) + 1):
            if i == len(v) or abs(v[i] - v[i - 1]) / max(v[i], v[i - 1], 1) > 0.5:
                if i - start >= 3:
                    want.append((own[0][0], start, i - 1, i - start))
                start = i
    got = [(r.k, r.start_f, r.end_f, r.n_frames) for r in ordered.segment_runs(df, "k", "t", "v").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("n", [1, 2, 5, 10, 11])
def test_four_rank_rules(spark, n):
    values = random.Random(n).choices(range(8), k=n)
    s = sorted(values)
    df = spark.createDataFrame([(1, float(v)) for v in values] + [(1, None)], "k int, v double")
    got = ranks.exact_ranks(df, "k", "v", {"f": ranks.FLOOR(0.65), "r": ranks.NEAREST(0.6), "u": ranks.UPPER, "l": ranks.LOWER}).first()
    nearest = int(Fraction(6, 10) * (n - 1) + Fraction(1, 2))
    assert (got.n, got.f, got.r, got.u, got.l) == (n, s[int(0.65 * (n - 1) + 1e-9)], s[nearest], s[n // 2], s[(n - 1) // 2])


def test_size_budget_stops_at_first_overflow(spark):
    df = spark.createDataFrame([(1, 1, 50), (1, 2, 60), (1, 3, 1), (2, 1, 100)], "k int, t int, n int")
    assert rows(ordered.size_budget(df, "k", "t", "n", budget=100, most=300), "k", "t") == [(1, 1), (2, 1)]


def test_nearest_within(spark):
    g = random.Random(2)
    left = [(i % 2, i, g.uniform(0, 60)) for i in range(30)]
    right = [(i % 2, 100 + i, float(g.randrange(60))) for i in range(30)]
    want = []
    for k, i, t in left:
        near = sorted((abs(t - u), j) for q, j, u in right if q == k and abs(t - u) <= 1.5)
        want += [(k, i, near[0][1])] if near else []
    ldf, rdf = spark.createDataFrame(left, "k int, a int, t double"), spark.createDataFrame(right, "k int, b int, u double")
    got = joins.nearest_within(ldf, rdf, key="k", left_id="a", right_id="b", left_at="t", right_at="u", tol=1.5)
    assert rows(got, "k", "a", "b") == sorted(want)


def test_upsert_null_is_not_absent(spark):
    s = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, n string, x double")
    p = spark.createDataFrame([(1, None, True, 9.0, False), (3, "c", True, None, False)], "id int, n string, has_n boolean, x double, has_x boolean")
    assert rows(joins.upsert(s, p, "id", ["n", "x"]), "id", "n", "x") == [(1, None, 1.0), (2, "b", 2.0), (3, "c", None)]


def test_score_starts(spark):
    truth = spark.createDataFrame([(1, 1, 0.0, "a"), (1, 2, 10.0, "b"), (1, 3, 20.0, "a")], "v int, tid int, t double, label string")
    found = spark.createDataFrame([(1, 1, 0.5), (1, 2, 9.0), (1, 3, 20.0), (1, 4, 50.0)], "v int, fid int, t double")
    r = scoring.score_starts(found, truth, key="v", found_id="fid", truth_id="tid", at="t", label="label", tol=1.5).first()
    assert (r.wanted, r.found, r.correct, r.dup, r.spurious, r.recall, r.precision) == (2, 4, 2, 1, 1, 1.0, 0.5)


def test_notes_versions_names(spark):
    df = spark.createDataFrame([("6:h12b14~?",), ("1:x",), ("2:(3)",), ("3:<12>",), ("7:1",), ("1:25",)], "n string").select("n", text.parse_note(F.col("n")).alias("p"))
    got = {r.n: r.p for r in df.collect()}
    assert (got["6:h12b14~?"].fret, got["6:h12b14~?"].bend, got["6:h12b14~?"].lead, got["6:h12b14~?"].unsure) == (12, 14, "h", True)
    assert got["1:x"].muted and got["2:(3)"].ghost and got["3:<12>"].harmonic and got["7:1"] is None and got["1:25"] is None
    v = ["0.2.0", "0.3.0", "1.0.0-beta.2", "1.0.0-beta.10", "1.0.0", "nope"]
    key = {r.v: r.k for r in spark.createDataFrame([(x,) for x in v], "v string").select("v", text.version_key(F.col("v")).alias("k")).collect()}
    assert sorted(v[:5], key=key.get) == v[:5] and key["nope"] is None
    assert spark.range(1).select(text.note_name(F.lit(60)), text.note_name(F.lit(78)), text.fold(F.lit("ＡÉ"))).first()[:] == ("C4", "F♯5", "aé")


def test_leaders_do_not_drift():
    a = np.array([[1.0, 0], [np.cos(0.3), np.sin(0.3)], [np.cos(0.6), np.sin(0.6)]])
    assert sequential.leaders(a, np.cos(0.35)).tolist() == [0, 0, 2]


def naive_align(a, b):
    best = {}

    def go(i, j):
        if (i, j) not in best:
            ways = [0.0] if i == j == 0 else []
            if i and j:
                ways.append(go(i - 1, j - 1) + sequential.event_cost(a[i - 1], b[j - 1]))
            if i:
                ways.append(go(i - 1, j) + 0.6)
            if j:
                ways.append(go(i, j - 1) + 0.6)
            best[i, j] = min(ways)
        return best[i, j]

    return go(len(a), len(b))


def test_align_is_cheapest():
    g = random.Random(4)
    pick = lambda: frozenset(g.sample("abcd", g.randrange(1, 3))) if g.random() < 0.8 else frozenset("|")
    for _ in range(30):
        a, b = [pick() for _ in range(g.randrange(6))], [pick() for _ in range(g.randrange(6))]
        pairs = sequential.align(a, b)
        cost = sum(0.6 if i is None or j is None else sequential.event_cost(a[i], b[j]) for i, j in pairs)
        assert abs(cost - naive_align(a, b)) < 1e-9
        assert [i for i, _ in pairs if i is not None] == list(range(len(a))) and [j for _, j in pairs if j is not None] == list(range(len(b)))


def test_play_times():
    x = np.array([10.0, 30, 50, 70, 90])
    of = lambda stored, dur=8.0: sequential.play_times(np.zeros(5, int), x - 1, x + 1, x, np.full(5, 10.0), dur, stored)
    assert of([(0, 11, 1), (0, 49, 2), (0, 91, 8)]).round(6).tolist() == [1, 1.5, 2, 5, 8]
    assert (np.diff(of([(0, 10, 5), (0, 50, 1), (0, 90, 6)])) >= 0).all()
    assert of([]).tolist() == ((x - 10) / 82 * 8).tolist()


def test_longest_rising():
    g = random.Random(8)
    for _ in range(50):
        v = [g.randrange(6) for _ in range(9)]
        got = [v[i] for i in sequential.longest_rising(v)]
        longest = max(len(s) for s in _rising(v))
        assert got == sorted(got) and len(got) == longest


def _rising(v):
    out = [[]]
    for x in v:
        out += [s + [x] for s in out if not s or s[-1] <= x]
    return out


@pytest.mark.parametrize(("h", "w"), [(1, 1), (5, 3), (17, 9), (40, 23)])
@pytest.mark.parametrize("r", [1, 2, 4, 7])
def test_morphology_is_the_naive_window(h, w, r):
    x = (synthetic.lcg(h * w + r, h * w) * 256).astype(np.uint8).reshape(h, w)
    at = lambda y, z: x[max(0, y - r) : y + r + 1, max(0, z - r) : z + r + 1]
    assert raster.erode(x, r).tolist() == [[at(y, z).min() for z in range(w)] for y in range(h)]
    assert raster.dilate(x, r).tolist() == [[at(y, z).max() for z in range(w)] for y in range(h)]


def test_components():
    mask = np.zeros((6, 8), bool)
    for x, y in [(0, 0), (1, 1), (2, 2), (6, 0), (6, 1), (7, 1), (4, 5)]:
        mask[y, x] = True
    assert sorted(raster.components8(mask)[1].tolist()) == [1, 3, 3]
    assert raster.remove_small(mask, 2).sum() == 6
    spiral = np.ones((9, 9), bool)
    spiral[1, :-1] = spiral[3, 1:] = spiral[5, :-1] = spiral[7, 1:] = False
    assert raster.components8(spiral)[1].tolist() == [int(spiral.sum())]


def test_shift_of_one_pixel_is_the_same_screen():
    a = np.zeros((60, 120), bool)
    draw = synthetic.lcg(7, 80)
    for y, x in zip((draw[::2] * 50).astype(int), (draw[1::2] * 110).astype(int)):
        a[y : y + 4, x : x + 2] = True
    assert raster.differ(a, np.roll(a, 1, 1))[0] < 0.05 * a.sum() and not raster.same_screen(a, a[:, ::-1])
    assert raster.differ(np.pad(a, 40), np.pad(np.roll(a, 1, 1), 40))[0] == raster.differ(a, np.roll(a, 1, 1))[0]


def test_scan_finds_pages_and_repeats(spark):
    frames = synthetic.frame_table(spark, {"v": synthetic.recording([11, 22, 33, 11]), "blank": np.full((24, 120, 320), 20, np.uint8)})
    got = raster.scan_videos(frames).orderBy("page").collect()
    assert [r.video_id for r in got] == ["v"] * 3
    assert all(abs(r.t_start - t) <= 1 for r, t in zip(got, (0, 4, 8))) and len(got[0].also_at) == 1 and abs(got[0].also_at[0] - 12) <= 1


def test_composite_drops_the_cursor():
    frames = synthetic.recording([11], 11)
    base = synthetic.screen(11)
    out = raster.composite(frames)
    assert (out != np.where(base > 96, base, 0)).sum() <= 2


def test_quantised_net():
    g = np.random.default_rng(0)
    w = [g.standard_normal((20, 12)), g.standard_normal((12, 4))]
    layers = [Dense.quantised(x, np.zeros(x.shape[1])) for x in w]
    x = g.standard_normal((200, 20))
    exact = np.maximum(x @ w[0], 0) @ w[1]
    assert np.mean(forward(layers, x).argmax(axis=1) == exact.argmax(axis=1)) > 0.95


def test_events_of_notes_look_at_each_note_once(spark):
    df = spark.createDataFrame([("1:5  2:x",), ("1:5 1:3",), ("1:5,",), ("|",), ("1:,",), (None,)], "e string").select(text.parse_event(F.col("e")).alias("p"), text.parse_note(F.concat("e", F.lit("\n"))).alias("n"))
    assert [r.p and (r.p.bar, len(r.p.notes)) for r in df.collect()] == [(False, 2), None, None, (True, 0), None, None]
    plan = df.select("p")._jdf.queryExecution().analyzed().toString().lower()
    assert plan.count("rlike") + plan.count("regexp_") + plan.count("regexp(") < 8
    one = spark.createDataFrame([("1:5\n",)], "e string").select(text.parse_note(F.col("e")).alias("n")).first().n
    assert one.fret == 5 and not one.unsure


def test_search_folds_only_what_is_not_ascii(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(s: pd.Series) -> pd.Series:
        seen.add(int(s.notna().sum()))
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).lower())

    monkeypatch.setattr(library, "fold", counted)
    docs = spark.createDataFrame([(i, "The PLAIN one") for i in range(50)] + [(50, "ＴＨＥ plain É"), (51, None)], "id int, text string")
    assert sorted(r.id for r in library.search(docs, "the plain", ["text"]).collect()) == list(range(51)) and seen.value == 1
