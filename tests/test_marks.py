"""Edge cases of lines, notes, runs and tracked levels."""

from pyspark.sql import functions as F

from skein.operators import marks, tracking


def test_even_groups(spark):
    rows = [("a", 10.0 * i, 0.0, 99.0) for i in range(5)] + [("a", 200.0, 0.0, 99.0), ("b", 0.0, 0.0, 9.0), (None, None, None, None)]
    df = spark.createDataFrame(rows, "k string, y double, x0 double, x1 double")
    got = sorted((r["y0"], r["y1"], r["n"], r["regularity"]) for r in marks.even_groups(df, "k", y="y", x0="x0", x1="x1").collect())
    assert got == [(0.0, 30.0, 4, 1.0), (0.0, 40.0, 5, 1.0), (10.0, 40.0, 4, 1.0)]


def test_wide_chords_and_strings(spark):
    df = spark.createDataFrame([(1, 0), (1, 2), (1, 3), (1, 9), (2, 9), (2, None), (3, 1), (3, 7)], "e int, f int")
    assert sorted((r["e"], r["f"]) for r in marks.wide_chords(df, "e", "f").filter("wide").collect()) == [(1, 9), (3, 1)]
    notes = spark.createDataFrame([(1, 0, 1, 0.0), (1, 0, 2, 0.9), (1, 1, 3, 1.0), (1, 2, 4, 0.65), (1, 3, 5, None), (2, 0, 1, 0.0)], "k int, e int, s int, x double")
    bad = marks.unsound_strings(notes, "k", event="e", string="s", at=F.col("x")).collect()
    assert sorted(map(tuple, bad)) == [(1, 1), (1, 2), (1, 3), (1, 4)]


def test_partials_and_roles(spark):
    notes = spark.createDataFrame([(1, 10, 100.0, True), (1, 11, 200.0, False), (1, 12, 130.0, True), (1, 13, 0.0, True)], "k int, n int, hz double, on boolean")
    p = marks.own_partials(marks.partials(notes, ["k", "n", "on"], hz="hz", most=2), "k", note="n", hz="partial_hz", sounding=F.col("on"))
    assert sorted((r["n"], r["partial"]) for r in p.filter("NOT own").collect()) == [(11, 1)]
    roles = marks.capped_by_role(notes.withColumn("r", F.when(F.col("n") == 12, "exp").when(F.col("n") == 11, "odd")), "k", role="r", ranks={"exp": 0, "near": 1}, order=["n"], most=2)
    assert sorted((r["place"], r["n"]) for r in roles.collect()) == [(1, 12), (2, 10)]


def test_appearances(spark):
    runs = spark.createDataFrame([(1, 0, 10, 11), (1, 0, 20, 22), (1, 0, 30, 32), (1, 2, 50, 51), (1, 1, 40, 40), (2, 0, 0, 9), (3, 1, 5, 6)], "p int, g int, s int, e int")
    got = {r["p"]: (r["t_start"], r["t_end"], r["also_at"], r["candidates"]) for r in marks.appearances(runs, "p", group="g", start="s", end="e", fps=10.0).collect()}
    assert got == {1: (1.0, 3.3, [4.0, 5.0], [10, 11, 20, 21, 22, 30, 31, 32]), 2: (0.0, 1.0, [], list(range(10)))}


def test_tracking(spark):
    df = spark.createDataFrame([("a", i, 1.0) for i in range(4)] + [("a", i, 100.0) for i in range(4, 30)] + [("b", 0, 5.0), ("b", 1, None), (None, 0, 1.0)], "k string, t int, v double")
    got = {(r["k"], r["t"]): r["floor"] for r in tracking.noise_floor(df, key="k", order="t", value="v", smooth=0.0, bias=1.0, parts=2, part=4, warm=4, rise=2.0).collect()}
    assert got["b", 0] == 5.0 and ("b", 1) not in got and len(got) == 31
    assert [got["a", t] for t in (0, 4, 10, 11, 12, 13, 29)] == [1.0, 1.0, 1.0, 2.0, 4.0, 8.0, 100.0]
    d = {(r["k"], r["t"]): (r["cents"], r["told"]) for r in tracking.drift(df, key="k", order="t", value="v", alpha=0.5, step=0.6).collect()}
    assert [d["a", t] for t in range(4)] == [(0.5, False), (0.75, True), (0.875, False), (0.9375, False)] and ("a", 4) not in d and d["b", 0] == (2.5, True)


def test_even_groups_without_lambdas(spark):
    """No list of lines is built and walked for each row; a line without an end does not spoil its group."""
    rows = [("p", 10.0 * i, None if i == 2 else 0.0, 50.0) for i in range(5)]
    found = marks.even_groups(spark.createDataFrame(rows, "page string, y double, a double, b double"), "page", y="y", x0="a", x1="b")
    assert sorted((r.y0, r.y1, r.n, r.spacing, r.regularity, r.span) for r in found.collect()) == [(0.0, 30.0, 4, 10.0, 1.0, 51.0), (0.0, 40.0, 5, 10.0, 1.0, 51.0), (10.0, 40.0, 4, 10.0, 1.0, 51.0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "lambda" not in plan and "collect_list" not in plan
