"""Stored records with values of wrong kinds, against plain Python."""

import json
import math
import random

from pyspark.sql import functions as F

from skein.functions import records


def ok(v, low=None, high=None):
    good = isinstance(v, (int, float)) and not isinstance(v, bool)
    return good and (low is None or (v == math.floor(v) and low <= v <= high))


def timing(raw, most, budget):
    try:
        pages = json.loads(raw)["pages"]
        fit = [(-(p["at"] if ok(p.get("at")) else 0), k, p) for k, p in pages.items() if len(k) == 40 and set(k) <= set("0123456789abcdef") and isinstance(p, dict) and isinstance(p.get("events"), list)]
    except (TypeError, ValueError, KeyError, AttributeError):
        return None
    tenth = lambda x: math.floor(x * 10 + 0.5) / 10
    out, size = {}, 0
    for at, k, p in sorted(fit, key=lambda x: x[:2])[:most]:
        events = [[e[0], tenth(e[1]), math.floor(e[2] * 100 + 0.5) / 100] for e in p["events"] if isinstance(e, list) and len(e) > 2 and ok(e[0], 0, 7) and ok(e[1]) and ok(e[2]) and abs(e[2]) <= 3600][:800]
        fixes = p.get("fixes") if isinstance(p.get("fixes"), list) else []
        fixes = [[f[0], tenth(f[1]), f[2], f[3]] for f in fixes if isinstance(f, list) and len(f) > 3 and ok(f[0], 0, 7) and ok(f[1]) and ok(f[2], 1, 6) and ok(f[3], 0, 24)][:100]
        out[k] = (-at, events, fixes)
    return out or None


def value(g):
    return g.choice([g.randrange(-2, 12), round(g.uniform(-5, 30), 3), 4.0, "3", None, True, [1], {"a": 1}, g.uniform(-5000, 5000)])


def test_timing(spark):
    g = random.Random(5)
    raw = ["nope", None, "", "[1]", "7", '{"pages":[1]}', '{"pages":{}}', '{"pages":null}', '{"x":1}']
    for _ in range(150):
        pages = {}
        for _ in range(g.randrange(5)):
            key = "".join(g.choice("0123456789abcdef") for _ in range(40)) if g.random() < 0.8 else g.choice(["short", "Z" * 40])
            page = {"at": value(g), "events": [[g.randrange(9), g.uniform(0, 900), g.uniform(-5, 5)] if g.random() < 0.5 else [value(g) for _ in range(g.randrange(5))] for _ in range(6)] if g.random() < 0.9 else value(g)}
            if g.random() < 0.7:
                page["fixes"] = [[g.randrange(8), 1.25, g.randrange(8), g.randrange(30)] if g.random() < 0.6 else value(g) for _ in range(5)]
            pages[key] = g.choice([page, page, page, value(g)])
        raw.append(json.dumps({"pages": pages, "v": 1}))
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, j string")
    got = {r.i: r.t for r in frame.select("i", records.clean_timing(F.col("j"), most=3).alias("t")).collect()}
    full = 0
    for i, r in enumerate(raw):
        want = timing(r, 3, 10**9)
        mine = got[i] and {k: (p.at, [list(e) for e in p.events], [list(f) for f in p.fixes]) for k, p in got[i].items()}
        assert (want is None) == (mine is None) and (want is None or mine == want)
        full += bool(want)
    assert full > 50


def test_budget_ends_at_the_first_overflow(spark):
    pages = {f"{k:040x}": {"at": k, "events": [[0, 1, 2]] * (200 if k == 3 else 1)} for k in range(5)}
    frame = spark.createDataFrame([(json.dumps({"pages": pages}),)], "j string")
    ask = lambda budget: sorted(int(k, 16) for k in frame.select(records.clean_timing(F.col("j"), budget=budget).alias("t")).first().t or {})
    assert ask(10**6) == [0, 1, 2, 3, 4] and ask(150) == [4] and ask(10) == []


def test_listen(spark):
    rows = ['{"tuningId":"dadgad","tuning":[40,45,50,55,59,64],"capo":2.5,"strictness":"bass","mode":"play","confirmed":true}',
            '{"tuningId":"own","tuning":[40,45,50,55,59],"capo":99,"strictness":1,"mode":"go","confirmed":"true"}', '{"tuning":[40,45,50,55,59,99],"capo":-3}', "{}", "[]", "x", None]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, j string")
    got = [tuple(r.l) if r.l else None for r in frame.orderBy("i").select(records.clean_listen(F.col("j")).alias("l")).collect()]
    plain = ("standard", None, 0, "lenient", "wait", False)
    assert got == [("dadgad", [40, 45, 50, 55, 59, 64], 3, "bass", "play", True), ("standard", None, 12, "lenient", "wait", False), plain, plain, None, None, None]
