"""Page scores against a plain reading of their rules."""

import random

from skein.operators.page_scores import COUNTS, score_pages

NOTE = "array<struct<string:int,fret:int,tech:array<string>>>"
TRUE = "array<struct<string:int,fret:int,tech:array<string>,unsure:boolean>>"


def brute(pairs):
    """The rules, one pair after the other; notes are dicts."""
    st, info = dict.fromkeys(COUNTS, 0), []
    key = lambda n: (n["string"], n["fret"])
    for r, t in pairs:
        doubt = {n["string"] for n in t or [] if n["unsure"]}
        ts, rs = [n for n in t or [] if not n["unsure"]], [n for n in r or [] if n["string"] not in doubt]
        a, b = {key(n) for n in ts}, {key(n) for n in rs}
        info.append({"r": r, "t": t, "ts": ts, "rs": rs, "lost": a - b, "false": b - a, "hit": a & b, "gone": False})
    for i, p in enumerate(info):
        for alone, mine, name, short in (("t", "rs", "split", "lost"), ("r", "ts", "merged", "false")):
            own = {key(n) for n in p[mine]}
            if p[alone] is not None or not own:
                continue
            near = [info[j] for j in (i - 1, i + 1) if 0 <= j < len(info) and info[j]["r"] is not None and info[j]["t"] is not None]
            for q in near:
                if own <= q[short]:
                    q[short] = q[short] - own
                    p["gone"] = True
                    for c in (name, "fp", "fn"):
                        st[c] += len(own)
                    break
    for p in info:
        if p["r"] is not None and p["t"] is not None:
            st["tp"] += len(p["hit"])
            for k in p["hit"]:
                a, b = ({m for m in next(n for n in p[s] if key(n) == k)["tech"] or [] if m in "hpbs"} for s in ("ts", "rs"))
                st["tech_truth"] += len(a)
                st["tech_read"] += len(b)
                st["tech_hit"] += len(a & b)
            lost, false = sorted(p["lost"], key=str), sorted(p["false"], key=str)
            for part, name in ((0, "wrong_fret"), (1, "wrong_string")):
                for m in list(lost):
                    n = next((x for x in false if x[part] == m[part]), None)
                    if n:
                        lost.remove(m)
                        false.remove(n)
                        for c in (name, "fp", "fn"):
                            st[c] += 1
        elif p["gone"]:
            lost, false = [], []
        else:
            lost, false = [key(n) for n in p["ts"]], [key(n) for n in p["rs"]]
        st["fn"] += len(lost)
        st["missed"] += len(lost)
        st["fp"] += len(false)
        st["extra"] += len(false)
        if len(p["ts"]) >= 2:
            st["chords"] += 1
            st["chords_exact"] += p["r"] is not None and {n["string"] for n in p["r"]} == {n["string"] for n in p["t"]}
    return st


def test_equals_plain_rules(spark):
    random.seed(5)

    def notes(truth, most=3):
        out = [{"string": s, "fret": random.choice([0, 0, 1, None]), "tech": random.choice([None, [], ["h"], ["h", "x"], ["b", "p"]])} for s in random.sample([1, 2, 3], random.randint(0, most))]
        return [{**n, "unsure": random.random() < 0.1} for n in out] if truth else out

    pages = {}
    for page in range(1500):
        side = [random.choice(["both", "both", "read", "truth"]) for _ in range(random.randint(1, 9))]
        pages[page] = [(None if s == "truth" else notes(False, 1 if s == "read" else 3), None if s == "read" else notes(True, 1 if s == "truth" else 3)) for s in side]
    rows = [(page, i, r, t) for page, pairs in pages.items() for i, (r, t) in enumerate(pairs)]
    df = spark.createDataFrame([*rows, (None, 0, [], [])], f"page int, pos int, read {NOTE}, truth {TRUE}")
    got = {r["page"]: {c: r[c] for c in COUNTS} for r in score_pages(df, "page", "pos").collect()}
    want = {page: brute(pairs) for page, pairs in pages.items()}
    assert sum(w["split"] for w in want.values()) > 20 and sum(w["merged"] for w in want.values()) > 20
    assert got == want
    assert score_pages(df.limit(0), "page", "pos").count() == 0
