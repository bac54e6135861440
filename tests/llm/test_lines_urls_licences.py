import hashlib
from collections import defaultdict

from skein.llm import license_scan, line_dedup, url_filters

WHITE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_lines(rows, min_docs, keep):
    lines = [(i, t, (t or "").split("\n")) for i, t in rows]
    where = defaultdict(list)
    for i, t, ls in lines:
        for p, line in enumerate(ls):
            if k := line.strip(WHITE).translate(LOWER):
                where[k].append((i, t, p))
    out = {}
    for i, t, ls in lines:
        kept = []
        for p, line in enumerate(ls):
            k = line.strip(WHITE).translate(LOWER)
            seen = where.get(k, [])
            gone = len({(a, b) for a, b, _ in seen}) >= min_docs and (keep == "none" or min((a, c) for a, _, c in seen) != (i, p))
            if not k or not gone:
                kept.append(line)
        out[i] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


def check(docs, rows, **how):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(docs(rows), **how).collect()}
    assert got == brute_lines(rows, how["min_docs"], how["keep"])


ROWS = [(1, "Top\nshared line\nown 1"), (2, " SHARED LINE\t\nown 2"), (3, None), (4, ""), (5, "\n\n"), (6, "É\nshared line\nshared line"), (7, "é\ntail\n"), (8, "own 2\n" + "x\n" * 500 + "shared line")]


def test_lines_none(docs):
    check(docs, ROWS, keep="none", min_docs=3)
    check(docs, ROWS, keep="none", min_docs=2)


def test_lines_first(docs):
    check(docs, ROWS, keep="first", min_docs=2)
    check(docs, ROWS, keep="first", min_docs=1)


def test_lines_empty_and_repeats(docs):
    assert line_dedup.dedup_lines(docs([]), keep="none", min_docs=2).count() == 0
    twice = [(1, "a\nb")] * 3 + [(2, "a\nc")]
    got = line_dedup.dedup_lines(docs(twice), keep="none", min_docs=2).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(1, 1)] * 3 + [(2, 1)]


def test_line_runs_are_the_bitmap(docs):
    r = line_dedup.dedup_lines(docs([(1, "a\nb\nc\nd"), (2, "b"), (3, "b\nd")]), keep="none", min_docs=2).filter("doc_id = 1").first()
    assert [(x.start, x.len) for x in r.keep_runs] == [(0, 1), (2, 1)]
    assert hashlib.sha256(r.kept_text.encode()).hexdigest() == hashlib.sha256(b"a\nc").hexdigest()


def test_licences(docs):
    rows = [(1, "text\nReleased under the MIT License.\nmore"), (2, "released   UNDER the mit license"), (3, None), (4, ""), (5, "a license"), (6, "Licensed under the Apache License, Version 2.0. and a lot of other words that follow it here to make it long"), (7, "Licensed under CC BY-NC 4.0!\nLicensed under CC BY-NC 4.0.")]
    got = {r.doc_id: [(h.line, h.license) for h in r.hits] for r in license_scan.scan(docs(rows)).collect()}
    assert got == {1: [(1, "MIT")], 2: [(0, "MIT")], 3: [], 4: [], 5: [], 6: [], 7: [(0, "CC-BY-NC-4.0"), (1, "CC-BY-NC-4.0")]}
    assert license_scan.scan(docs([])).count() == 0


def test_licence_bounds_prune_nothing(docs):
    import itertools

    words = [w for _, t in license_scan.TEMPLATES for w in t.split()][:40]
    rows = [(i, " ".join(words[a:b])) for i, (a, b) in enumerate(itertools.combinations(range(0, 40, 3), 2))]
    got = {r.doc_id: len(r.hits) for r in license_scan.scan(docs(rows)).collect()}
    for i, text in rows:
        g = set(license_scan.bigrams(text))
        dice = max(2 * len(g & set(license_scan.bigrams(t))) / max(1, len(g) + len(license_scan.bigrams(t))) for _, t in license_scan.TEMPLATES)
        assert got[i] == int(dice >= 0.8), text


def test_urls(spark):
    urls = [
        ("http://a.example.com/en/1?x", "com/en/", "block"), ("https://EXAMPLE.com/en/7#a", "example.com/en/7", "allow"), ("http://x.net/de/", "net/de/", "allow"), ("http://b.example.net/de/88", "example.net/de/8", "block"),
        ("ftp://q.org/es/", "org/es/", "block"), ("http://notcom/en/", None, "allow"), ("nothing", None, "allow"), (None, None, "allow"), ("http://h", None, "allow"), ("x://com", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "com") for i, (u, _, _) in enumerate(urls)], "page_id bigint, url string, rule string")
    none = spark.createDataFrame([], "page_id bigint, blocked boolean")
    got = {r.page_id: (r.rule, r.verdict, r.host, r.path) for r in url_filters.filter_urls(pages, none).collect()}
    assert [got[i][:2] for i in range(len(urls))] == [x[1:] for x in urls]
    assert got[1][2:] == ("example.com", "/en/7") and got[6][2:] == ("", "") and got[8][2:] == ("h", "")
    assert url_filters.filter_urls(pages.limit(0), none).count() == 0


def test_url_rules_are_mined(spark):
    bad = [(i, f"http://spam.test/buy/{i}") for i in range(30)]
    good = [(100 + i, f"http://fine.test/buy/{i}") for i in range(60)]
    pages = spark.createDataFrame([*bad, *good, (500, "http://spam.test/buy/x"), (501, "http://spam.test/"), (502, "http://fine.test/buy/9")], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, True) for i, _ in bad] + [(i, False) for i, _ in good] + [(100, None)], "page_id bigint, blocked boolean")
    got = {r.page_id: r.verdict for r in url_filters.filter_urls(pages, labels, rules=()).collect()}
    assert (got[500], got[501], got[502], got[3], got[103]) == ("block", "block", "allow", "block", "allow")
