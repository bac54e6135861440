from itertools import product

from skein.llm import url_filters


def test_rules_of_three_tokens(spark):
    """Each token and pair is in more good pages than bad ones; only all three together tell."""
    urls = []
    for host, a, b in product(("x.test", "y.test"), ("buy", "sell"), ("now", "later")):
        odd = (host, a, b) == ("x.test", "buy", "now")
        urls += [(f"http://{host}/{a}/{b}/{i}", odd) for i in range(24 if odd else 40)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(urls)], "page_id bigint, blocked boolean")
    got = {r.page_id: r.verdict for r in url_filters.filter_urls(pages, labels, rules=()).collect()}
    assert got == {i: "block" if b else "allow" for i, (_, b) in enumerate(urls)}
    known = pages.join(labels, "page_id").select(url_filters.url_tokens(url_filters.url_host(pages["url"]), url_filters.url_path(pages["url"])).alias("tokens"), "blocked")
    assert [sorted(r.tokens) for r in url_filters.mine_rules(known).collect()] == [["h2:x", "p:buy", "p:now"]]


def test_tokens_that_always_occur_together(spark):
    """A path of 25 segments has 2**25 subsets, all of the same rows; each of its tokens tells by itself."""
    deep = "/".join(f"seg{chr(97 + i)}" for i in range(25))
    urls = [(f"http://bad.test/{deep}", True)] * 60 + [("http://good.test/other", False)] * 100 + [("http://good.test/segc", None), ("http://good.test/none", None)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id bigint, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(urls) if b is not None], "page_id bigint, blocked boolean")
    got = {r.page_id: r.verdict for r in url_filters.filter_urls(pages, labels, rules=()).collect()}
    assert got == {i: "block" if b or "segc" in u else "allow" for i, (u, b) in enumerate(urls)}


def test_against_all_token_sets(spark):
    """Random tokens, some of them always together: the verdicts of all sets of tokens, tried one by one."""
    from itertools import combinations
    from random import Random

    g = Random(3)
    rows = []
    for _ in range(400):
        tokens = {t for t in "abcdef" if g.random() < 0.5}
        tokens |= {"g", "h"} if "a" in tokens else set()
        rows.append((sorted(tokens), g.random() < (0.75 if {"b", "c"} <= tokens or {"d", "e", "f"} <= tokens else 0.2)))
    found = url_filters.mine_rules(spark.createDataFrame(rows, "tokens array<string>, blocked boolean"), rows=20, support=0.02)
    known = spark.createDataFrame([(str(i), "", t) for i, (t, _) in enumerate(rows)] + [("x", "", ["g"]), ("y", "", ["b", "c", "h"])], "host string, path string, tokens array<string>")
    got = {r.host for r in url_filters.matches(known, found).collect()}
    rules = [set(s) for k in range(1, 9) for s in combinations("abcdefgh", k) for own in [[b for t, b in rows if set(s) <= set(t)]] if sum(own) >= 20 and sum(own) >= 0.5 * len(own)]
    assert rules and got == {r.host for r in known.collect() if any(s <= set(r.tokens) for s in rules)}
