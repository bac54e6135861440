"""URL filters: curated rules first, then association rules that FP-growth mines from labels."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.native import ascii_lower
from skein.llm.store import materialise

BLOCK, ALLOW = "block", "allow"
#: Curated rules (host, path, verdict) that the query applies; fixed values.
RULES = (("com", "/en/", BLOCK), ("example.com", "/en/7", ALLOW), ("net", "/de/", ALLOW), ("example.net", "/de/8", BLOCK), ("org", "/es/", BLOCK))
#: Curated rules become one CASE expression; beyond this many, use a rule table instead.
MOST_RULES = 1000
BLOCKED = "=block"
#: Mining bounds: share and number of labelled rows, confidence.
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE = 0.002, 20, 0.5


def url_host(url: Column) -> Column:
    """After the first ``://`` up to / ? # or the end, A-Z lower-cased; null or none: ''."""
    return ascii_lower(F.regexp_extract(_rest(url), "^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; null or no ``://``: ''."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_case(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null.

    A rule fits its host and all subdomains, if the path starts with the rule's; ties go to the
    rule that sorts first.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} curated rules; the bound is {MOST_RULES}")
    case = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        case = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(case)
    return case


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: each host label by its place from the right, each path segment, digits as #."""
    labels = F.filter(F.split(host, "\\."), lambda x: x != "")
    segments = F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda x: x != "")
    return F.array_distinct(
        F.concat(F.transform(labels, lambda x, i: F.concat(F.lit("h"), (F.size(labels) - i).cast("string"), F.lit(":"), x)), F.transform(segments, lambda x: F.concat(F.lit("p:"), x)))
    )


def mine_rules(labelled: DataFrame, *, support: float = MIN_SUPPORT, rows: int = MIN_ROWS, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules ``tokens -> block`` from (tokens, blocked): (rule_id, tokens, n_tokens, groups).

    FP-growth runs distributed over all labelled rows.  Token sets of every length count; of the
    rules, those that hold all tokens of a shorter rule are left out, as they match nothing more.
    A token set has to occur with ``block`` in ``support`` of the rows and in at least ``rows`` rows.
    No labelled rows: no rules.

    Tokens of the very same rows are mined as one, the first of them: any of them may stand in a rule for
    it, and ``groups`` has them all, one array for each of ``tokens``.  Tokens in too few blocked rows are
    in no rule, and those that are a rule by themselves are in no longer one; both go before sets are grown.
    """
    told = materialise(labelled.select(F.monotonically_increasing_id().alias("rid"), F.array_distinct("tokens").alias("tokens"), "blocked"), "labelled")
    n = told.count()
    least = max(math.ceil(support * n), rows)
    posted = told.select("rid", "blocked", F.explode("tokens").alias("token"))
    same = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.sum(F.xxhash64("rid", F.lit(1)).cast("decimal(38,0)")).alias("s")]
    each = posted.groupBy("token").agg(*same, F.count_if("blocked").alias("bad")).filter(F.col("bad") >= least)
    groups = materialise(each.groupBy("n", "x", "s", "bad").agg(F.array_sort(F.collect_set("token")).alias("group")).select(F.col("group")[0].alias("token"), "group", (F.col("bad") >= confidence * F.col("n")).alias("alone")), "groups")
    open_tokens = groups.filter("NOT alone").select("token")
    items = posted.join(open_tokens, "token").groupBy("rid").agg(F.collect_list("token").alias("tokens"), F.first("blocked").alias("blocked"))
    items = items.select(F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCKED)))).otherwise(F.col("tokens")).alias("items"))
    # FP-growth takes a share of the rows that it sees
    seen = max(items.count(), 1)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / seen), minConfidence=confidence).fit(items)
    grown = model.associationRules.filter((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCKED)).select(F.array_sort("antecedent").alias("tokens"))
    every = groups.filter("alone").select(F.array("token").alias("tokens")).unionAll(grown)
    rules = materialise(every.select(F.array_join("tokens", " ").alias("rule_id"), "tokens", F.size("tokens").alias("n_tokens")), "rules")
    rules = rules.join(_implied(rules, rules), "rule_id", "left_anti")
    members = rules.select("rule_id", "n_tokens", "tokens", F.explode("tokens").alias("token")).join(groups, "token")
    return members.groupBy("rule_id").agg(F.first("tokens").alias("tokens"), F.first("n_tokens").alias("n_tokens"), F.collect_list("group").alias("groups"))


def _implied(rules: DataFrame, shorter: DataFrame) -> DataFrame:
    """Ids of rules that hold all tokens of one of ``shorter`` that has fewer."""
    part = shorter.select(F.col("rule_id").alias("other"), F.col("n_tokens").alias("k"), F.explode("tokens").alias("token"))
    met = rules.select("rule_id", "n_tokens", F.explode("tokens").alias("token")).join(part, "token").filter("k < n_tokens")
    return met.groupBy("rule_id", "other").agg(F.count("*").alias("n"), F.first("k").alias("k")).filter("n = k").select("rule_id").distinct()


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct URLs (host, path) whose tokens hold one of each group of a rule, by an inverted index."""
    index = rules.select("rule_id", "n_tokens", F.posexplode("groups").alias("part", "group")).select("rule_id", "n_tokens", "part", F.explode("group").alias("token"))
    posted = urls.select("host", "path", F.explode("tokens").alias("token"))
    met = posted.join(index, "token").groupBy("host", "path", "rule_id", "part").agg(F.first("n_tokens").alias("n_tokens"))
    found = met.groupBy("host", "path", "rule_id").agg(F.count("*").alias("n"), F.first("n_tokens").alias("n_tokens"))
    return found.filter(F.col("n") == F.col("n_tokens")).select("host", "path").distinct()


def filter_urls(pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules=RULES, **mining) -> DataFrame:
    """(id, host, path, rule, verdict) for every row of ``pages``.

    ``labels`` has (id, blocked); its repeated ids count once, blocked if any row says so, and null
    counts as not blocked.  URLs without a curated rule get the mined rules' verdict.  A null URL or
    one without ``://`` has empty host and path, no tokens, and is allowed.  Repeated rows are judged
    alike; other columns of either table are not read.
    """
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path"))
    truth = labels.groupBy(F.col(id_col).alias("__label")).agg(F.coalesce(F.max("blocked"), F.lit(False)).alias("blocked"))
    known = urls.join(truth, urls["__id"] == truth["__label"]).select(url_tokens(F.col("host"), F.col("path")).alias("tokens"), "blocked")
    mined = mine_rules(known, **mining)
    free = urls.filter(rule_case(F.col("host"), F.col("path"), rules).isNull()).select("host", "path").distinct()
    hit = matches(free.withColumn("tokens", url_tokens(F.col("host"), F.col("path"))), mined).withColumn("__hit", F.lit(True))
    judged = urls.join(hit, ["host", "path"], "left").withColumn("__rule", rule_case(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("__hit"), F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return judged.select(F.col("__id").alias(id_col), "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"))


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all urls of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("blocked"))
    return filter_urls(pages, labels)


OP7_SQL = """
WITH RECURSIVE r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
v AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS hl,
             list_filter(string_split(regexp_replace(path, '[0-9]+', '#', 'g'), '/'), lambda x: x <> '') AS ps FROM u),
w AS (SELECT page_id, host, path, list_distinct(list_concat(
        list_transform(hl, lambda x, i: 'h' || (len(hl) - i + 1) || ':' || x), list_transform(ps, lambda x: 'p:' || x))) AS tokens FROM v),
j AS (SELECT w.page_id, row_number() OVER () AS rid, tokens, coalesce(bad, false) AS bad FROM w JOIN
        (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) = 1 AS bad FROM labels GROUP BY doc_id) l ON w.page_id = l.doc_id),
lim AS (SELECT greatest(ceil(0.002 * count(*)), 20) AS least FROM j),
one AS (SELECT rid, bad, unnest(tokens) AS a FROM j),
often AS (SELECT o.* FROM one o JOIN (SELECT a FROM one GROUP BY a HAVING count(*) FILTER (WHERE bad) >= (SELECT least FROM lim)) f ON o.a = f.a),
sets AS (SELECT rid, bad, [a] AS s, a AS last FROM often UNION ALL SELECT x.rid, x.bad, list_append(x.s, y.a), y.a FROM sets x JOIN often y ON x.rid = y.rid AND y.a > x.last),
rules AS (SELECT s FROM sets GROUP BY s HAVING count(*) FILTER (WHERE bad) >= (SELECT least FROM lim)
           AND count(*) FILTER (WHERE bad) >= 0.5 * count(*)),
hit AS (SELECT DISTINCT page_id, host, path FROM w WHERE EXISTS (SELECT 1 FROM rules WHERE list_has_all(w.tokens, s))),
c AS (SELECT u.*, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                       WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                       WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/'
                       WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
                       WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/' END AS rule FROM u)
SELECT c.page_id, c.host, c.path, c.rule, CASE WHEN c.rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN c.rule IS NOT NULL THEN 'allow'
       WHEN hit.page_id IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM c LEFT JOIN hit ON c.page_id = hit.page_id AND c.host = hit.host AND c.path = hit.path
"""
