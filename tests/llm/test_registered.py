"""The registered queries on the given tables: against their SQL, or held-out labels."""

import os
import zlib

import duckdb
import pytest

import corpus_pipeline
from skein.llm import queries, toxicity

BASE = os.environ.get("SKEIN_TESTDATA", "/root/testdata")
pytestmark = pytest.mark.skipif(not os.path.isdir(f"{BASE}/sf0.001"), reason="no test tables")


def rounded(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    path = f"{BASE}/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, path).select(*want.columns)
    key = lambda rows: sorted(map(repr, map(rounded, rows)))
    assert key(map(tuple, got.collect())) == key(want.fetchall())


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_languages_of_held_out_documents(spark):
    path = f"{BASE}/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").filter("lang IS NOT NULL").collect()}
    rows = queries.QUERIES["op3_language_id"](spark, path).collect()
    assert all(r.held_out == held_out(r.doc_id) for r in rows)
    judged = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and r.doc_id in lang and r.lang_pred != "und"]
    assert len(judged) > 100 and sum(judged) / len(judged) >= 0.99


@pytest.fixture(scope="module")
def toxic(spark):
    path = f"{BASE}/sf0.1" if os.path.isdir(f"{BASE}/sf0.1") else f"{BASE}/sf0.01"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.filter("toxic IS NOT NULL").collect()}
    asked = docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi").filter(toxicity.held_out(docs["doc_id"])).select("doc_id", "text")
    return toxicity.training_sample(docs.select("doc_id", "text"), labels), asked, known


def test_toxicity_of_held_out_documents(toxic):
    """Some labels of the given tables are wrong; the network learns without log-odds among its inputs too, if less."""
    sample, asked, known = toxic
    for use_odds in (True, False):
        scores = {r.doc_id: r.score for r in toxicity.predict(asked, toxicity.train(*sample, use_odds=use_odds)).collect()}
        assert all(held_out(d) for d in scores) and len(scores) > 20
        bad, good = ([s for d, s in scores.items() if known[d] == x] for x in (1, 0))
        area = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
        if use_odds:
            assert sum(s >= toxicity.THRESHOLD for s in bad) >= 0.9 * len(bad) and sum(s < toxicity.THRESHOLD for s in good) >= 0.95 * len(good) and area >= 0.95
        assert area >= 0.75


def test_toxic_passage_far_into_a_text_and_over_a_window_edge(spark, toxic):
    sample, _, _ = toxic
    net = toxicity.train(*sample)
    insult = "you worthless moron clown, pathetic scum and trash"
    clean = "the and of that with a " * 5000
    rows = [(1, clean), (2, clean + insult), (3, "the and of that with a " * 6 + insult + " the and of that with a" * 6)]
    got = {r.doc_id: r.score for r in toxicity.predict(spark.createDataFrame(rows, "doc_id bigint, text string"), net).collect()}
    assert got[1] < toxicity.THRESHOLD <= min(got[2], got[3])


def test_near_matches_hold_the_exact_ones(spark):
    path = f"{BASE}/sf0.001"
    exact = {r.doc_id for r in queries.QUERIES["op2_decontaminate"](spark, path).filter("contaminated").collect()}
    assert exact <= {r.doc_id for r in queries.QUERIES["op2_near_matches"](spark, path).collect()}


def test_pieces_has_the_second_best_too(spark):
    got = queries.QUERIES["op6_pieces"](spark, f"{BASE}/sf0.001").collect()
    assert any(r.others for r in got) and all(len(r.others) == (r.margin is not None) for r in got)
    assert all(x.score == r.score - r.margin and x.ids_sha256 != r.ids_sha256 and x.n_pieces > 0 for r in got for x in r.others)


def test_pipeline_on_the_given_tables(spark):
    got = corpus_pipeline.run(spark, f"{BASE}/sf0.001").collect()
    assert got and all(r.round_trip and r.n_pieces == len(r.ids) for r in got)
