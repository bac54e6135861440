"""Queries over sequential and dense operators; pytest compares them with brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skein.functions import nets
from skein.operators import alignment, leaders, sequential, training
from skein.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
with recursive e as materialized (select label, vec_id, embedding::double[] as v, row_number() over(partition by label order by vec_id) as rn from embeddings where label is not null and vec_id is not null and embedding is not null),
near as materialized (select a.label, a.vec_id, list(b.vec_id order by b.vec_id) as before from e a join e b on a.label=b.label and b.vec_id<a.vec_id and list_dot_product(a.v,b.v)>=0.92 group by a.label, a.vec_id),
g as (select label, rn, vec_id, [vec_id] as heads, vec_id as leader from e where rn=1
    union all
    select label, rn, vec_id, case when l is null then list_append(heads, vec_id) else heads end, coalesce(l, vec_id)
    from (select e.label, e.rn, e.vec_id, g.heads, list_filter(near.before, lambda x: list_contains(g.heads, x))[1] as l
        from g join e on e.label=g.label and e.rn=g.rn+1 left join near on near.label=e.label and near.vec_id=e.vec_id))
select label, vec_id, leader from g""")
def leader_clusters(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", "embedding")
    return leaders.first_leaders(e, key="label", order="vec_id", fields="embedding", alike=leaders.dots_at_least(0.92))


@query()
def aligned_marks(spark, d):
    """The letters of a part's type as uncertain glyphs, and those of its name as the marks that they should be."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    letters = lambda c: F.posexplode(F.split(F.lower(c), "")).alias("at", "letter")
    glyphs = p.select("p_partkey", letters("p_type")).withColumn("c", F.ascii("letter") % 7)
    likely = F.array(*[F.when(F.col("c") == k, 0.7).otherwise(0.05 if k < 7 else 0.02) for k in range(8)])
    marks = p.select("p_partkey", letters("p_name")).select("p_partkey", "at", (F.ascii("letter") % 7).alias("c"), F.col("letter").isin("a", "e", "i", "o", "u").alias("soft"))
    done = alignment.align_marks(glyphs.select("p_partkey", "at", likely.alias("p")), marks, key=["p_partkey"], order="at", probabilities="p", mark="c", soft="soft", other=7)
    return done.select("p_partkey", "mark", "glyph", F.round("cost", 6).alias("cost"))


@query("""
with recursive e as (select user_id, event_id, cast(floor(epoch(ts)) as bigint) s, row_number() over(partition by user_id order by cast(floor(epoch(ts)) as bigint), event_id) r from events),
w as (select user_id,event_id,s,r,s as st,1 as n from e where r=1
 union all select e.user_id,e.event_id,e.s,e.r, case when e.s-w.st>=86400 then e.s else w.st end, case when e.s-w.st>=86400 then 1 else w.n+1 end from w join e on e.user_id=w.user_id and e.r=w.r+1)
select user_id, event_id, n<=2 as allowed from w""")
def rate_limit_first_hit(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return sequential.rate_limited(e, key="user_id", order="ts", id_col="event_id", seconds="s", window=86400, most=2)


@query()
def align_events(spark, d):
    """Turns with all their words as notes; ``turn % 3`` only makes a second sequence to align with."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "system", F.array(F.lit("|"))).otherwise(F.split("text", " ")).alias("notes"))
    return sequential.align_events(c, c.filter("turn % 3 <> 1"), key="conv_id", order="turn", events="notes")


@query()
def play_times(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 3).alias("system"), "value")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["system", "value", "event_id"])
        x = pdf["value"].to_numpy(float)
        system = pdf["system"].to_numpy()
        stored = [(int(s), float(v), 10.0 * i) for i, (s, v) in enumerate(zip(system[::4], x[::4], strict=True))]
        t = sequential.play_times(system, x, x + 2, x + 1, np.full(len(x), 10.0), 60.0, stored)
        return pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "t": t})

    return e.groupBy("user_id").applyInPandas(run, "user_id bigint, event_id bigint, t double")


@query()
def trained_labels(spark, d):
    """The labels of all embeddings as a network tells them: trained on four fifths, its temperature fitted on the rest."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", "label").filter("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
    held = F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0
    classes = (e.agg(F.max("label")).first()[0] or 0) + 1
    net = training.train(e.filter(~held), features="embedding", label="label", classes=classes, steps=20)
    net.temperature = training.fit_temperature(e.filter(held), net, features="embedding", label="label")
    return e.select("vec_id", nets.predict(F.col("embedding"), net.quantised(), net.temperature).alias("p")).select("vec_id", "p.label", F.round("p.confidence", 4).alias("confidence"))
