"""Queries over ordered rows, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import ordered as o
from skein.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_ORDER = ["ts", "event_id"]


def _events(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query("""
with f as (select user_id, value, row_number() over(partition by user_id order by ts,event_id)-1 as t from events),
p as (select user_id, t-1 as i, abs(value-pv)/greatest(value,pv,1.0) as ratio
      from (select *, lag(value) over(partition by user_id order by t) pv from f) q where pv is not null and value is not null),
c as (select user_id, i, case when ratio>0.5 then 1 else 0 end as tr from p),
g as (select user_id, i, tr, sum(tr) over(partition by user_id order by i rows unbounded preceding) as grp from c)
select user_id, min(i) as start_f, max(i)+1 as end_f, count(*)+1 as n_frames
from g where tr=0 group by user_id, grp having count(*)>=2 and count(*)+1>=3""")
def segment_runs(spark, d):
    r = o.segment_runs(_events(spark, d), "user_id", _ORDER, "value")
    return r.select("user_id", F.col("start_f").cast("long").alias("start_f"), F.col("end_f").cast("long").alias("end_f"), "n_frames")


@query("""
with m as (select event_id, user_id, ts, (event_type in ('click','view')) as m,
  row_number() over(partition by user_id order by ts,event_id) rn, count(*) over(partition by user_id) n from events)
select event_id, (sum(m::int) over(partition by user_id order by ts,event_id rows between 3 preceding and 3 following)
  + greatest(0,4-rn)*first_value(m::int) over(partition by user_id order by ts,event_id rows between unbounded preceding and unbounded following)
  + greatest(0,4-(n-rn+1))*last_value(m::int) over(partition by user_id order by ts,event_id rows between unbounded preceding and unbounded following)) > 3 as majority from m""")
def majority7(spark, d):
    e = _events(spark, d).withColumn("m", F.col("event_type").isin("click", "view"))
    return o.majority(e, "user_id", _ORDER, "m").select("event_id", "majority")


@query("""
with h as (select event_id, value, list(value) over(partition by user_id order by ts,event_id rows between 255 preceding and current row) h,
  max(value) over(partition by user_id order by ts,event_id rows between 2 preceding and current row) mx,
  avg(value) over(partition by user_id order by ts,event_id rows between 8 preceding and current row) mn from events),
q as (select *, list_sort(h)[len(h)//2+1] med from h),
r as (select *, list_sort(list_transform(h, lambda x: abs(x-med)))[len(h)//2+1] mad from q)
select event_id, value>=mx and value>=mn+(med+4.0*mad)*0.1 as peak from r""")
def adaptive_peaks(spark, d):
    return o.adaptive_peaks(_events(spark, d), "user_id", _ORDER, "value").select("event_id", "peak")


@query("""
with a as (select event_id,user_id,ts,value,min(value) over(partition by user_id order by ts,event_id rows between 2 preceding and 2 following) lo from events),
b as (select *, max(lo) over(partition by user_id order by ts,event_id rows between 2 preceding and 2 following) op from a)
select event_id, lo as eroded, value-op as top_hat from b""")
def morph_1d(spark, d):
    e = o.morph(o.top_hat(_events(spark, d), "user_id", _ORDER, "value", 2), "user_id", _ORDER, "value", "min", 2, "eroded")
    return e.select("event_id", "eroded", "top_hat")


@query("""
with t as (select user_id, event_type, row_number() over(partition by user_id order by ts,event_id)-1 as t from events),
k as (select user_id,t, case when t-lag(t) over(partition by user_id order by t)-1>2 or lag(t) over(partition by user_id order by t) is null then 1 else 0 end nw from t where event_type='click'),
g as (select *, sum(nw) over(partition by user_id order by t rows unbounded preceding) g from k),
r as (select user_id, min(t) x0, max(t) x1, count(*) n from g group by user_id,g having count(*)>=0.5*(max(t)-min(t)+1))
select user_id,x0,x1,n from r qualify row_number() over(partition by user_id order by x1-x0 desc, x0)=1""")
def longest_bridged_run(spark, d):
    e = _events(spark, d).withColumn("m", F.col("event_type") == "click")
    r = o.longest_bridged_run(e, "user_id", _ORDER, "m")
    return r.select("user_id", F.col("x0").cast("long").alias("x0"), F.col("x1").cast("long").alias("x1"), "n")


@query("""
with c as (select *, sum((event_type='error')::int) over(partition by user_id order by ts,event_id rows unbounded preceding) b from events)
select event_id, b > coalesce(lag(b) over(partition by user_id order by ts,event_id),0) as bar_before from c where event_type<>'error'""")
def bar_before(spark, d):
    e = _events(spark, d).withColumn("bar", F.col("event_type") == "error")
    return o.bar_before(e, "user_id", _ORDER, "bar").select("event_id", "bar_before")


@query("""
with e as (select *, row_number() over(partition by user_id order by ts,event_id) t from events),
l as (select a.event_id, b.event_type s, arg_max(b.value,b.t) v from e a join e b on a.user_id=b.user_id and b.t between a.t-4 and a.t-1 and b.event_type<>a.event_type group by 1,2)
select e.event_id, coalesce(r.ringing,'') as ringing from e left join (select event_id, string_agg(s||'='||cast(cast(round(v*100) as bigint) as varchar), ',' order by s) as ringing from l group by 1) r using(event_id)""")
def ringing_last4(spark, d):
    r = o.ringing(_events(spark, d), "user_id", _ORDER, "event_type", "value")
    text = F.array_join(F.transform("ringing", lambda x: F.concat(x["s"], F.lit("="), F.round(x["v"] * 100).cast("long").cast("string"))), ",")
    return r.select("event_id", text.alias("ringing"))


@query("""
with v as (select *, case when event_type='error' then null else value end x from events)
select event_id, last_value(x ignore nulls) over(partition by user_id order by ts,event_id rows between unbounded preceding and 1 preceding) as prev,
 first_value(x ignore nulls) over(partition by user_id order by ts,event_id rows between 1 following and unbounded following) as next from v""")
def prev_next_nonnull(spark, d):
    e = _events(spark, d).withColumn("x", F.when(F.col("event_type") != "error", F.col("value")))
    return o.neighbours(e, "user_id", _ORDER, "x").select("event_id", "prev", "next")


@query("""
with v as (select event_id,user_id,ts,row_number() over(partition by user_id order by ts,event_id) p, case when event_type='error' then null else value end x from events),
n as (select *, last_value(case when x is not null then p end ignore nulls) over(partition by user_id order by p rows between unbounded preceding and current row) pa,
 last_value(x ignore nulls) over(partition by user_id order by p rows between unbounded preceding and current row) va,
 first_value(case when x is not null then p end ignore nulls) over(partition by user_id order by p rows between current row and unbounded following) pb,
 first_value(x ignore nulls) over(partition by user_id order by p rows between current row and unbounded following) vb from v),
l as (select *, coalesce(va+(case when pb-pa>1e-9 then (p-pa)::double/(pb-pa) else 0.0 end)*(vb-va), va, vb) ln from n)
select event_id, round(max(ln) over(partition by user_id order by p rows unbounded preceding),6) as filled from l""")
def interpolate(spark, d):
    e = o.positions(_events(spark, d), "user_id", _ORDER, "p").withColumn("x", F.when(F.col("event_type") != "error", F.col("value")))
    return o.interpolate(e, "user_id", _ORDER, "p", "x").select("event_id", F.round("filled", 6).alias("filled"))


@query("""
with s as (select o_orderkey, o_custkey, o_totalprice, coalesce(sum(o_totalprice) over(partition by o_custkey order by o_orderdate,o_orderkey rows between unbounded preceding and 1 preceding),0.0) b,
 sum(o_totalprice) over(partition by o_custkey) t from orders)
select o_orderkey, round(b/t,6) as before_share, round((b+o_totalprice)/t,6) as after_share from s""")
def progress(spark, d):
    p = o.progress(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")
    return p.select("o_orderkey", F.round("before", 6).alias("before_share"), F.round("after", 6).alias("after_share"))


@query("""
with l as (select event_id, value, list_sort(list(value) over(partition by user_id order by ts,event_id rows between 3 preceding and 3 following)) h from events)
select event_id, h[len(h)//2+1] as median, abs(value-h[len(h)//2+1])>5.0 as odd from l""")
def neighbour_median_flag(spark, d):
    return o.neighbour_median(_events(spark, d), "user_id", _ORDER, "value").select("event_id", "median", "odd")


@query("""
select event_id, sum((event_type='click')::int) over(partition by user_id order by ts,event_id rows between 2 preceding and current row)>=2 as held from events""")
def held_2_of_3(spark, d):
    e = _events(spark, d).withColumn("m", F.col("event_type") == "click")
    return o.held(e, "user_id", _ORDER, "m").select("event_id", "held")


@query("""
with e as (select event_id,user_id,ts,cast(floor(value) as bigint) ep from events),
m as (select *, max(ep) over(partition by user_id order by ts,event_id rows unbounded preceding) mx from e)
select event_id, ep from m where ep>=mx""")
def epoch_fence(spark, d):
    e = _events(spark, d).withColumn("ep", F.floor("value"))
    return o.epoch_fence(e, "user_id", _ORDER, "ep").select("event_id", "ep")


@query("""
with s as (select event_id,user_id,event_type,cast(floor(epoch(ts)) as bigint) sec from events)
select a.event_id, count(distinct b.event_type) as alive from s a join s b on a.user_id=b.user_id and b.sec between a.sec-86400 and a.sec group by 1""")
def evidence_ttl(spark, d):
    e = _events(spark, d).withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    return o.evidence(e, "user_id", "sec", "event_type", ttl=86400).select("event_id", F.col("alive").cast("long").alias("alive"))


@query("""
with e as (select event_id,user_id,ts,cast(floor(epoch(ts)) as double) due from events)
select event_id, (due+3600.0) > due+greatest(0.5*7200.0, coalesce(lead(due) over(partition by user_id order by ts,event_id)-due,0.0)) as missed from e""")
def clock_miss(spark, d):
    e = _events(spark, d).withColumn("due", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double"))
    return o.missed(e, "user_id", _ORDER, "due", F.col("due") + 3600.0, speed=7200.0).select("event_id", "missed")


@query("""
with r as (select conv_id, turn, turn*10.0 as st, case when role='user' then [turn*10.0+35.0] else [] end as also from conversations where role<>'system'),
x as (select conv_id, turn, 0 as k, st as p from r union all select conv_id, turn, unnest(range(1,len(also)+1)) k, unnest(also) as p from r)
select conv_id, turn, k, cast(p as double) as start_at, row_number() over(partition by conv_id order by p,turn,k)-1 as seq,
 cast(greatest(1.0, coalesce(lead(p) over(partition by conv_id order by p,turn,k)-p,1.0)) as double) as dur, k>0 as repeat from x""")
def explode_sequence(spark, d):
    c = table(spark, d, "conversations").filter("role <> 'system'").select("conv_id", "turn", (F.col("turn") * F.lit(10.0)).alias("st"), F.when(F.col("role") == "user", F.array(F.col("turn") * F.lit(10.0) + 35.0)).alias("also"))
    s = o.explode_sequence(c, "conv_id", "turn", "st", "also")
    return s.select("conv_id", "turn", F.col("k").cast("long").alias("k"), F.col("at").alias("start_at"), F.col("seq").cast("long").alias("seq"), "dur", "repeat")


@query("""
with s as (select doc_id, source, sum(n_chars) over(partition by source order by doc_id desc rows unbounded preceding) spent, row_number() over(partition by source order by doc_id desc) rank from documents)
select doc_id, source, spent::bigint as spent from s where spent<=100000 and rank<=300""")
def size_budget(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return o.size_budget(docs, "source", F.col("doc_id").desc(), "n_chars", budget=100_000, most=300).select("doc_id", "source", "spent")
