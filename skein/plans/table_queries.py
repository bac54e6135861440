"""Rank statistics, joins and scores over tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.numeric import cents, half_up, hz_to_midi, iou, luma, midi_to_hz
from skein.functions.text import note_name
from skein.operators import joins as j
from skein.operators import ranks as r
from skein.operators import scoring as s
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
with s as (select l_returnflag k, l_extendedprice v, row_number() over(partition by l_returnflag order by l_extendedprice)-1 i, count(*) over(partition by l_returnflag) n from lineitem)
select k as l_returnflag, max(n) as n, max(v) filter(i=floor(0.9*(n-1))) as q90_floor, max(v) filter(i=floor(0.6*(n-1)+0.5)) as q60_round,
 max(v) filter(i=floor(n/2)) as med_upper, max(v) filter(i=floor((n-1)/2)) as med_lower,
 (max(v) filter(i=floor(n/2))+max(v) filter(i=floor((n-1)/2)))/2 as med_mean from s group by k""")
def rank_percentiles(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    q = r.exact_ranks(li, "l_returnflag", "l_extendedprice", {"q90_floor": r.FLOOR(0.9), "q60_round": r.NEAREST(0.6), "med_upper": r.UPPER, "med_lower": r.LOWER})
    return q.withColumn("med_mean", (F.col("med_upper") + F.col("med_lower")) / 2)


@query("select l_returnflag, cast(floor(l_quantity/5) as bigint) as cx, cast(floor(l_discount*50) as bigint) as cy, count(*) as n from lineitem group by all")
def cell_signature(spark, d):
    return r.cell_counts(table(spark, d, "lineitem"), "l_returnflag", F.col("l_quantity") / 5, F.col("l_discount") * 50)


@query("""
with c as (select l_returnflag, floor(l_quantity/5) cx, floor(l_discount*50) cy, count(*) n from lineitem group by all),
a as (select l_returnflag, cx-dx ax, cy-dy ay, sum(n) s from c, (values(0),(1)) x(dx), (values(0),(1)) y(dy) group by all)
select l_returnflag, cast(max(s) as bigint) as max_2x2 from a group by all""")
def max_window_2x2(spark, d):
    return r.max_window_2x2(r.cell_counts(table(spark, d, "lineitem"), "l_returnflag", F.col("l_quantity") / 5, F.col("l_discount") * 50), "l_returnflag")


@query("""
with s as (select l_suppkey, l_quantity v, row_number() over(partition by l_suppkey order by l_quantity)-1 i, count(*) over(partition by l_suppkey) n, count(*) filter(l_quantity>20.0) over(partition by l_suppkey) votes from lineitem)
select l_suppkey, max(n) as n, max(votes) as votes, case when max(votes)>=ceil(0.6*max(n)) then max(v) filter(i=floor(0.65*(n-1))) else 0.0 end as v from s group by l_suppkey""")
def rank65_composite(spark, d):
    c = r.ranked_composite(table(spark, d, "lineitem").select("l_suppkey", "l_quantity"), "l_suppkey", "l_quantity", gate=20.0)
    return c.withColumn("v", F.col("v").cast("double"))


@query("""
with f as (select event_type, extract(hour from ts) as h, count(*) n from events group by all), t as (select count(distinct user_id) u from events)
select event_type, h::int as h, n from f, t where n > 0.05*u""")
def hot_static_cells(spark, d):
    e = table(spark, d, "events")
    users = e.agg(F.countDistinct("user_id").alias("u"))
    cells = e.groupBy("event_type", F.hour("ts").alias("h")).agg(F.count("*").alias("n"))
    return cells.join(users, cells["n"] > 0.05 * users["u"]).select("event_type", "h", "n")


@query("""
with w as (select vec_id%50 as cluster, label, sum(case when vec_id%7=0 then 5 else 1 end) w from embeddings where label is not null group by all)
select cluster, arg_max(label, w*1000-label) as winner, max(w)/sum(w) as share, count(*)>1 as dissent from w group by cluster""")
def weighted_vote(spark, d):
    e = table(spark, d, "embeddings").filter("label IS NOT NULL").select((F.col("vec_id") % 50).alias("cluster"), "label", "vec_id")
    return r.weighted_vote(e, "cluster", "label", F.when(F.col("vec_id") % 7 == 0, 5).otherwise(1))


@query("""
with e as (select vec_id, label, cast(embedding as double[]) v from embeddings)
select a.label, a.vec_id as a, b.vec_id as b, round(list_dot_product(a.v,b.v),4) as dot from e a join e b on a.label=b.label and a.vec_id<b.vec_id where list_dot_product(a.v,b.v)>=0.35""")
def lookalike_pairs(spark, d):
    p = j.similar_pairs(table(spark, d, "embeddings"), id_col="vec_id", vector="embedding", bucket=["label"], threshold=0.35)
    return p.withColumn("dot", F.round("dot", 4))


@query("""
with p as (select user_id, event_id, cast(floor(epoch(ts)) as double) t0 from events where event_type='purchase'),
c as (select user_id, event_id as click_id, cast(floor(epoch(ts)) as double) t0 from events where event_type='click'),
m as (select p.user_id, p.event_id, c.click_id, abs(p.t0-c.t0) d from p join c on p.user_id=c.user_id and abs(p.t0-c.t0)<=86400)
select user_id,event_id,click_id,d from m qualify row_number() over(partition by user_id,event_id order by d,click_id)=1""")
def nearest_within_tol(spark, d):
    e = table(spark, d, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double"))
    left, right = e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'").withColumnRenamed("event_id", "click_id")
    return j.nearest_within(left, right, key="user_id", left_id="event_id", right_id="click_id", left_at="at", right_at="at", tol=86400.0)


@query("""
select user_id, event_type, event_id, value from events qualify row_number() over(partition by user_id,event_type order by ts desc,event_id desc)=1""")
def latest_wins(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return j.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""
with p as (select case when c_custkey%5=0 then c_custkey+1000000 else c_custkey end k, 'P'||c_custkey as nm, c_custkey%2=0 as hn, null::double as bal, c_custkey%9=0 as hb from customer where c_custkey%3=0)
select coalesce(c_custkey,k) as c_custkey, case when hn then nm else c_name end as c_name, case when hb then bal else c_acctbal end as c_acctbal from customer full join p on c_custkey=k""")
def upsert_keep_missing(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    k = F.col("c_custkey")
    p = c.filter(k % 3 == 0).select(
        F.when(k % 5 == 0, k + 1000000).otherwise(k).alias("c_custkey"), F.concat(F.lit("P"), k.cast("string")).alias("c_name"), (k % 2 == 0).alias("has_c_name"),
        F.lit(None).cast("double").alias("c_acctbal"), (k % 9 == 0).alias("has_c_acctbal"),
    )
    return j.upsert(c, p, "c_custkey", ["c_name", "c_acctbal"])


@query("select doc_id, source from documents where doc_id not in (select doc_id from labels where toxic=1)")
def anti_semi_delete(spark, d):
    return j.delete(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").filter("toxic = 1"), "doc_id")


@query("""
select d.doc_id, coalesce(l.quality, case when d.n_chars>1000 then 1 else 0 end) as quality, l.doc_id is not null as corrected from documents d left join labels l using(doc_id)""")
def correction_precedence(spark, d):
    base = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("quality"))
    return j.prefer(base, table(spark, d, "labels"), "doc_id", {"quality": F.col("quality")})


@query("select sha1(text) as sha1, min(doc_id) as first_id, count(*) as n from documents where text is not null group by 1")
def content_hash_dedupe(spark, d):
    return j.content_classes(table(spark, d, "documents"), "text", "doc_id")


@query("""
with s as (select doc_id, lang, n_chars//50 b, list_transform(['a','e','i','n','s','t'], lambda c: length(text)-length(replace(text,c,''))) g from documents where text is not null),
p as (select x.doc_id a, y.doc_id b, list_sum(list_transform(list_zip(x.g,y.g), lambda z: abs(z[1]-z[2]))) dist, greatest(list_sum(x.g),list_sum(y.g),1) mass from s x join s y on x.lang=y.lang and x.b=y.b and x.doc_id<y.doc_id)
select a, b, round(dist/mass,6) as distance from p where dist/mass<0.02""")
def sig_distance_dups(spark, d):
    text = F.col("text")
    counts = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in "aeinst"]
    docs = table(spark, d, "documents").filter("text IS NOT NULL").withColumn("cell", F.floor(F.col("n_chars") / 50))
    p = j.signature_pairs(docs, id_col="doc_id", counts=counts, bucket=["lang", "cell"], below=0.02)
    return p.select("a", "b", F.round("distance", 6).alias("distance"))


@query("""
with x as (select lang, quality=1 as t, n_chars>800 as g from documents join labels using(doc_id)),
c as (select lang, count(*) filter(t and g) tp, count(*) filter(not t and g) fp, count(*) filter(t and not g) fn from x group by lang)
select lang,tp,fp,fn, tp/greatest(1,tp+fp) as precision, tp/greatest(1,tp+fn) as recall, 2*tp/greatest(1,2*tp+fp+fn) as f1 from c""")
def micro_f1(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return s.micro_f1(x, F.col("quality") == 1, F.col("n_chars") > 800, ["lang"])


@query("""
with x as (select n_chars as conf, quality=0 as err from documents join labels using(doc_id)), n as (select count(*) n, count(*) filter(err) e from x),
t as (select list_sort(list(conf))[cast(floor(0.1*count(*)) as bigint)+1] as th from x)
select th as threshold, n, count(*) filter(conf<th) as flagged, count(*) filter(conf<th and err) as caught, e as errors, count(*) filter(conf<th and err)/greatest(1,e) as share from x, n, t group by th,n,e""")
def flag_stats(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return s.flag_stats(x, "n_chars", F.col("quality") == 0)


_STARTS = """
with f as (select user_id, event_id, cast(floor(epoch(ts)) as double) t0 from events where event_type='view'),
t as (select user_id, event_id as truth_id, cast(floor(epoch(ts)) as double) t0, cast(floor(value) as bigint)%5 as label from events where event_type='click'),
m as (select f.user_id,f.event_id,t.truth_id,abs(f.t0-t.t0) d from f join t on f.user_id=t.user_id and abs(f.t0-t.t0)<=43200 qualify row_number() over(partition by f.user_id,f.event_id order by abs(f.t0-t.t0),t.truth_id)=1),
n as (select f.user_id,f.event_id,f.t0,t.label from f left join m using(user_id,event_id) left join t using(user_id,truth_id)),
q as (select *, case when label is null then 'spurious' when row_number() over(partition by user_id,label order by t0,event_id)=1 then 'correct' else 'dup' end st from n),
c as (select user_id, count(*) found, count(*) filter(st='correct') correct, count(*) filter(st='dup') dup, count(*) filter(st='spurious') spurious from q group by 1),
w as (select user_id, count(distinct label) wanted from t group by 1),
sc as (select w.user_id, wanted, coalesce(found,0) as found, coalesce(correct,0) as correct, coalesce(dup,0) as dup, coalesce(spurious,0) as spurious, coalesce(correct,0)/wanted as recall, coalesce(correct,0)/greatest(1,coalesce(found,0)) as precision from w left join c using(user_id))
"""


def _starts(spark, d):
    e = table(spark, d, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double"))
    truth = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("truth_id"), "at", (F.floor("value") % 5).alias("label"))
    return s.score_starts(e.filter("event_type = 'view'"), truth, key="user_id", found_id="event_id", truth_id="truth_id", at="at", label="label", tol=43200.0)


@query(_STARTS + "select * from sc")
def score_starts(spark, d):
    return _starts(spark, d)


@query(_STARTS + "select sc.user_id, recall>=coalesce(case when sc.user_id%2=0 then 0.5 end,0.8) and precision>=coalesce(case when sc.user_id%2=0 then 0.3 end,0.6) as passed from sc")
def floors_gate(spark, d):
    scores = _starts(spark, d)
    floors = scores.filter("user_id % 2 = 0").select("user_id", F.lit(0.5).alias("recall"), F.lit(0.3).alias("precision"))
    return s.gate(scores, floors, "user_id", ["recall", "precision"], {"recall": 0.8, "precision": 0.6}).select("user_id", "passed")


@query("select cast(floor(value) as bigint) as midi, count(*) as n, min(event_id) as first_id from events where event_type='error' group by 1 order by n desc, first_id limit 3")
def top_missed(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'").groupBy(F.floor("value").alias("midi")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))
    return e.orderBy(F.desc("n"), "first_id").limit(3)


@query("""
with r as (select sh, avg(case when (cast(floor(value) as bigint)+sh)%4=0 then 1.0 else 0.0 end) rate from events, (select unnest(range(-2,3)) sh) group by sh),
t as (select max(rate) top, max(rate) filter(sh=0) base, arg_max(sh, rate*1e6-abs(sh)*1e-3-sh*1e-5) best from r)
select cast(case when top>=base+0.1 then best else 0 end as int) as shift, round(top,6) as top, round(base,6) as base from t""")
def shift_probe(spark, d):
    e = table(spark, d, "events").select("value", F.explode(F.array(*map(F.lit, range(-2, 3)))).alias("sh"))
    b = s.best_shift(e, "sh", (F.floor("value") + F.col("sh")) % 4 == 0)
    return b.select(F.col("shift").cast("int").alias("shift"), F.round("top", 6).alias("top"), F.round("base", 6).alias("base"))


@query("""
with b as (select l_orderkey, l_linenumber n, l_quantity x, l_discount*100 y, 10.0+l_linenumber w, 5.0 h from lineitem),
p as (select a.l_orderkey, a.n a, b.n b, greatest(0.0,least(a.x+a.w,b.x+b.w)-greatest(a.x,b.x))*greatest(0.0,least(a.y+a.h,b.y+b.h)-greatest(a.y,b.y)) i, a.w*a.h+b.w*b.h ar from b a join b on a.l_orderkey=b.l_orderkey and a.n<b.n)
select l_orderkey, a, b, round(i/(ar-i),6) as iou from p where i>0""")
def box_iou(spark, d):
    li = table(spark, d, "lineitem")
    box = lambda n: li.select("l_orderkey", F.col("l_linenumber").alias(n), F.col("l_quantity").alias(f"{n}x"), (F.col("l_discount") * 100).alias(f"{n}y"), (F.col("l_linenumber") + 10.0).alias(f"{n}w"), F.lit(5.0).alias(f"{n}h"))
    c = [F.col(f"{n}{k}") for n in "ab" for k in "xywh"]
    both = box("a").join(box("b"), "l_orderkey").filter("a < b").withColumn("iou", iou(*c))
    return both.filter("iou > 0").select("l_orderkey", "a", "b", F.round("iou", 6).alias("iou"))


@query("""
with n as (select p_partkey, p_size+20 as midi from part)
select p_partkey, round(440*pow(2,(midi-69)/12.0),6) as hz, round(69+12*log2(440*pow(2,(midi-69)/12.0)/440),6) as back, round(1200*log2(440*pow(2,(midi-69)/12.0)/261.625565),4) as cents_c4,
 ['C','C♯','D','D♯','E','F','F♯','G','G♯','A','A♯','B'][midi%12+1] || cast(midi//12-1 as varchar) as name from n""")
def midi_math(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") + 20).alias("midi"))
    hz = midi_to_hz(F.col("midi"))
    return p.select("p_partkey", F.round(hz, 6).alias("hz"), F.round(hz_to_midi(hz), 6).alias("back"), F.round(cents(hz, F.lit(261.625565)), 4).alias("cents_c4"), note_name(F.col("midi")).alias("name"))


@query("""
select l_orderkey, l_linenumber, floor((l_quantity-25.5)*10+0.5)/10 as rounded, (77*(l_partkey%256)+150*(l_suppkey%256)+29*(l_orderkey%256))>>8 as luma,
 255-((77*(l_partkey%256)+150*(l_suppkey%256)+29*(l_orderkey%256))>>8) as ink_light from lineitem""")
def ink_luma(spark, d):
    y = luma(F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_orderkey") % 256)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", half_up(F.col("l_quantity") - 25.5, 10).alias("rounded"), y.alias("luma"), (255 - y).alias("ink_light"))
