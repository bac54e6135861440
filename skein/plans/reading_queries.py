"""Queries over nested readings, maps and JSON, each beside its SQL over flat rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as t
from skein.operators import ordered as o
from skein.operators import readings as r
from skein.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Notes of an order: its lines, two line numbers to an event.
_NOTES = """
with u as (select l_orderkey, l_linenumber as string, min(l_partkey) p, min(l_suppkey) s, min(l_quantity) q, min(l_discount) d from lineitem group by all),
notes as (select l_orderkey, string, (string-1)//2 as g, case when p%11=0 then null else cast(q as int)%25 end as fret, d*10 as conf, string*10.0+(p%7) as x, 8.0 as w, cast(p%4 as int) as flags,
 case when p%11=0 then 'x' when s%5=0 then 'ghost' when s%5=1 then 'harm' when s%5=2 then 'h' else '' end as tech from u),
placed as (select *, dense_rank() over(partition by l_orderkey order by g)-1 as e, row_number() over(partition by l_orderkey, g order by string)-1 as n from notes),
ev as (select l_orderkey, g, e, (min(x)+max(x+w))/2 as xc from placed group by all)
"""


def _readings(spark, d):
    u = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("string")).agg(*[F.min(c).alias(k) for k, c in (("p", "l_partkey"), ("s", "l_suppkey"), ("q", "l_quantity"), ("d", "l_discount"))])
    tech = F.when(F.col("p") % 11 == 0, F.array(F.lit("x"))).when(F.col("s") % 5 == 0, F.array(F.lit("ghost"))).when(F.col("s") % 5 == 1, F.array(F.lit("harm"))).when(F.col("s") % 5 == 2, F.array(F.lit("h")))
    note = F.struct(
        F.col("string").cast("int").alias("string"), F.when(F.col("p") % 11 != 0, F.col("q").cast("int") % 25).alias("fret"), F.coalesce(tech, F.array().cast("array<string>")).alias("tech"), (F.col("d") * 10).alias("conf"),
        (F.col("string") * 10.0 + F.col("p") % 7).alias("x"), F.lit(8.0).alias("w"), (F.col("p") % 4).cast("int").alias("flags"),
    )
    events = u.groupBy("l_orderkey", F.floor((F.col("string") - 1) / 2).alias("g")).agg(r.with_span(F.collect_list(note)).alias("ev"))
    return events.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("g", "ev"))), lambda x: x["ev"]).alias("events"))


def _flat(df):
    notes = df.select("l_orderkey", F.posexplode("events").alias("e", "ev")).select("l_orderkey", "e", F.round("ev.xc", 6).alias("xc"), F.posexplode("ev.notes").alias("n", "note"))
    return notes.select("l_orderkey", F.col("e").cast("long").alias("e"), F.col("n").cast("long").alias("n"), "xc", "note.string", F.coalesce("note.fret", F.lit(-1)).alias("fret"), F.array_join("note.tech", ",").alias("tech"), F.round("note.conf", 6).alias("conf"), "note.flags")


@query(_NOTES + "select l_orderkey, e, n from placed where conf<0.5 and flags&3=0")
def reading_unsure(spark, d):
    return r.find_notes(_readings(spark, d), ["l_orderkey"], r.unsure).select("l_orderkey", F.col("e").cast("long").alias("e"), F.col("n").cast("long").alias("n"))


@query(_NOTES + "select l_orderkey, bool_or(flags&3<>0) as edited from placed group by 1")
def reading_edited(spark, d):
    return _readings(spark, d).select("l_orderkey", r.edited(F.col("events")).alias("edited"))


_OUT = "string, coalesce(fret,-1) as fret, tech, round(conf,6) as conf, flags"


@query(_NOTES + f"""
, c as (select * replace (case when e=0 and n=0 then 1.0 else conf end as conf, case when e=0 and n=0 then cast((flags|2)|(case when conf<0.5 then 4 else 0 end) as int) else flags end as flags) from placed)
select c.l_orderkey, c.e, n, round(ev.xc,6) as xc, {_OUT} from c join ev using(l_orderkey,g)""")
def reading_confirm(spark, d):
    df = _readings(spark, d)
    return _flat(df.withColumn("events", r.confirm_note(F.col("events"), 0, 0)))


@query(_NOTES + f"""
, c as (select * replace (case when e=1 and n=0 then (case when l_orderkey%3=0 then null else cast(l_orderkey%30 as int) end) else fret end as fret,
   case when e=1 and n=0 then (case when l_orderkey%3=0 then (case when tech in ('','x') then 'x' else tech||',x' end) when tech='x' then '' else tech end) else tech end as tech,
   case when e=1 and n=0 then 1.0 else conf end as conf, case when e=1 and n=0 then cast((flags|1)|(case when conf<0.5 then 4 else 0 end) as int) else flags end as flags) from placed),
v as (select * from c where l_orderkey%3=0 or l_orderkey%30<=24 union all select * from placed where l_orderkey%3<>0 and l_orderkey%30>24)
select v.l_orderkey, v.e, n, round(ev.xc,6) as xc, {_OUT} from v join ev using(l_orderkey,g)""")
def reading_set_fret(spark, d):
    fret = F.when(F.col("l_orderkey") % 3 != 0, (F.col("l_orderkey") % 30).cast("int"))
    return _flat(_readings(spark, d).withColumn("events", r.set_fret(F.col("events"), 1, 0, fret)))


@query(_NOTES + f"""
, k as (select * from placed where not (e=0 and n=0)),
m as (select *, dense_rank() over(partition by l_orderkey order by g)-1 as e2, row_number() over(partition by l_orderkey,g order by string)-1 as n2 from k),
x2 as (select l_orderkey, g, (min(x)+max(x+w))/2 as xc from k group by all)
select m.l_orderkey, e2 as e, n2 as n, round(x2.xc,6) as xc, {_OUT} from m join x2 using(l_orderkey,g)""")
def reading_delete(spark, d):
    return _flat(_readings(spark, d).withColumn("events", r.delete_note(F.col("events"), 0, 0)))


@query(_NOTES + """
, taken as (select distinct l_orderkey, g from placed where string=3),
j as (select ev.l_orderkey, min(ev.e) as e from ev left join taken on ev.l_orderkey=taken.l_orderkey and ev.g=taken.g where taken.g is null and abs(ev.xc-49.0)<=0.4*20.0 group by 1),
c as (select l_orderkey, count(*) as n, count(*) filter(xc<=49.0) as before from ev group by 1)
select c.l_orderkey, j.e is not null as joined, n+(case when j.e is null then 1 else 0 end) as n_events, coalesce(j.e, before) as e from c left join j using(l_orderkey)""")
def reading_add(spark, d):
    before = _readings(spark, d)
    after = before.withColumn("new", r.add_note(F.col("events"), F.lit(3), F.lit(7), F.lit(45.0), F.lit(8.0), F.lit(20.0)))
    added = lambda ev: F.exists(ev["notes"], lambda n: (n["string"] == 3) & (n["x"] == 45.0) & (n["flags"] == r.SET) & (n["fret"] == 7) & (n["conf"] == 1.0))
    at = F.array_position(F.transform("new", added), True) - 1
    own = F.exists(F.filter("new", added), lambda ev: F.size(ev["notes"]) == 1)
    return after.select("l_orderkey", (~own).alias("joined"), F.size("new").cast("long").alias("n_events"), at.alias("e"))


@query(_NOTES + """
, h as (select *, [64,59,55,50,45,40][string]+2 as op, fret is null or tech='x' as muted from placed where string between 1 and 6),
b as (select l_orderkey, e, string, case when not muted then op+(case when tech='harm' then coalesce(map{4:28,5:24,7:19,9:28,12:12,16:28,19:19,24:24}[fret], fret) else fret end) end as midi, not muted and tech<>'ghost' and conf>=0.5 as required from h)
select l_orderkey, e, string, coalesce(midi,-1) as midi, required, not bool_or(required) over(partition by l_orderkey,e) as pitchless from b""")
def reading_pitches(spark, d):
    ev = _readings(spark, d).select("l_orderkey", F.explode(r.build_events(F.col("events"), capo=2)).alias("ev"))
    flat = ev.select("l_orderkey", F.col("ev.e").cast("long").alias("e"), "ev.pitchless", F.explode("ev.notes").alias("n"))
    return flat.select("l_orderkey", "e", "n.string", F.coalesce("n.midi", F.lit(-1)).alias("midi"), "n.required", "pitchless")


@query("""
with s as (select p_partkey, p_size%30 as f, p_partkey%4 as k from part),
e as (select *, case k when 0 then 'hg' when 1 then 'b'||f when 2 then '(~r'||f else '<' end as code from s)
select p_partkey, code, case k when 0 then 'h,grace' when 1 then 'b' when 2 then 'ghost,~,r' else 'harm' end as tech, case when k in (1,2) then f else -1 end as bend_to from e""")
def technique_codec(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 30).alias("f"), (F.col("p_partkey") % 4).alias("k"))
    names = F.when(F.col("k") == 0, F.array(*map(F.lit, ("h", "odd", "grace")))).when(F.col("k") == 1, F.array(F.lit("b"))).when(F.col("k") == 2, F.array(*map(F.lit, ("ghost", "~", "r")))).otherwise(F.array(F.lit("harm")))
    coded = p.select("p_partkey", r.encode_techniques(names, F.when(F.col("k").isin(1, 2), F.col("f"))).alias("code"))
    back = coded.withColumn("back", r.decode_techniques(F.col("code")))
    return back.select("p_partkey", "code", F.array_join("back.tech", ",").alias("tech"), F.coalesce("back.bend_to", F.lit(-1)).alias("bend_to"))


@query("""
with e as (select l_orderkey, case when l_linenumber=7 then 'bad key' else sha1(cast(l_linenumber as varchar)) end as k, max(cast(l_quantity as bigint)) as q from lineitem group by all),
f as (select *, row_number() over(partition by l_orderkey order by q desc, k) rn, sum(10+length(cast(q as varchar))) over(partition by l_orderkey order by q desc, k rows unbounded preceding) spent from e where regexp_matches(k,'^[0-9a-f]{40}$'))
select l_orderkey, string_agg(k||'='||q, ',' order by k) as pages from f where rn<=3 and spent<=23 group by 1""")
def newest_pages(spark, d):
    key = F.when(F.col("l_linenumber") == 7, "bad key").otherwise(F.sha1(F.col("l_linenumber").cast("string").cast("binary")))
    e = table(spark, d, "lineitem").groupBy("l_orderkey", key.alias("k")).agg(F.max(F.col("l_quantity").cast("long")).alias("at"))
    m = e.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("at").alias("v")))).alias("pages"))
    kept = r.newest_entries(F.col("pages"), "^[0-9a-f]{40}$", lambda v: v["at"], lambda v: 10 + F.length(v["at"].cast("string")), most=3, budget=23)
    text = F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda x: F.concat(x["key"], F.lit("="), x["value"]["at"].cast("string")))), ",")
    return m.select("l_orderkey", text.alias("pages")).filter("pages <> ''")


@query("""
with l as (select o_custkey, o_orderstatus k, max(o_orderkey) v from orders where o_orderkey%2=0 group by all), rr as (select o_custkey, o_orderstatus k, max(o_orderkey) v from orders where o_orderkey%2=1 group by all),
b as (select o_custkey, k, coalesce(rr.v, l.v) v from l full join rr using(o_custkey,k))
select o_custkey, string_agg(k||'='||v, ',' order by k) as merged from b where o_custkey in (select o_custkey from l) and o_custkey in (select o_custkey from rr) group by 1""")
def map_union(spark, d):
    def side(rest: int, name: str):
        e = table(spark, d, "orders").filter(F.col("o_orderkey") % 2 == rest).groupBy("o_custkey", "o_orderstatus").agg(F.max("o_orderkey").alias("v"))
        return e.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "v"))).alias(name))

    both = side(0, "l").join(side(1, "r"), "o_custkey")
    text = F.array_join(F.array_sort(F.transform(F.map_entries(r.union_by_right(F.col("l"), F.col("r"))), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))), ",")
    return both.select("o_custkey", text.alias("merged"))


@query("""
with x as (select p_partkey, [p_size%3, p_partkey%5, p_size%3] as a, [p_partkey%5, p_size%7] as b from part),
f as (select p_partkey, list_concat(a,b) as u from x)
select p_partkey, array_to_string(list_filter(u, lambda v, i: list_position(u,v)=i),',') as merged, case when p_partkey%5 in (1,2) then 'one' when p_partkey%5=3 then 'three' else cast(p_partkey%5 as varchar) end as label from f""")
def unions_and_synonyms(spark, d):
    c = lambda x: F.col(x).cast("bigint")
    p = table(spark, d, "part").select("p_partkey", F.array(c("p_size") % 3, c("p_partkey") % 5, c("p_size") % 3).alias("a"), F.array(c("p_partkey") % 5, c("p_size") % 7).alias("b"))
    label = r.canonical((c("p_partkey") % 5).cast("string"), [["one", "1", "2"], ["three", "3"]])
    return p.select("p_partkey", F.array_join(r.ordered_union(F.col("a"), F.col("b")).cast("array<string>"), ",").alias("merged"), label.alias("label"))


@query("""
select o_orderkey, least(2.0, greatest(0.25, case when o_orderkey%5=0 then 1.0 else floor(o_totalprice/100000*100+0.5)/100 end)) as speed,
 cast(case when floor(o_totalprice/500+0.5) between 20 and 400 then floor(o_totalprice/500+0.5) else 0 end as int) as tempo from orders""")
def practice_settings(spark, d):
    given = F.when(F.col("o_orderkey") % 5 == 0, "fast").otherwise((F.col("o_totalprice") / 100000).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", r.play_speed(given).alias("speed"), r.song_tempo(F.col("o_totalprice") / 500).alias("tempo"))


@query("""
select doc_id, case when doc_id%4=0 then -1 else n_chars end as n, case when doc_id%4=0 then '' else lang end as lang from documents where n_chars is not null and lang is not null""")
def json_lines(spark, d):
    docs = table(spark, d, "documents").filter("n_chars IS NOT NULL AND lang IS NOT NULL")
    own = F.when(F.col("doc_id") % 4 != 0, F.to_json(F.struct(F.col("n_chars").alias("n"), "lang"))).otherwise("[1]")
    lines = F.concat_ws("\n", F.lit("starting {"), F.lit("{broken"), F.concat(F.lit(" "), own), F.when(F.col("doc_id") % 4 != 0, F.lit('{"n":0}')))
    found = docs.select("doc_id", F.from_json(r.first_json_object(lines), "n bigint, lang string").alias("j"))
    return found.select("doc_id", F.coalesce("j.n", F.lit(-1)).alias("n"), F.coalesce("j.lang", F.lit("")).alias("lang"))


@query("""
with e as (select event_id, user_id, cast(floor(epoch(ts)) as bigint) s, value from events)
select a.event_id, min(b.value) as low, max(b.value) as high from e a left join e b on a.user_id=b.user_id and b.s between a.s-172800 and a.s-3600 group by 1""")
def range_extremes(spark, d):
    e = table(spark, d, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    return o.range_extremes(e, "user_id", "s", "value", since=172800, until=3600).select("event_id", "low", "high")


@query("""
with e as (select event_id, user_id, value, lag(value) over w p, lead(value) over w x from events window w as (partition by user_id order by ts,event_id)),
m as (select *, row_number() over(partition by user_id order by value desc, event_id) rn from e where value>=coalesce(p,-1e300) and value>coalesce(x,-1e300))
select user_id, event_id, value, rn as rank from m where rn<=6""")
def local_maxima(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return o.local_maxima(e, "user_id", ["ts", "event_id"], "value", "event_id", most=6).select("user_id", "event_id", "value", F.col("rank").cast("long").alias("rank"))


#: A token for each part: every kind of mark, and what is not one.
_MARKS = ["0", "12", "25", "g7", "X", "x", "(5)", "<12>", "7b9", "7r5", "h7", "s3?", "/x", "7~", "p10~?", "g3b5", "(5)b7", "12b5r7", "", "h"]


@query("""
with n as (select p_partkey, p_partkey%8 as string, [""" + ",".join(f"'{m}'" for m in _MARKS) + r"""][p_partkey%20+1] as mark from part),
a as (select *, mark as s0, ends_with(mark,'?') as unsure from n),
b as (select *, case when unsure then left(s0,-1) else s0 end as s1 from a),
c as (select *, ends_with(s1,'~') as vib, case when ends_with(s1,'~') then left(s1,-1) else s1 end as s2 from b),
e as (select *, s2 in ('7b9','7r5','g3b5','12b5r7') as bent from c),
f as (select *, case when bent then cast(substr(s2, length(s2)-(case when s2 like '%_0' then 1 else 0 end)) as int) end as bend_to, case s2 when '7b9' then '7' when '7r5' then '7' when 'g3b5' then 'g3' when '12b5r7' then '12b5' else s2 end as s3 from e),
g as (select *, left(s3,1) in ('h','p','s','/') and length(s3)>1 as led, case when left(s3,1) in ('h','p','s','/') and length(s3)>1 then substr(s3,2) else s3 end as s4 from f),
k as (select *, case when s4 in ('x','X') then 'x' when left(s4,1)='(' and right(s4,1)=')' then 'ghost' when left(s4,1)='<' and right(s4,1)='>' then 'harm' when left(s4,1)='g' then 'grace' when try_cast(s4 as int) is not null and length(s4)<=2 then 'plain' end as kind from g),
m as (select *, case kind when 'ghost' then try_cast(trim(s4,'()') as int) when 'harm' then try_cast(trim(s4,'<>') as int) when 'grace' then try_cast(substr(s4,2) as int) when 'plain' then cast(s4 as int) end as fret from k),
v as (select *, string between 1 and 6 and kind is not null and (kind='x' or (fret is not null and fret<=24)) as ok from m)
select p_partkey, ok, coalesce(case when ok then string end,-1) as string, coalesce(case when ok then fret end,-1) as fret, coalesce(case when ok then bend_to end,-1) as bend_to, coalesce(case when ok then unsure end,false) as unsure,
 case when ok then array_to_string(list_filter([case when vib then '~' end, case when bent then (case when s2='7b9' or s2='g3b5' then 'b' else 'r' end) end, case when led then left(s3,1) end, case when kind<>'plain' then kind end], lambda t: t is not null),',') else '' end as tech from v""")
def note_marks(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.concat((k % 8).cast("string"), F.lit(":"), F.element_at(F.array(*map(F.lit, _MARKS)), (k % 20 + 1).cast("int"))).alias("note"))
    n = p.withColumn("p", t.parse_note(F.col("note")))
    minus = lambda c: F.coalesce(c, F.lit(-1))
    return n.select("p_partkey", F.col("p").isNotNull().alias("ok"), minus("p.string").cast("bigint").alias("string"), minus("p.fret").alias("fret"), minus("p.bend").alias("bend_to"), F.coalesce("p.unsure", F.lit(False)).alias("unsure"), F.coalesce(F.array_join("p.tech", ","), F.lit("")).alias("tech"))


@query("""
with n as (select l_orderkey, l_linenumber, min(l_partkey) p from lineitem where l_linenumber<=6 group by all),
e as (select l_orderkey, count(*) as n, bool_or(p%6+1 in (select 0)) as never, count(distinct p%6+1)=count(*) as apart from n group by 1)
select l_orderkey, case when l_orderkey%9=0 then 0 when apart then n else -1 end as notes, l_orderkey%9=0 as bar from e""")
def note_events(spark, d):
    """Events of several notes: a string that is named twice spoils the event."""
    n = table(spark, d, "lineitem").filter("l_linenumber <= 6").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    text = F.array_join(F.collect_list(F.concat((F.col("p") % 6 + 1).cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))), "  ")
    e = n.groupBy("l_orderkey").agg(text.alias("text")).withColumn("ev", t.parse_event(F.when(F.col("l_orderkey") % 9 == 0, " | ").otherwise(F.col("text"))))
    return e.select("l_orderkey", F.when(F.col("ev").isNull(), -1).otherwise(F.size("ev.notes")).cast("long").alias("notes"), F.coalesce("ev.bar", F.lit(False)).alias("bar"))
