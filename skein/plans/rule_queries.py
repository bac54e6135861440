"""Rules of one row, stored pages, settled transcripts, sweeps, words, centres and suppressed messages, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import rules
from skein.functions.numeric import half_up
from skein.operators import content, joins, ordered, ranks, sequential, settling
from skein.sources.tables import table

QUERIES, ORACLES = {}, {}

#: 2024-06-01 12:00 UTC, the time that ages are told at.
NOW = 1717243200


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
select event_id, least(2.0, greatest(0.25, floor((case when coalesce(value,0)=0 then 1.0 else value end)*100+0.5)/100)) as speed,
 cast(case when floor(coalesce(value,0)+0.5)>=20 and floor(coalesce(value,0)+0.5)<=400 then floor(value+0.5) else 0 end as bigint) as bpm,
 case when event_id%4=0 or event_id%7=0 or user_id%5=0 then 0.0 else (event_id%7)::double/(user_id%5) end as rate from events""")
def playing_settings(spark, d):
    e = table(spark, d, "events")
    b = F.when(F.col("event_id") % 4 == 0, "").otherwise((F.col("user_id") % 5).cast("string"))
    rate = rules.parse_rate(F.concat((F.col("event_id") % 7).cast("string"), F.lit("/"), b))
    return e.select("event_id", rules.clamp_speed(F.col("value")).alias("speed"), rules.clean_bpm(F.col("value")).alias("bpm"), rate.alias("rate"))


_HEADER = "case event_id%7 when 0 then 'bytes=10-20' when 1 then 'bytes=-5' when 2 then 'bytes=7-' when 3 then 'bytes=-' when 4 then 'bytes=90-2' when 5 then 'items=1-2' end"


@query(f"""
with e as (select event_id, user_id*3 as size, {_HEADER} as h from events),
p as (select *, h like 'bytes=%' as known, try_cast(string_split(substr(h,7),'-')[1] as bigint) a, try_cast(string_split(substr(h,7),'-')[2] as bigint) b from e),
r as (select *, case when a is null then greatest(0,size-b) else a end s, case when a is null or b is null then size-1 else least(b,size-1) end t from p),
o as (select *, known and not (a is null and b is null) and s<=t and s<size as fits from r)
select event_id, case when h is null then 200 when fits then 206 else 416 end as status,
 cast(case when h is null then 0 when fits then s else -1 end as bigint) as start_byte, cast(case when h is null then size-1 when fits then t else -1 end as bigint) as end_byte from o""")
def byte_ranges(spark, d):
    e = table(spark, d, "events").select("event_id", rules.byte_range(F.expr(_HEADER), F.col("user_id") * 3).alias("r"))
    return e.select("event_id", "r.status", *[F.coalesce(f"r.{c}", F.lit(-1).cast("bigint")).alias(f"{c}_byte") for c in ("start", "end")])


@query(f"""
with e as (select event_id, user_id, cast(floor(epoch(ts)) as bigint) s, cast(ts as date) as dated from events),
a as (select *, {NOW}-s-event_id%9*86400 as ago from (select event_id, user_id, dated, greatest(s, {NOW}-700000+event_id*70) as s from e))
select event_id, case when event_id%3=0 then '10.0.0.'||user_id when event_id%5=0 then 'unknown' else '127.0.0.1' end as ip,
 case when event_id%4=0 then -1 else greatest(0, date_diff('day', dated, date '2024-06-01')+1) end as age,
 case when ago<60 then 'just now' when ago<3600 then case when floor(ago/60.0+0.5)=1 then '1 minute ago' else floor(ago/60.0+0.5)::bigint||' minutes ago' end
  when ago<86400 then case when floor(ago/3600.0+0.5)=1 then '1 hour ago' else floor(ago/3600.0+0.5)::bigint||' hours ago' end
  when ago<604800 then case when floor(ago/86400.0+0.5)=1 then 'yesterday' else floor(ago/86400.0+0.5)::bigint||' days ago' end
  else strftime(make_timestamp(({NOW}-ago)*1000000),'%Y-%m-%d') end as told from a""")
def addresses_and_ages(spark, d):
    e = table(spark, d, "events")
    n, s = F.col("event_id"), F.unix_seconds(F.col("ts").cast("timestamp"))
    sent = F.when(n % 3 == 0, F.concat(F.lit(" 10.0.0."), F.col("user_id").cast("string"), F.lit(" , 1.1.1.1"))).when(n % 3 == 1, "")
    ip = rules.client_ip(sent, F.when(n % 5 != 0, "127.0.0.1"))
    version = F.when(n % 4 == 0, "latest").otherwise(F.date_format("ts", "yyyy.MM.dd.'1'"))
    at = F.greatest(s, F.lit(NOW - 700000) + n * 70) + n % 9 * 86400
    return e.select("event_id", ip.alias("ip"), F.coalesce(rules.age_days(version, F.lit(NOW)), F.lit(-1).cast("bigint")).alias("age"), rules.how_long_ago(at, F.lit(NOW)).alias("told"))


@query("""
with e as (select event_id, floor(coalesce(value,0)) as t0, event_id%5 as n from events),
x as (select *, unnest(range(greatest(1, n))) as i from e)
select event_id, i::int as i, round(case when n<=1 then t0+6.0 else t0+1.2+9.6*i/(n-1) end,6) as t from x""")
def spread_times(spark, d):
    e = table(spark, d, "events").withColumn("t0", F.floor(F.coalesce("value", F.lit(0.0))).cast("double"))
    t = rules.spread_times(F.col("t0"), F.col("t0") + 12.0, F.col("event_id") % 5, 0.1, 0.9)
    return e.select("event_id", F.posexplode(t).alias("i", "t")).withColumn("t", F.round("t", 6))


@query("""
with s as (select event_id, unnest([{t: (event_id%50)::double, i: 0, id: 'a'||user_id}, {t: (user_id%50)::double, i: 1, id: 'b'}]) p from events)
select event_id, p.t as t, p.id as id, row_number() over(partition by event_id order by p.t, p.i)-1 as place from s""")
def screen_sequence(spark, d):
    e = table(spark, d, "events")
    a, b = (F.col("event_id") % 50).cast("string"), (F.col("user_id") % 50).cast("string")
    text = F.concat(F.lit("  "), a, F.lit(":a"), F.col("user_id").cast("string"), F.lit(" \n"), b, F.lit(":b "))
    s = e.select("event_id", F.posexplode(rules.parse_sequence(text)).alias("place", "p"))
    return s.select("event_id", "p.t", "p.id", F.col("place").cast("bigint").alias("place"))


_PAGES = """i as (select doc_id//10 as sheet, doc_id%10+1 as position, sha1(coalesce(lang,'-')||(coalesce(n_chars,0)%3)) as h from documents),
s as (select doc_id//10 as sheet, doc_id%10 as position, 'old-'||doc_id as name, sha1(coalesce(lang,'-')||((coalesce(n_chars,0)+doc_id)%3)) as h from documents where doc_id%10<4),
o as (select sheet, h, arg_max(name,position) as name from s group by all), f as (select sheet, h, min(position) as p from i group by all),
r as (select i.sheet, i.position, i.h as sha1, coalesce(o.name,'page-'||lpad(f.p::varchar,3,'0')||'-'||left(i.h,8)||'.png') as name, o.name is not null or i.position>f.p as reused
 from i join f using(sheet,h) left join o using(sheet,h))"""


def _pages(spark, d):
    t = table(spark, d, "documents").withColumn("sheet", F.expr("doc_id div 10"))
    held = lambda n: F.sha1(F.concat(F.coalesce("lang", F.lit("-")), (n % 3).cast("string")).cast("binary"))
    n = F.coalesce("n_chars", F.lit(0))
    pages = t.select("sheet", (F.col("doc_id") % 10 + 1).alias("position"), held(n).alias("sha1"))
    stored = t.filter("doc_id % 10 < 4").select("sheet", (F.col("doc_id") % 10).alias("position"), F.concat(F.lit("old-"), F.col("doc_id").cast("string")).alias("name"), held(n + F.col("doc_id")).alias("sha1"))
    return content.place_pages(pages, stored, sheet="sheet", position="position", sha1="sha1", name="name"), stored


@query(f"with {_PAGES} select sheet, position, sha1, name, reused from r")
def page_reuse(spark, d):
    return _pages(spark, d)[0]


@query(f"with {_PAGES} select distinct sheet, name from s where sheet in (select sheet from r) and not exists (select 1 from r where r.sheet=s.sheet and r.name=s.name)")
def stale_pages(spark, d):
    placed, stored = _pages(spark, d)
    return content.stale_pages(placed, stored, sheet="sheet", name="name")


_READERS = """c as (select conv_id, turn, string_split(coalesce(text,''),' ') as ws from conversations),
a as (select conv_id, turn, list_transform(ws, lambda w: case when length(w)=7 then w||'?' else w end) as ws from c),
b as (select conv_id, turn, list_transform(ws, lambda w: case when length(w)=6 then w||'?' when conv_id%4=0 and turn=1 then w||'.' else w end) as ws from c where conv_id%3<>0 or turn%5<>3)"""
_PLAIN = "list_sort(list_transform({0}, lambda w: regexp_replace(w,'\\?$','')))"


def _readers(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.split(F.coalesce("text", F.lit("")), " ").alias("ws"))
    marked = lambda n, other: F.transform("ws", lambda w: F.when(F.length(w) == n, F.concat(w, F.lit("?"))).otherwise(other(w)))
    off = (F.col("conv_id") % 4 == 0) & (F.col("turn") == 1)
    a = c.withColumn("ws", marked(7, lambda w: w))
    b = c.filter("conv_id % 3 <> 0 OR turn % 5 <> 3").withColumn("ws", marked(6, lambda w: F.when(off, F.concat(w, F.lit("."))).otherwise(w)))
    return a, b


@query(f"""with {_READERS}
select conv_id, count(*) as events, count(*) filter(coalesce({_PLAIN.format('a.ws')}={_PLAIN.format('b.ws')},false)) as agreed
from a full join b using(conv_id, turn) group by conv_id""")
def reader_agreement(spark, d):
    a, b = _readers(spark, d)
    pairs = a.join(b.withColumnRenamed("ws", "other"), ["conv_id", "turn"], "full")
    return settling.agreement(pairs, "conv_id", "ws", "other")


@query(f"""with {_READERS},
k as (select conv_id from a full join b using(conv_id, turn) group by conv_id having bool_and(coalesce({_PLAIN.format('a.ws')}={_PLAIN.format('b.ws')},false))),
m as (select distinct conv_id, left(w,length(w)-1) as t from (select conv_id, unnest(ws) as w from b) where w like '%?'),
l as (select conv_id, list(t) as ts from m group by conv_id)
select a.conv_id, a.turn, array_to_string(list_transform(a.ws, lambda w: case when list_contains(coalesce(l.ts,[]),w) then w||'?' else w end),' ') as final
from a join k using(conv_id) left join l using(conv_id)""")
def promoted_truth(spark, d):
    a, b = _readers(spark, d)
    done = settling.promote(a, b, page="conv_id", order="turn", tokens="ws")
    return done.select("conv_id", "turn", F.array_join("ws", " ").alias("final"))


@query("""
with s as (select user_id, event_id, floor(value) as x0, floor(value)+event_id%40 as x1 from events where value is not null),
w as (select *, greatest(1.0,x1-x0) as w, row_number() over(partition by user_id order by event_id) as i, count(*) over(partition by user_id) as n,
 sum(greatest(1.0,x1-x0)) over(partition by user_id order by event_id) as upto, sum(greatest(1.0,x1-x0)) over(partition by user_id) as total from s),
q as (select user_id, event_id as ask, (event_id%11)/8.0 as f from events where event_type='click'),
j as (select q.ask, w.*, least(1.0,q.f)*w.total as place from q join w on q.user_id=w.user_id)
select user_id, ask, event_id as system, x0+least(w,place-(upto-w)) as x from j qualify row_number() over(partition by ask order by case when place<=upto or i=n then i else n+i end)=1""")
def sweep_places(spark, d):
    e = table(spark, d, "events")
    s = e.filter("value IS NOT NULL").select("user_id", "event_id", F.floor("value").cast("double").alias("x0")).withColumn("x1", F.col("x0") + F.col("event_id") % 40)
    q = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("ask"), (F.col("event_id") % 11 / 8.0).alias("f"))
    return ordered.sweep_at(s, q, key="user_id", order="event_id", x0="x0", x1="x1", share="f").drop("f")


@query("""
with g as (select user_id, event_id, floor(value) as x0, floor(value)+event_id%7 as x1, event_id%4<>0 as big, event_type in ('click','error') as letter from events where value is not null),
b as (select *, coalesce(x0-lag(x1) over(partition by user_id order by x0,event_id)-1>1.5,true) as opens from g where big),
r as (select *, count(*) filter(opens) over(partition by user_id order by x0,event_id) as run from b),
k as (select *, count(*) over(partition by user_id,run) as n, count(*) filter(letter) over(partition by user_id,run) as l from r)
select user_id, event_id from g where event_id not in (select event_id from k where n>=3 and l>=2 and l*2>=n)""")
def words_dropped(spark, d):
    e = table(spark, d, "events").filter("value IS NOT NULL").withColumn("x0", F.floor("value")).withColumn("x1", F.col("x0") + F.col("event_id") % 7)
    kept = ordered.drop_words(e, "user_id", ["x0", "event_id"], x0="x0", x1="x1", big=F.col("event_id") % 4 != 0, letter=F.col("event_type").isin("click", "error"), gap=1.5)
    return kept.select("user_id", "event_id")


@query("""
with n as (select *, lead(c) over(partition by k order by c) as nc, row_number() over(partition by k order by c)=1 as first
 from (select distinct user_id%20 as k, floor(value)+1 as c from events where event_type='purchase' and value is not null)),
p as (select user_id%20 as k, value+0.3 as f, event_id as m from events where event_type='click' and value is not null),
j as (select p.k, f, m, coalesce(a.c,b.c) as r, case when a.c is not null then a.nc else b.nc end as r1 from p asof left join n a on p.k=a.k and p.f>=a.c left join n b on p.k=b.k and b.first),
x as (select *, case when r1 is not null and f>r and r1/f<f/r then r1 else r end as best from j),
y as (select *, case when best=r then r1 else r end as other from x),
z as (select k, m, case when f between best*0.97::double and best*1.03::double then best when f between other*0.97::double and other*1.03::double then other end as c from y)
select n.k, n.c as centre, coalesce(max(m),0) as size from n left join z using(k,c) group by n.k, n.c""")
def peaks_to_centres(spark, d):
    e = table(spark, d, "events").filter("value IS NOT NULL").withColumn("k", F.col("user_id") % 20)
    c = e.filter("event_type = 'purchase'").select("k", (F.floor("value") + 1).cast("double").alias("centre")).distinct()
    p = e.filter("event_type = 'click'").select("k", (F.col("value") + 0.3).alias("f"), F.col("event_id").alias("size"))
    rows = c.withColumn("low", F.col("centre") * 0.97).withColumn("high", F.col("centre") * 1.03)
    return ordered.nearest_centre(p, rows, key="k", at="f", size="size", centre="centre", low="low", high="high")


@query("""
select e.user_id, e.event_id from events e where e.event_type<>'error' and not exists
 (select 1 from events s where s.event_type='error' and s.user_id=e.user_id and abs(s.value-e.value)<=1 and abs((s.value+s.event_id%5)-(e.value+e.event_id%5))<=1)""")
def pages_not_deleted(spark, d):
    e = table(spark, d, "events").withColumn("t0", F.col("value")).withColumn("t1", F.col("value") + F.col("event_id") % 5)
    return joins.not_stamped(e.filter("event_type <> 'error'"), e.filter("event_type = 'error'"), key="user_id", start="t0", end="t1").select("user_id", "event_id")


@query("""
with recursive e as (select user_id, event_id, event_type as m, cast(floor(epoch(ts)) as bigint) as s, row_number() over(partition by user_id order by cast(floor(epoch(ts)) as bigint), event_id) as r from events),
w as (select user_id, event_id, m, s, r, s as at, true as sent from e where r=1
 union all select e.user_id, e.event_id, e.m, e.s, e.r, case when e.m is distinct from w.m or e.s-w.at>=43200 then e.s else w.at end, e.m is distinct from w.m or e.s-w.at>=43200 from w join e on e.user_id=w.user_id and e.r=w.r+1)
select user_id, event_id, sent from w""")
def repeats_suppressed(spark, d):
    e = table(spark, d, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    return sequential.suppress_repeats(e, key="user_id", id_col="event_id", seconds="s", message="event_type", window=43200)


@query("""
with e as (select event_id, value, value-30 as x, event_id%97-10.5::double as y, user_id*3.7::double as w, event_id%50-5 as h, user_id%40+event_id%3 as fw, 60 as fh from events),
a as (select *, value is not null and fw>=2 as ok, greatest(0,least(floor(x),fw-2)) as ax, greatest(0,least(floor(y),fh-2)) as ay from e),
b as (select *, ax-ax%2 as px, ay-ay%2 as py from a),
c as (select *, greatest(2,least(floor(w),fw-px)) as cw, greatest(2,least(h,fh-py)) as ch from b)
select event_id, cast(case when ok then px else -1 end as bigint) as rx, cast(case when ok then py else -1 end as bigint) as ry,
 cast(case when ok then cw-cw%2 else -1 end as bigint) as rw, cast(case when ok then ch-ch%2 else -1 end as bigint) as rh from c""")
def even_rects(spark, d):
    e, n, u = table(spark, d, "events"), F.col("event_id"), F.col("user_id")
    r = rules.even_rect(F.col("value") - 30, n % 97 - F.lit(10.5), u * F.lit(3.7), n % 50 - 5, u % 40 + n % 3, F.lit(60))
    return e.select("event_id", r.alias("r")).select("event_id", *[F.coalesce(f"r.{c}", F.lit(-1).cast("bigint")).alias(f"r{c}") for c in "xywh"])


@query("""
with e as (select event_id, coalesce(value,0) as v, event_id%256 as th, user_id%200+1 as peak, event_id%90+10 as c, user_id*20 as height, event_id%5*360 as adv from events)
select event_id, cast(least(255, floor(th*c/greatest(peak, c*0.75::double))) as bigint) as gain,
 height>0 and (height<540 or (adv>=720 and height<adv*0.6::double)) as low,
 case when v<=greatest(2.0::double,0.002::double*greatest(th,peak,40)) then 'IDENTICAL' when v/greatest(th,peak,40)>(0.25::double+(0.08::double-0.25::double)*0.5::double) or (v/greatest(th,peak,40)>(0.06::double+(0.025::double-0.06::double)*0.5::double) and c>=50) then 'TRANSITION' else 'STABLE' end as pair,
 round(20*log10(v+1e-10),6) as db from e""")
def frame_rules(spark, d):
    n, u, v, k = F.col("event_id"), F.col("user_id"), F.coalesce("value", F.lit(0.0)), rules.knobs()
    th, peak, c = n % 256, u % 200 + 1, n % 90 + 10
    pair = rules.pair_class(v, th, peak, c, floor=40.0, ratio=k["ratio"], minor=k["minor"], cell=50)
    low = rules.low_resolution(u * 20, n % 5 * 360)
    return table(spark, d, "events").select("event_id", rules.local_gain(th, peak, c).alias("gain"), low.alias("low"), pair.alias("pair"), F.round(rules.decibels(v), 6).alias("db"))


@query("""
with p as (select l_suppkey, l_orderkey%256 as r, l_partkey%256 as g, l_linenumber*36 as b from lineitem)
select l_suppkey, floor(10000.0::double*count(*) filter(greatest(r,g,b)-least(r,g,b)>60)/count(*)+0.5)/10000 as saturated, floor(10000.0::double*count(*) filter(g<128)/count(*)+0.5)/10000 as dark from p group by l_suppkey""")
def pixel_shares(spark, d):
    p = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") % 256).alias("r"), (F.col("l_partkey") % 256).alias("g"), (F.col("l_linenumber") * 36).alias("b"))
    share = lambda c: half_up(F.count_if(c) / F.count("*"), 10000)
    return p.groupBy("l_suppkey").agg(share(rules.saturated(F.col("r"), F.col("g"), F.col("b"))).alias("saturated"), share(F.col("g") < 128).alias("dark"))


@query("""
with s as (select event_id, event_type, value, row_number() over(partition by event_type order by value)-1 as i, count(*) over(partition by event_type) as n from events where value is not null),
q as (select event_type, max(value) filter(i=floor(0.6*(n-1)+0.5)) as p60 from s group by event_type)
select event_id, coalesce(value>0 and value>=0.3::double*p60, false) as present from events left join q using(event_type)""")
def frames_present(spark, d):
    return ranks.present(table(spark, d, "events").select("event_id", "event_type", "value"), "event_type", "value").select("event_id", "present")
