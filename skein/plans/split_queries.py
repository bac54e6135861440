"""Queries that work in rounds or over slices of a long key, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skein.functions import records
from skein.operators import blobs, filters, greedy, intervals, splits
from skein.operators.ordered import positions
from skein.sources.tables import table
from skein.streaming import commits

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _signed(spark, d):
    """Events of a user as frames, with a small signature."""
    e = positions(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"], "f")
    kind = F.when(F.col("event_type") == "click", 20).when(F.col("event_type") == "view", 10).otherwise(0)
    return e.select("user_id", "f", F.array(F.floor("value").cast("double"), kind.cast("double"), F.hour("ts").cast("double")).alias("sig"))


@query("""
with recursive f as materialized (select user_id, row_number() over(partition by user_id order by ts,event_id)-1 as f, floor(value)::bigint as a,
    case event_type when 'click' then 20 when 'view' then 10 else 0 end as b, extract(hour from ts)::bigint as c from events),
dist as materialized (select x.user_id, x.f, y.f-x.f as l, (abs(x.a-y.a)+abs(x.b-y.b)+abs(x.c-y.c))/greatest(x.a+x.b+x.c, y.a+y.b+y.c, 60.0)::double as d
    from f x join f y on x.user_id=y.user_id and y.f between x.f+3 and x.f+8),
seg as (
    select user_id, min(f) as lo, max(f) as hi, false as done from f group by user_id
    union all
    select * from (
        with best as (select s.user_id, s.lo, s.hi, any_value(x.l) as l, max(x.d) as d, arg_min(x.f, struct_pack(d := -x.d, f := x.f)) as f
            from seg s left join dist x on x.user_id=s.user_id and x.l=least(8, (s.hi-s.lo+1)//3) and x.f>=s.lo and x.f+x.l<=s.hi
            where not s.done group by s.user_id, s.lo, s.hi),
        cut as (select *, case when d > 0.9 then f + (l+1)//2 end as c0 from best),
        ok as (select *, case when c0-lo>=4 and hi-c0+1>=4 then c0 end as c from cut)
        select user_id, lo, coalesce(c-1, hi), c is null from ok
        union all select user_id, c, hi, false from ok where c is not null))
select user_id, lo as start_f, hi as end_f, hi-lo+1 as n_frames from seg where done""")
def refined_runs(spark, d):
    """Every user's events, one run at first, split at their clearest changes."""
    frames = _signed(spark, d)
    runs = frames.groupBy("user_id").agg(F.min("f").alias("start_f"), F.max("f").alias("end_f"))
    return splits.refine_runs(frames, runs, key="user_id", frame="f", sig="sig", change=0.9, floor=60.0)


_B, _A = (x.tolist() for x in filters.high_pass(0.1, 1.0))
#: Taps for every fourth sample, as in the listener at 48 kHz.
_TAPS = filters.low_pass_taps(0.09, 0.16, 1.0)


@query(f"""
with recursive h as (select 0 as n, {_B[0]!r}::double as h, 0::double as p
    union all select n+1, (case n when 0 then {_B[1]!r} when 1 then {_B[2]!r} else 0 end) - ({_A[1]!r})*h - ({_A[2]!r})*p, h from h where n < 90)
select e.event_id, round(sum(x.value*h.h)*10000)::bigint as y
from events e cross join h join events x on x.event_id = e.event_id - h.n group by e.event_id""")
def one_signal_high_pass(spark, d):
    """All events as one signal, which one key holds."""
    e = table(spark, d, "events").select("event_id", "value").withColumn("signal", F.lit(0))
    y = filters.recursive_filter(e, "signal", "event_id", "value", _B, _A, name="y")
    return y.select("event_id", F.round(F.col("y") * 10000).cast("long").alias("y"))


@query(f"""
with f as (select event_id, user_id, value, row_number() over(partition by user_id order by ts,event_id)-1 as t from events),
h as (select unnest({_TAPS.tolist()!r}) as h, unnest(range({len(_TAPS)})) as n)
select e.event_id, round(sum(x.value*h.h)*10000)::bigint as y
from f e cross join h join f x on x.user_id=e.user_id and x.t = e.t - h.n where e.t%4=3 group by e.event_id""")
def low_pass_every_fourth(spark, d):
    """Every fourth event of a user, smoothed over those before it."""
    e = positions(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"])
    y = filters.tap_filter(e.drop("ts"), "user_id", "t", "value", _TAPS, step=4, name="y")
    return y.select("event_id", F.round(F.col("y") * 10000).cast("long").alias("y"))


@query("""
with recursive r as materialized (select l_suppkey as page, l_orderkey//20 as y, l_partkey%100 as x0, l_partkey%100+l_quantity::bigint as x1,
    row_number() over(partition by l_suppkey order by l_orderkey//20, l_partkey%100, l_partkey%100+l_quantity::bigint) as rn from lineitem),
g as (select page, rn, y, x0, x1, 0 as line, x0 as a0, x1 as a1 from r where rn=1
    union all
    select r.page, r.rn, r.y, r.x0, r.x1, case when ok then g.line else g.line+1 end, case when ok then g.a0 else r.x0 end, case when ok then g.a1 else r.x1 end
    from (select g.*, r.y as ny, r.x0 as n0, r.x1 as n1, (r.y-g.y<=2 and r.x0<=g.a1 and r.x1>=g.a0) as ok from g join r on r.page=g.page and r.rn=g.rn+1) g
    join r on r.page=g.page and r.rn=g.rn+1)
select page, line::bigint as line, round(sum(y*(x1-x0+1))/sum(x1-x0+1)*1000)::bigint as y_thousandths, arg_min(x0, (x0-x1)*1000000+rn) as x0, max(x1-x0+1)::bigint as len, count(*) as n_rows from g group by page, line""")
def merged_lines(spark, d):
    """A supplier's parts as rows of ink, merged to lines."""
    li = table(spark, d, "lineitem")
    x0 = F.col("l_partkey") % 100
    rows = li.select(F.col("l_suppkey").alias("page"), F.floor(F.col("l_orderkey") / 20).alias("y"), x0.alias("x0"), (x0 + F.col("l_quantity").cast("long")).alias("x1"))
    return greedy.merge_lines(rows, "page").select("page", "line", F.round(F.col("y") * 1000).cast("long").alias("y_thousandths"), "x0", "len", "n_rows")


@query("""
with recursive r as materialized (select user_id, event_id, value as ink, 1 + event_id%7 as n, row_number() over(partition by user_id order by ts,event_id)-1 as t from events),
g as (select user_id, t, event_id, 0 as screen, ink as a, n as an from r where t=0
    union all
    select user_id, t, event_id, case when ok then screen else screen+1 end, case when ok and an>=n then a else ink end, case when ok and an>=n then an else n end
    from (select r.user_id, r.t, r.event_id, r.ink, r.n, g.screen, g.a, g.an, abs(g.a-r.ink)<=0.7*greatest(g.a,r.ink) as ok from g join r on r.user_id=g.user_id and r.t=g.t+1))
select event_id, user_id, screen::bigint as screen from g""")
def merged_screens(spark, d):
    """A user's events as runs of different lengths; runs like the longest before them are one screen."""
    runs = positions(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), "user_id", ["ts", "event_id"]).withColumn("n", 1 + F.col("event_id") % 7)
    done = greedy.merge_screens(runs, "user_id", "t", "n", ["value"], lambda a, b: abs(a[0] - b[0]) <= 0.7 * max(a[0], b[0]))
    return done.select("event_id", "user_id", "screen")


def _pages(spark, d):
    """Errors as pages that hold a user's frames for a while, a few of them very long."""
    e = table(spark, d, "events").filter("event_type = 'error'")
    return e.select("user_id", F.col("event_id").alias("page"), F.col("event_id").alias("lo"), (F.col("event_id") + F.floor(F.col("value") * 12)).alias("hi"))


@query("""
select e.user_id, e.event_id, p.event_id as page from events e join events p
on p.user_id=e.user_id and p.event_type='error' and e.event_id between p.event_id and p.event_id+floor(p.value*12)""")
def frames_within_pages(spark, d):
    frames = table(spark, d, "events").select("user_id", "event_id")
    return intervals.within(frames, _pages(spark, d), key="user_id", at="event_id", lo="lo", hi="hi").select("user_id", "event_id", "page")


@query("""
with f as (select user_id, value, row_number() over(partition by user_id order by ts,event_id)-1 as frame from events),
p as (select user_id, frame as lo, least(frame+(floor(value)::bigint%40), (select max(frame) from f g where g.user_id=f.user_id)) as hi from f where frame%5=0),
q as (select *, hi-lo+1 as n, least(hi-lo+1, 11) as k from p),
w as (select user_id, lo, hi, lo + ((i*(n-1) + (k-1)//2) // greatest(k-1,1)) as frame from (select *, unnest(range(k)) as i from q))
select w.user_id, w.lo, w.hi, count(*) as n_samples, max(value) as most, min(value) as least from w join f on w.user_id=f.user_id and w.frame=f.frame group by w.user_id, w.lo, w.hi""")
def page_samples(spark, d):
    """Overlapping pages of a user, each with at most eleven sample frames, from one scan of all frames."""
    frames = positions(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "frame").select("user_id", F.col("frame").cast("long").alias("frame"), "value")
    last = frames.groupBy("user_id").agg(F.max("frame").alias("last"))
    pages = frames.filter("frame % 5 = 0").join(last, "user_id").select("user_id", F.col("frame").alias("lo"), F.least(F.col("frame") + F.floor("value") % 40, "last").alias("hi"))
    plan = intervals.sample_frames(pages)
    return intervals.frames_for_pages(frames, plan, key="user_id", frame="frame", page=["lo", "hi"], most=F.max("value"), least=F.min("value"))


def _pixels(spark, d):
    """A supplier's order lines as ink."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image"), (F.col("l_orderkey") % 60).alias("y"), (F.col("l_partkey") % 80).alias("x"), "l_returnflag")


_PARTS = """
with recursive px as materialized (select distinct l_suppkey as image, l_orderkey%60 as y, l_partkey%80 as x from lineitem),
reach as (select image, y, x, y as ry, x as rx from px
    union select r.image, r.y, r.x, p.y, p.x from reach r join px p on p.image=r.image and abs(p.y-r.ry)<=1 and abs(p.x-r.rx)<=1),
root as (select image, y, x, min(ry*1000+rx) as r from reach group by image, y, x),
box as (select image, r, count(*) as area, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from root group by image, r)
"""


@query(_PARTS + "select image, r//1000 as root_y, r%1000 as root_x, area, x0, y0, x1, y1 from box")
def ink_parts(spark, d):
    """Area and box of each connected part."""
    found = blobs.part_boxes(blobs.parts(blobs.pixel_runs(_pixels(spark, d))))
    return found.select("image", F.col("root.y").alias("root_y"), F.col("root.x0").alias("root_x"), "area", "x0", "y0", "x1", "y1")


@query(_PARTS + "select p.image, p.y, p.x from root p join box b on p.image=b.image and p.r=b.r where not ((b.x1-b.x0+1>=5.0 and b.y1-b.y0+1>=3.0) or b.area>=24.0)")
def ink_of_glyphs(spark, d):
    """Ink without parts that are too large for a glyph of two pixels."""
    kept = blobs.glyphs_only(blobs.pixel_runs(_pixels(spark, d)), 2.0)
    return kept.select("image", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


@query("""
with px as (select distinct l_suppkey as image, l_orderkey%60 as y, l_partkey%80 as x, l_returnflag as f from lineitem),
ex as (select distinct image, y, x from px where f='N' and y%4=0),
own as (select * from px where f in ('A','R') and not exists (select 1 from ex where ex.image=px.image and ex.y=px.y and ex.x=px.x)),
p as (select image, y, x, bool_or(f='A') as a, bool_or(f='R') as b from own group by image, y, x),
q as (select *, (a and not exists (select 1 from p r where r.b and r.image=p.image and abs(r.y-p.y)<=1 and abs(r.x-p.x)<=1))
    or (b and not exists (select 1 from p r where r.a and r.image=p.image and abs(r.y-p.y)<=1 and abs(r.x-p.x)<=1)) as odd from p),
bins as (select image, x//8 as bin, count(*) filter (odd) as odd, count(*) as ink, count(*) filter (a) as ia, count(*) filter (b) as ib from q group by image, x//8),
lagged as (select *, max(case when odd>=9 then bin end) over(partition by image order by bin rows between unbounded preceding and 1 preceding) as before from bins)
select image, sum(odd)::bigint as changed, sum(ia)::bigint as ink_a, sum(ib)::bigint as ink_b, count(*) filter (ink>=20) as bins_content,
    count(*) filter (odd>=9) as bins_changed, count(*) filter (odd>=9 and (before is null or bin-before>2)) as clusters from lagged group by image""")
def ink_differences(spark, d):
    """Returned against accepted lines of a supplier, without a grid of others."""
    px = _pixels(spark, d)
    return blobs.ink_difference(px.filter("l_returnflag = 'A'"), px.filter("l_returnflag = 'R'"), px.filter("l_returnflag = 'N' AND y % 4 = 0"), least_ink=20, least_changed=9)


@query("""
with recursive j as materialized (select user_id, event_id, epoch_us(ts)//1000000 as s, epoch_us(ts)//1000000 + floor(value*600)::bigint as e, row_number() over(partition by user_id order by epoch_us(ts)//1000000, event_id) as rn from events),
g as (select user_id, rn, event_id, true as admitted, e as a, 0::bigint as b from j where rn=1
    union all
    select j.user_id, j.rn, j.event_id, least(g.a,g.b)<=j.s, case when least(g.a,g.b)<=j.s and g.a<=g.b then j.e else g.a end, case when least(g.a,g.b)<=j.s and g.a>g.b then j.e else g.b end
    from g join j on j.user_id=g.user_id and j.rn=g.rn+1)
select event_id, user_id, admitted from g""")
def jobs_admitted(spark, d):
    """A user's events as heavy jobs of which two may run at once."""
    jobs = table(spark, d, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), "value").withColumn("e", F.col("s") + F.floor(F.col("value") * 600))
    return greedy.admitted(jobs, "user_id", "s", "e", slots=2, ties=("event_id",), size=30 * 86400).select("event_id", "user_id", "admitted")


@query("""
select o.user_id, o.event_id as onset, e.event_id as armed from events o join events e
on o.user_id=e.user_id and o.event_type='click' and e.event_type='view' and o.ts >= e.ts - interval 30 minute and o.ts <= e.ts + interval 8 hour""")
def onsets_met(spark, d):
    """Clicks as onsets of views, some of them a little early."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    onsets = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("onset"), F.col("ts").alias("heard"))
    armed = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("armed"), F.col("ts").alias("armed_at"))
    return commits.onsets_of_events(onsets, armed, key="user_id", onset_at="heard", armed_at="armed_at", early="30 minutes", late="8 hours").select("user_id", "onset", "armed")


@query("""
select event_id as page, user_id, (row_number() over(order by ts, event_id)-1)//5 as commit from events where event_type='error'""")
def pages_committed(spark, d):
    """Errors as pages of a stream, committed five at a time and read back by the ledger."""
    from skein.sources.stages import shared_folder

    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    folder = f"{shared_folder(spark)}/commits-{uuid.uuid4().hex}"
    pages = spark.readStream.schema(schema).parquet(f"{path}*").filter("event_type = 'error'").select(F.col("event_id").alias("page"), "user_id", "ts")
    run = commits.committing(pages, folder, ["ts", "page"]).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return commits.committed(spark, folder, "page bigint, user_id bigint, ts timestamp").select("page", "user_id", "commit")


@query("""
with e as (select user_id, event_type, event_id%10 as s, floor(value*10+0.5) as x, (event_id%80-40)*100.0 as t from events where event_type<>'error'),
ok as (select *, s<8 and abs(t)<=3600 as good from e)
select user_id, sha1(event_type) as page, count(*)::double as at, count(*) filter (good) as n_events, coalesce(sum(x) filter (good),0)::bigint as x_tenths from ok group by user_id, event_type""")
def timings_cleaned(spark, d):
    """A user's events as a stored JSON record, a page for each type, read back without trust."""
    e = table(spark, d, "events")
    t = (F.col("event_id") % 80 - 40) * 100.0
    row = F.array((F.col("event_id") % 10).cast("double"), F.col("value"), t)
    pages = e.groupBy("user_id", "event_type").agg(F.count("*").alias("at"), F.collect_list(row).alias("events"))
    key = F.when(F.col("event_type") == "error", "not a hash").otherwise(F.sha1(F.col("event_type").cast("binary")))
    stored_ = pages.groupBy("user_id").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(key, F.struct("at", "events")))).alias("pages"))).alias("json"))
    clean = stored_.select("user_id", F.explode(records.clean_timing(F.col("json"))).alias("page", "p"))
    tenths = F.aggregate("p.events", F.lit(0).cast("long"), lambda s, x: s + F.round(x["x"] * 10).cast("long"))
    return clean.select("user_id", "page", F.col("p.at").alias("at"), F.size("p.events").cast("long").alias("n_events"), tenths.alias("x_tenths"))
