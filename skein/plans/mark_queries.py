"""Lines, notes and runs of pages, and tracked levels, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.numeric import half_up
from skein.operators import marks, tracking
from skein.operators.page_scores import score_pages
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
with l as (select event_id//40 as page, (event_id%40)*10.0::double+user_id%2 as y, (event_id%4)::double as a, (100+user_id%90)::double as b from events),
w as (select page, list({'y':y,'a':a,'b':b}) over(partition by page order by y,a,b rows between current row and 6 following) as l from l),
n as (select page, l[1:n] as l, n from w, range(4,8) t(n) where len(l)>=n),
g as (select *, list_transform(range(1,n), lambda i: l[i+1].y-l[i].y) as g from n),
m as (select *, list_median(g) as d, list_median(list_transform(l, lambda p: p.a)) as a, list_median(list_transform(l, lambda p: p.b)) as b from g),
t as (select *, list_max(list_transform(g, lambda x: abs(x-d))) as far, greatest(d*0.15::double,1.01::double) as tol, b-a+1 as span from m)
select page, l[1].y as y0, l[-1].y as y1, n::int as n, d as spacing, round(1-far/tol,9) as regularity, span from t
where d>=3 and d<=60 and far<=tol and len(list_filter(l, lambda p: least(p.b,b)-greatest(p.a,a)+1>=span*0.7::double))=n""")
def even_line_groups(spark, d):
    n = F.col("event_id")
    lines = table(spark, d, "events").select(F.floor(n / 40).alias("page"), (n % 40 * F.lit(10.0) + F.col("user_id") % 2).alias("y"), (n % 4).cast("double").alias("a"), (F.col("user_id") % 90 + 100).cast("double").alias("b"))
    return marks.even_groups(lines, "page", y="y", x0="a", x1="b").withColumn("regularity", F.round("regularity", 9))


@query("""
with p as (select l_suppkey, l_linenumber as line, count(*) as n, count(*) filter(l_partkey%10<4) as hit from lineitem group by all)
select l_suppkey, count(*) as lines, round(avg(case when hit>=0.35::double*n then 1.0 else 0.0 end),9) as coverage from p group by 1""")
def line_coverages(spark, d):
    p = table(spark, d, "lineitem")
    return marks.line_coverage(p, "l_suppkey", line="l_linenumber", hit=F.col("l_partkey") % 10 < 4).withColumn("coverage", F.round("coverage", 9))


@query("""
with n as (select l_orderkey, l_linenumber, l_partkey%13 as f from lineitem),
c as (select l_orderkey, list_sort(list(f) filter(f>0)) as fs from n group by 1)
select l_orderkey, l_linenumber, f>0 and fs[-1]-fs[1]>5 and abs(f-fs[len(fs)//2+1])>5 as wide from n join c using(l_orderkey)""")
def chords_too_wide(spark, d):
    n = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 13).alias("f"))
    return marks.wide_chords(n, "l_orderkey", "f").select("l_orderkey", "l_linenumber", F.coalesce("wide", F.lit(False)).alias("wide"))


@query("""
with n as (select event_id//40 as s, event_id%40//6 as e, event_id%6 as k, event_id%40//6+case when event_id%17=0 then user_id%40/10.0::double else user_id%100/200.0::double end as x from events),
b as (select a.s, a.k from n a join n b on a.s=b.s and ((a.e<b.e and b.x<a.x-0.3::double) or (a.e>b.e and a.x<b.x-0.3::double))),
c as (select s, e from n group by all having max(x)-min(x)>0.7::double)
select distinct s as page, k from (select * from b union all select n.s, n.k from n join c on n.s=c.s and n.e=c.e)""")
def strings_to_drop(spark, d):
    n = F.col("event_id")
    e, x = F.floor(n % 40 / 6), F.when(n % 17 == 0, F.col("user_id") % 40 / F.lit(10.0)).otherwise(F.col("user_id") % 100 / F.lit(200.0))
    notes = table(spark, d, "events").select(F.floor(n / 40).alias("page"), e.alias("e"), (n % 6).alias("k"), (e + x).alias("x"))
    return marks.unsound_strings(notes, "page", event="e", string="k", at=F.col("x"))


@query("""
with n as (select user_id, event_id, 82.4::double*pow(2,(event_id%37)/12.0::double) as f, event_type<>'error' as on_ from events),
p as (select *, k::bigint as partial, k*f*sqrt(1+0.0001::double*k*k) as hz, k from n, range(1,9) t(k)),
c as (select *, log2(hz)*1200 as c from p)
select a.user_id, a.event_id, a.partial, not exists(select 1 from c b where b.user_id=a.user_id and b.on_ and b.event_id<>a.event_id and b.c>=a.c-50 and b.c<=a.c+50) as own from c a""")
def partials_of_one_note(spark, d):
    n = table(spark, d, "events").select("user_id", "event_id", (F.lit(82.4) * F.pow(F.lit(2.0), F.col("event_id") % 37 / 12.0)).alias("f"), (F.col("event_type") != "error").alias("on"))
    p = marks.partials(n, ["user_id", "event_id", "on"], hz="f", stiff=0.0001, most=8)
    return marks.own_partials(p, "user_id", note="event_id", hz="partial_hz", sounding=F.col("on")).select("user_id", "event_id", F.col("partial").cast("bigint").alias("partial"), "own")


_ROLES = {"purchase": 0, "signup": 0, "click": 1, "view": 2}


@query("""
with r as (select user_id, event_id, row_number() over(partition by user_id order by case event_type when 'purchase' then 0 when 'signup' then 0 when 'click' then 1 when 'view' then 2 else 3 end, event_id) as place from events)
select user_id, event_id, place::int as place from r where place<=24""")
def candidates_by_role(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return marks.capped_by_role(e, "user_id", role="event_type", ranks=_ROLES, order=["event_id"]).select("user_id", "event_id", "place")


@query("""
with w as (select user_id, arg_max(event_type, event_id) as last from events where value>50 group by 1)
select e.user_id, e.event_id, row_number() over(partition by e.user_id order by case when e.event_type=w.last then 0 else 1 end, e.event_id)::int as turn from events e left join w using(user_id)""")
def winner_goes_first(spark, d):
    e = table(spark, d, "events")
    last = e.filter("value > 50").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"))
    return marks.winner_first(e.join(last, "user_id", "left"), "user_id", "event_type", "event_id", F.col("last")).select("user_id", "event_id", "turn")


@query("""
with r as (select user_id, event_id*10 as s, event_id*10+event_id%6 as e, case when event_id%3=0 then event_id%4 else 0 end as g from events),
f as (select user_id, min(s) filter(g=0) as s, max(e) filter(g=0) as e from r group by 1 having count(*) filter(g=0)>0),
a as (select user_id, s as a0, e as a1 from (select *, row_number() over(partition by user_id order by e-s desc, s) as k from r where g=0) where k=1),
t as (select *, case when g=0 and s=a0 then 0 when g=0 then 1 else 2 end as tier from r join a using(user_id)),
n as (select user_id, sum(e-s+1) filter(tier=0) as n0, sum(e-s+1) filter(tier<2) as n1 from t group by 1),
c as (select user_id, count(distinct x) as n, sum(distinct x) as total from (select user_id, unnest(range(s,e+1)) as x from t join n using(user_id) where tier=0 or (tier=1 and n0<7) or (tier=2 and n0<7 and n1<7)) group by 1),
h as (select user_id, list(t order by g) as also from (select user_id, g, floor((min(s)/25.0::double+1.5)*100+0.5)/100 as t from r where g>0 group by all) group by 1)
select user_id, floor((s/25.0::double+1.5)*100+0.5)/100 as t_start, floor(((e+1)/25.0::double+1.5)*100+0.5)/100 as t_end, coalesce(len(also),0)::int as repeats, coalesce(also[1],-1) as first_repeat,
 n::int as candidates, total::bigint as total from f join c using(user_id) left join h using(user_id)""")
def page_appearances(spark, d):
    n = F.col("event_id")
    runs = table(spark, d, "events").select("user_id", (n * 10).alias("s"), (n * 10 + n % 6).alias("e"), F.when(n % 3 == 0, n % 4).otherwise(0).alias("g"))
    p = marks.appearances(runs, "user_id", group="g", start="s", end="e", fps=25.0, offset=1.5)
    return p.select("user_id", "t_start", "t_end", F.size("also_at").alias("repeats"), F.coalesce(F.get("also_at", F.lit(0)), F.lit(-1.0)).alias("first_repeat"), F.size("candidates").alias("candidates"),
                    F.aggregate("candidates", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("""
with recursive e as (select user_id as p, row_number() over(partition by user_id order by event_id) as i, event_id as n, event_id%5 as side, user_id%2 as f from events),
s as (select * from e, range(1,4) t(s)),
t as (select p,i,s, s*1000+f+1 as k, (n+s)%3=0 as h, n%13=0 and s=2 as u from s where side<>3 and case when side=4 then s=1+n%3 else (n//5+s*n)%3<>0 end),
r as (select p,i,s, s*1000+case when n%11=0 then 5 when n%7=0 then 3-s else f end+1 as k, (n+s)%4=0 as h from s where side<>4 and case when side=3 then s=1+n%3 else (n//7+s*n)%4<>0 end),
ts as (select * from t where not u),
rs as (select * from r where not exists(select 1 from t where t.u and t.p=r.p and t.i=r.i and t.s=r.s)),
v as (select p, i, side, coalesce(tk,[]) as tk, coalesce(rk,[]) as rk from e left join (select p,i,list(k) as tk from ts group by all) using(p,i) left join (select p,i,list(k) as rk from rs group by all) using(p,i)),
w as (select *, list_filter(tk, lambda x: not list_contains(rk,x)) as lost, list_filter(rk, lambda x: not list_contains(tk,x)) as fals, case side when 3 then rk when 4 then tk else [] end as al from v),
z as (select *, coalesce(len(al)>0 and lag(side) over o<3 and list_has_all(case side when 3 then lag(lost) over o else lag(fals) over o end, al),false) as bk,
 coalesce(len(al)>0 and lead(side) over o<3 and list_has_all(case side when 3 then lead(lost) over o else lead(fals) over o end, al),false) as nx,
 coalesce(lag(side,2) over o=side and list_has_any(al, lag(al,2) over o),false) as ag from w window o as (partition by p order by i)),
c as (select p, i, case when bk then -1 when nx then 1 else 0 end as one, 0 as two from z where i=1
 union all select z.p, z.i, case when bk and not(ag and c.two=1) then -1 when nx then 1 else 0 end, c.one from c join z on z.p=c.p and z.i=c.i+1),
y as (select z.*, one as ch from z join c using(p,i)),
g as (select p, i+ch as i, side, unnest(al) as k from y where ch<>0),
lo as (select p,i,k,k//1000 as s,k%1000 as f from (select p,i,unnest(lost) as k from y where side<3) a where not exists(select 1 from g where side=3 and g.p=a.p and g.i=a.i and g.k=a.k)),
fa as (select p,i,k,k//1000 as s,k%1000 as f from (select p,i,unnest(fals) as k from y where side<3) a where not exists(select 1 from g where side=4 and g.p=a.p and g.i=a.i and g.k=a.k)),
b as (select p,i,s from lo join fa using(p,i,s)),
m as (select p, sum(least(x,y)) as n from (select p,i,f,count(*) as x from lo anti join b using(p,i,s) group by all) join (select p,i,f,count(*) as y from fa anti join b using(p,i,s) group by all) using(p,i,f) group by 1),
k as (select p, count(*) as tp, count(*) filter(ts.h) as tt, count(*) filter(rs.h) as tr, count(*) filter(ts.h and rs.h) as th from ts join rs using(p,i,k) group by 1),
a as (select p, sum(len(al)) filter(ch<>0 and side=3) as sp, sum(len(al)) filter(ch<>0 and side=4) as me, sum(len(al)) filter(ch=0 and side=3) as ex, sum(len(al)) filter(ch=0 and side=4) as mi,
 count(*) filter(len(tk)>=2) as cn from y group by 1),
x as (select p, count(*) as n from (select p,i from ts group by all having count(*)>=2) join (select p,i,list_sort(list(s)) as l from t group by all) using(p,i) join (select p,i,list_sort(list(s)) as l from r group by all) using(p,i,l) group by 1),
o as (select a.p, coalesce(tp,0) as tp, coalesce(sp,0) as split, coalesce(me,0) as merged, coalesce(wf,0) as wrong_fret, coalesce(m.n,0) as wrong_string,
 coalesce(mi,0)+coalesce(ln,0)-coalesce(wf,0)-coalesce(m.n,0) as missed, coalesce(ex,0)+coalesce(fn,0)-coalesce(wf,0)-coalesce(m.n,0) as extra, coalesce(tt,0) as tt, coalesce(tr,0) as tr, coalesce(th,0) as th, cn, coalesce(x.n,0) as cx
 from a left join k using(p) left join m using(p) left join x using(p) left join (select p,count(*) as wf from b group by 1) using(p) left join (select p,count(*) as ln from lo group by 1) using(p) left join (select p,count(*) as fn from fa group by 1) using(p))
select p as user_id, tp, (extra+split+merged+wrong_fret+wrong_string)::bigint as fp, (missed+split+merged+wrong_fret+wrong_string)::bigint as fn, split::bigint as split, merged::bigint as merged, wrong_fret, wrong_string::bigint as wrong_string,
 missed::bigint as missed, extra::bigint as extra, tt as tech_truth, tr as tech_read, th as tech_hit, cn as chords, cx as chords_exact from o""")
def page_scores(spark, d):
    n, u, side = F.col("event_id"), F.col("user_id"), F.col("event_id") % 5
    h = lambda c: F.when(c, F.array(F.lit("h"))).otherwise(F.array(F.lit("x")))

    def notes(alone, some, fret, every, unsure=None):
        kept = F.filter(F.array(*map(F.lit, (1, 2, 3))), lambda s: F.when(side == alone, s == 1 + n % 3).otherwise(some(s) != 0))
        more = (lambda s: [unsure(s).alias("unsure")]) if unsure else lambda s: []
        return F.transform(kept, lambda s: F.struct(s.alias("string"), fret(s).cast("int").alias("fret"), h((n + s) % every == 0).alias("tech"), *more(s)))

    truth = notes(4, lambda s: (F.floor(n / 5) + s * n) % 3, lambda s: u % 2, 3, lambda s: (n % 13 == 0) & (s == 2))
    read = notes(3, lambda s: (F.floor(n / 7) + s * n) % 4, lambda s: F.when(n % 11 == 0, 5).when(n % 7 == 0, 3 - s).otherwise(u % 2), 4)
    pairs = table(spark, d, "events").select("user_id", "event_id", F.when(side != 4, read).alias("read"), F.when(side != 3, truth).alias("truth"))
    return score_pages(pairs, "user_id", "event_id")


@query("""
with recursive e as (select user_id, event_id, value, row_number() over(partition by user_id order by event_id)-1 as i from events where value is not null),
y as (select user_id, event_id, i, value as y from e where i=0 union all select e.user_id, e.event_id, e.i, 0.9::double*y.y+(1-0.9::double)*e.value from y join e on e.user_id=y.user_id and e.i=y.i+1),
p as (select *, i//5 as b, case when (i+1)%5=0 then i//5-2 else i//5-3 end as since from y),
m as (select a.user_id, a.event_id, a.i, 1.7::double*min(c.y) as raw from p a join p c on c.user_id=a.user_id and c.i<=a.i and c.b>=a.since group by all),
f as (select user_id, event_id, i, raw as floor from m where i=0
 union all select m.user_id, m.event_id, m.i, case when m.i<8 then m.raw else least(m.raw, f.floor*1.02::double) end from f join m on m.user_id=f.user_id and m.i=f.i+1)
select user_id, event_id, floor(floor*1000000+0.5)/1000000 as floor from f""")
def noise_floors(spark, d):
    f = tracking.noise_floor(table(spark, d, "events"), key="user_id", order="event_id", value="value", parts=3, part=5, warm=8, rise=1.02)
    return f.withColumn("floor", half_up(F.col("floor"), 1000000))


@query("""
with recursive v as (select user_id, event_id, value-20 as v from events where abs(value-20)<=35),
e as (select *, row_number() over(partition by user_id order by event_id) as i from v),
t as (select user_id, event_id, i, greatest(-9,least(9,0.1::double*v)) as c, abs(greatest(-9,least(9,0.1::double*v)))>1 as told, case when abs(greatest(-9,least(9,0.1::double*v)))>1 then greatest(-9,least(9,0.1::double*v)) else 0 end as prior from e where i=1
 union all select user_id, event_id, i, c, abs(c-prior)>1, case when abs(c-prior)>1 then c else prior end from (select e.user_id, e.event_id, e.i, greatest(-9,least(9,t.c+0.1::double*(e.v-t.c))) as c, t.prior from t join e on e.user_id=t.user_id and e.i=t.i+1))
select user_id, event_id, floor(c*1000000+0.5)/1000000 as cents, told from t""")
def tuning_drifts(spark, d):
    e = table(spark, d, "events").withColumn("off", F.col("value") - 20)
    return tracking.drift(e, key="user_id", order="event_id", value="off", most=9.0, step=1.0).withColumn("cents", half_up(F.col("cents"), 1000000))
