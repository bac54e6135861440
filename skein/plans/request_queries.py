"""Rules of requests, releases and names, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import requests as rules
from skein.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Made headers, written alike for both engines.
_HOST = "case event_id%4 when 0 then 'localhost:5173' when 1 then 'LOCALHOST:5173' when 2 then 'evil.example' end"
_SITE = "case event_id%5 when 0 then 'same-origin' when 1 then 'none' when 2 then '' when 3 then 'cross-site' end"
_ORIGIN = "case user_id%6 when 0 then 'http://localhost:5173/a' when 1 then 'http://Localhost:5173' when 2 then 'null' when 3 then 'https://evil.example' when 4 then '' end"
_METHOD = "case when event_id%2=0 then 'POST' else 'GET' end"
_KIND = "case user_id%3 when 0 then ' Application/JSON; charset=utf-8' when 1 then 'text/plain' end"


@query(f"""
with e as (select event_id, coalesce(lower({_HOST}),'') as h, coalesce({_SITE},'') as s, coalesce({_ORIGIN},'') as o, {_METHOD} as m, coalesce(lower({_KIND}),'') as k from events)
select event_id, case when h<>'localhost:5173' then '403 host' when s not in ('','same-origin','none') then '403 site'
 when o<>'' and o not like '%://%' then '403 bad origin' when o<>'' and lower(string_split(string_split(o,'://')[2],'/')[1])<>'localhost:5173' then '403 origin'
 when m='POST' and trim(string_split(k,';')[1])<>'application/json' then '415 type' else 'ok' end as answer from e""")
def request_refusals(spark, d):
    no = rules.refusal(*[F.expr(x) for x in (_HOST, _SITE, _ORIGIN, _METHOD, _KIND)], allowed=["localhost:5173"])
    return table(spark, d, "events").select("event_id", F.coalesce(no, F.lit("ok")).alias("answer"))


@query("""
select event_id, cast(case when event_id%3=0 and user_id%5<>event_id%5 and event_id%17<10 then greatest(5, 10-event_id%17)
 when user_id%7<>0 and user_id%7<>user_id%5 and event_id%1000<900 then greatest(30, 900-event_id%1000) else -1 end as bigint) as wait from events""")
def takeover_waits(spark, d):
    e, n, u = table(spark, d, "events"), F.col("event_id"), F.col("user_id")
    wait = rules.takeover_wait(u % 5, F.when(n % 3 == 0, n % 5), 5000 - n % 17, F.when(u % 7 != 0, u % 7), 5000 - n % 1000, F.lit(5000))
    return e.select("event_id", F.coalesce(wait, F.lit(-1).cast("bigint")).alias("wait"))


@query("""
with p as (select *, case p_partkey%3 when 0 then ' “a”' when 1 then ' – 日b' else '' end as tail from part)
select p_partkey, 'attachment; filename="'||regexp_replace(p_name||tail||'.pdf','[^ -~]','_','g')||'"; filename*=UTF-8''''' ||
 replace(replace(replace(replace(replace(url_encode(p_name||tail||'.pdf'),'%21','!'),'%27',''''),'%28','('),'%29',')'),'%2A','*') as header,
 trim(p_name||case p_partkey%3 when 0 then ' "a"' when 1 then ' - b' else '' end) as plain,
 array_to_string(string_split(list_reduce(string_split(p_name||' '||p_brand||' '||p_type||' '||p_name,' '), lambda a, w:
  case when length(regexp_extract(a,'[^\n]*$'))+1+length(w)<=14 then a||' '||w else a||chr(10)||w end),chr(10))[1:3],'/') as lines from p""")
def names_for_files(spark, d):
    p = table(spark, d, "part")
    name = F.concat("p_name", F.expr("case p_partkey%3 when 0 then ' “a”' when 1 then ' – 日b' else '' end"))
    lines = rules.wrapped(F.concat_ws(" ", "p_name", "p_brand", "p_type", "p_name"), 14)
    return p.select("p_partkey", rules.disposition(F.concat(name, F.lit(".pdf"))).alias("header"), rules.latin(name).alias("plain"), F.array_join(lines, "/").alias("lines"))


@query("""
with o as (select p_partkey, p_partkey%3 as k, 'App-1.'||p_size as base, md5(p_name) as m from part)
select p_partkey, case when k=0 then base||'-arm64.dmg' else 'none' end as mac, case when k=1 then base||'-x64.exe' else 'none' end as win,
 case when k=2 then base||'_amd64.deb' else 'none' end as deb, case when k<>2 then 'sha256:'||m||m else 'none' end as digest,
 case when k=0 then 'https://ok.example/'||p_partkey else 'https://ok.example/all' end as link from o""")
def release_assets(spark, d):
    p, k, base = table(spark, d, "part"), F.col("p_partkey") % 3, F.concat(F.lit("App-1."), F.col("p_size").cast("string"))
    ends = F.when(k == 0, F.array(F.lit(".blockmap"), F.lit("-arm64.dmg"))).when(k == 1, F.array(F.lit("-arm64.dmg.zip"), F.lit("-x64.exe"))).otherwise(F.array(F.lit("_arm64.deb"), F.lit("_amd64.deb")))
    names = F.transform(ends, lambda x: F.concat(base, x))
    md5 = F.md5("p_name")
    digest = rules.sha256_digest(F.concat(F.lit("sha256:"), F.upper(md5), F.when(k != 2, md5).otherwise("")))
    url = F.concat(F.when(k == 0, "https://ok.example/").otherwise("http://ok.example/"), F.col("p_partkey").cast("string"))
    none = lambda c: F.coalesce(c, F.lit("none"))
    return p.select("p_partkey", none(rules.pick_asset(names, "darwin", True)).alias("mac"), none(rules.pick_asset(names, "win32", True)).alias("win"),
                    none(rules.pick_asset(names, "linux")).alias("deb"), none(digest).alias("digest"), rules.link_or(url, "https://ok.example/", "https://ok.example/all").alias("link"))


@query("""
select p_partkey, p_brand||':'||case when p_partkey<1000 then right('000'||p_partkey,4) else p_partkey::varchar end as page,
 p_partkey%2=0 as id_ok, p_partkey%3=0 as hash_ok, p_partkey%4=0 as file_ok,
 case p_partkey%3 when 0 then '- '||p_name||chr(10)||'- more' when 1 then 'none' else p_type end as section,
 'Get '||p_name||case when p_partkey%2=0 then ' at '||p_size else ' at {{size}}' end||'.' as filled from part""")
def ids_and_templates(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    made = F.when(k % 2 == 0, "ab12-0f").otherwise("ab_12")
    sha = F.when(k % 3 == 0, F.sha1("p_name")).otherwise(F.upper(F.sha1("p_name")))
    file = F.when(k % 4 == 0, "page-003-00ab12cd-original.png").otherwise("page-3.png")
    log = F.when(k % 3 == 0, F.concat(F.lit("# Log\r\n## 2.0\r\n\r\n- "), "p_name", F.lit("\r\n- more\r\n\r\n## 1.0\r\nold"))).when(k % 3 == 1, "## 1.0\nold\n## 2.0\n\n").otherwise(F.concat(F.lit("## 2.0\n"), "p_type"))
    values = F.when(k % 2 == 0, F.create_map(F.lit("name"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string"))).otherwise(F.create_map(F.lit("name"), F.col("p_name")))
    return p.select("p_partkey", rules.page_key(F.col("p_brand"), k).alias("page"), made.rlike(rules.ID).alias("id_ok"), sha.rlike(rules.HASH).alias("hash_ok"), file.rlike(rules.PAGE).alias("file_ok"),
                    F.coalesce(rules.section_of(log, F.lit("2.0")), F.lit("none")).alias("section"), rules.fill(F.lit("Get {{name}} at {{size}}."), values).alias("filled"))


@query("""
select event_id, case event_id%7 when 0 then 'denied' when 1 then 'denied' when 2 then 'nodevice' when 3 then 'busy' else 'failed' end as error,
 concat_ws(',', case when user_id%3=0 then 'narrow' when user_id%4=0 then 'headset' end, case when event_id%2=0 then 'echo' end, case when event_id%5=0 then 'gain' end) as warnings,
 coalesce(value=floor(value) and event_id%4<>1 and event_id%3<>2, false) as fits from events""")
def recorders_and_caches(spark, d):
    e, n, u = table(spark, d, "events"), F.col("event_id"), F.col("user_id")
    name = F.expr("case event_id%7 when 0 then 'NotAllowedError' when 1 then 'SecurityError' when 2 then 'NotFoundError' when 3 then 'AbortError' when 4 then 'TypeError' end")
    warn = rules.recorder_warnings(F.when(u % 3 == 0, 16000).otherwise(48000), F.when(u % 4 == 0, "My AirPods"), {"echo": n % 2 == 0, "gain": F.nullif(n % 5 == 0, F.lit(False))})
    wanted = {"version": F.lit(4), "crop": F.lit(None).cast("int"), "w2": F.lit(32), "h2": F.lit(8)}
    meta = {**wanted, "version": F.when(n % 4 == 1, 3).otherwise(4), "crop": F.when(n % 3 == 2, 1)}
    fits = rules.cache_fits(meta, wanted, F.floor("value") + 1, F.lit(True), (F.col("value") + 1) * 256)
    return e.select("event_id", rules.recorder_error(name).alias("error"), F.array_join(warn, ",").alias("warnings"), fits.alias("fits"))
