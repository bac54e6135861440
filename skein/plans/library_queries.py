"""Library and text queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text as t
from skein.operators import library as lib
from skein.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("select doc_id, lang from documents where contains(lower(source||chr(10)||lang||chr(10)||coalesce(text,'')), 'src1') and contains(lower(source||chr(10)||lang||chr(10)||coalesce(text,'')), 'the')")
def library_search(spark, d):
    return lib.search(table(spark, d, "documents"), "SRC1 the", ["source", "lang", "text"], ascii_only=True).select("doc_id", "lang")


@query()
def library_search_folded(spark, d):
    return lib.search(table(spark, d, "documents"), "ÉE the", ["source", "text"]).select("doc_id", "lang")


@query("""
with s as (select c_custkey as id, case when c_custkey%2=0 then 'Étude '||(c_custkey%12)||' part '||c_custkey else 'etude '||(c_custkey%12)||' part '||c_custkey end as title, case when c_custkey%4=0 then null when c_custkey%8=1 then '' else c_mktsegment end as artist, case when c_custkey%3=0 then null else 'channel '||(c_custkey%5) end as channel from customer),
w as (select *, coalesce(nullif(artist,''), channel) as who from s)
select id, title, artist, channel from w order by (coalesce(who,'')='') asc, lower(who) asc, (id%12) asc, id asc limit 60""")
def library_sort_topk(spark, d):
    k = F.col("c_custkey")
    title = F.concat(F.when(k % 2 == 0, "Étude ").otherwise("etude "), (k % 12).cast("string"), F.lit(" part "), k.cast("string"))
    artist = F.when(k % 4 == 0, None).when(k % 8 == 1, "").otherwise(F.col("c_mktsegment"))
    s = table(spark, d, "customer").select(k.alias("id"), title.alias("title"), artist.alias("artist"), F.when(k % 3 != 0, F.concat(F.lit("channel "), (k % 5).cast("string"))).alias("channel"))
    return lib.listing(s, "artist", 60)


@query("select count(*) as sheets, cast(sum(strlen(coalesce(text,''))) as bigint) as bytes from documents")
def library_totals(spark, d):
    return lib.totals(table(spark, d, "documents"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))


@query("select conv_id, string_agg(role, ',' order by turn) as roles, count(*) as n from conversations group by conv_id")
def sheets_with_pages(spark, d):
    c = table(spark, d, "conversations")
    p = lib.with_pages(c.select("conv_id").distinct(), c, "conv_id", "turn", "role")
    return p.select("conv_id", F.array_join("pages", ",").alias("roles"), F.size("pages").cast("long").alias("n"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels) and doc_id not in (select item_id from benchmark)")
def migrate_once(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return lib.migrate(docs, table(spark, d, "labels"), table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id")


@query("""
select doc_id, left(trim(source),3) as source, case when try_cast(n_chars as double) is null then 0.0 else least(greatest(n_chars::double,100.0),2000.0) end as n_chars from documents""")
def clean_records(spark, d):
    raw = table(spark, d, "documents")
    c = lib.clean(raw, {"doc_id": ("number", 0.0, 1e18, 0.0), "source": ("text", 3), "n_chars": ("number", 100.0, 2000.0, 0.0)})
    return c.withColumn("doc_id", F.col("doc_id").cast("long"))


@query("""
with v as (select p_partkey, 'v'||(p_partkey%3)||'.'||(p_size%12)||'.'||(p_partkey%7)||case when p_partkey%4=0 then '-beta.'||(p_size%11) when p_partkey%9=0 then '.x' else '' end as version from part)
select p_partkey, version, case when regexp_matches(version,'^v?[0-9]+\\.[0-9]+\\.[0-9]+(-[0-9A-Za-z.-]+)?$') then lpad(regexp_extract(version,'^v?([0-9]+)',1),12,'0')||'.'||lpad(split_part(split_part(version,'-',1),'.',2),12,'0')||'.'||lpad(split_part(split_part(version,'-',1),'.',3),12,'0')||'.'||
 case when contains(version,'-') then '1beta.0'||lpad(split_part(version,'beta.',2),12,'0') else '~' end end as sort_key from v""".replace("\\\\", "\\"))
def semver_sort(spark, d):
    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, F.concat(F.lit("-beta."), (F.col("p_size") % 11).cast("string"))).when(k % 9 == 0, ".x").otherwise("")
    v = table(spark, d, "part").select("p_partkey", F.concat(F.lit("v"), (k % 3).cast("string"), F.lit("."), (F.col("p_size") % 12).cast("string"), F.lit("."), (k % 7).cast("string"), tail).alias("version"))
    return v.withColumn("sort_key", t.version_key(F.col("version")))


_RULES = [("/de/", "german"), ("page=[0-9]+", "paged"), ("utm_", "tracked"), (r"\.html$", "file")]


@query("select page_id, case when regexp_matches(url,'/de/') then 'german' when regexp_matches(url,'page=[0-9]+') then 'paged' when regexp_matches(url,'utm_') then 'tracked' when regexp_matches(url,'\\.html$') then 'file' else 'other' end as kind from pages".replace("\\\\", "\\"))
def error_classify(spark, d):
    return table(spark, d, "pages").select("page_id", t.classify(F.col("url"), _RULES, "other").alias("kind"))


@query(r"""
select doc_id, (n_chars//60)||':'||lpad((n_chars%60)::varchar,2,'0') as clock, case when n_chars<1024 then n_chars||' B' else printf('%.1f KB', floor(n_chars/1024.0*10+0.5)/10) end as size,
 left(trim(regexp_replace(regexp_replace(coalesce(text,''),'[\\/:*?"<>|\x00-\x1f]',' ','g'),' +',' ','g'),' .'),80) as file_name from documents""")
def labels_and_names(spark, d):
    return table(spark, d, "documents").select("doc_id", t.clock(F.col("n_chars")).alias("clock"), t.byte_size(F.col("n_chars")).alias("size"), t.safe_name(F.coalesce("text", F.lit(""))).alias("file_name"))
