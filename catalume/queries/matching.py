"""Queries of identification, enrichment, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..cluster import table
from ..functions.names import PLAIN_TAGS, TAG_WORDS
from ..operators import enrich as E
from ..operators import identify as I
from ..operators.files import representative_file
from ..operators.segments import cue_plan
from ..plans.standins import WITH, catalog
from ..sources import media, records
from ..streaming import playback
from .register import Register
from .scalars import _FROM, _paths
from .upkeep import _DIFF, _views

query = Register()
_NOW = "timestamp '1998-01-01 00:00:00'"


def _now():
    return F.lit("1998-01-01 00:00:00").cast("timestamp")


def _doc_prints(d):
    kinds = F.array(F.struct(F.lit("MD5").alias("t"), F.md5("text").alias("v")), F.struct(F.lit("oshash").alias("t"), F.upper(F.substring(F.md5("text"), 1, 3)).alias("v")))
    return d.select("doc_id", F.explode(kinds).alias("k")).select("doc_id", F.col("k.t").alias("hash_type"), F.col("k.v").alias("value"))


@query("with l as (select * from documents where doc_id % 2 = 0), r as (select * from documents where doc_id % 2 = 1), o as (select substr(md5(text), 1, 3) as v, min(doc_id) as id from r group by 1), m as (select md5(text) as v, min(doc_id) as id from r group by 1) select doc_id as asset_id, coalesce(o.id, m.id) as remote_id, case when o.id is not null then 'oshash' else 'md5' end as hash_type from l left join o on o.v = substr(md5(text), 1, 3) left join m on m.v = md5(text) where coalesce(o.id, m.id) is not null")
def match_by_fingerprint(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    local = _doc_prints(d.where("doc_id % 2 = 0")).withColumnRenamed("doc_id", "asset_id")
    return I.match_by_fingerprint(local, _doc_prints(d.where("doc_id % 2 = 1")).withColumnRenamed("doc_id", "remote_id")).select("asset_id", "remote_id", "hash_type")


def _matches(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("asset_id"), F.col("l_returnflag").alias("provider_id"), F.col("l_partkey").alias("remote_id"), "l_linestatus")


@query("with m as (select l_orderkey as asset_id, l_returnflag as provider_id, l_partkey as remote_id, case l_returnflag when 'N' then 0 when 'R' then 1 else 2 end as rank from lineitem) select asset_id, provider_id, remote_id from m where rank = (select min(rank) from m o where o.asset_id = m.asset_id)")
def provider_waterfall(spark, sf_dir):
    providers = spark.createDataFrame([("N", 0), ("R", 1), ("A", 2)], "provider_id string, rank int")
    return I.provider_waterfall(_matches(spark, sf_dir), providers).select("asset_id", "provider_id", "remote_id")


@query("select l_orderkey as asset_id, l_returnflag as provider_id, l_partkey as remote_id from lineitem where (l_orderkey, l_returnflag, l_partkey) not in (select (l_orderkey, l_returnflag, l_partkey) from lineitem where l_linestatus = 'F')".replace("in (select (l_orderkey, l_returnflag, l_partkey) from", "in (select l_orderkey, l_returnflag, l_partkey from"))
def drop_rejected(spark, sf_dir):
    m = _matches(spark, sf_dir)
    return I.drop_rejected(m, m.where("l_linestatus = 'F'")).select("asset_id", "provider_id", "remote_id")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, (abs(o_totalprice / 100 - l_extendedprice / 50) <= 45 or greatest(o_totalprice / 100, l_extendedprice / 50) / least(o_totalprice / 100, l_extendedprice / 50) <= 1.2) as plausible from lineitem join orders on o_orderkey = l_orderkey")
def duration_plausible(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", I.duration_plausible(F.col("o_totalprice") / 100, F.col("l_extendedprice") / 50).alias("plausible"))


@query("with t as (select c_custkey as asset_id, 'src' || (c_custkey % 20) as s from customer where c_custkey % 3 <> 0), c as (select doc_id as remote_id, lang || ' ' || source as title, lang, source from documents) select asset_id, remote_id, nth from (select asset_id, remote_id, cast(row_number() over (partition by asset_id order by length(title), remote_id) as int) as nth from t join c on source = s and lang = 'en') where nth <= 15")
def title_search_fallback(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asset_id"), F.concat(F.lit("EN - Src"), (F.col("c_custkey") % 20).cast("string")).alias("term"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("remote_id"), F.concat_ws(" ", "lang", "source").alias("title"), F.lit(None).cast("string").alias("code"))
    return I.title_search_fallback(c, c.where("asset_id % 3 = 0"), d)


@query(f"{WITH} select count(*) filter (where h) as total, count(*) filter (where h and checked_at is null) as never_checked, count(*) filter (where h and checked_at >= {_NOW} - interval 500 day) as checked_recently, count(*) filter (where h and ignored_at is null and (checked_at is null or checked_at < {_NOW} - interval 500 day)) as pending, count(*) filter (where match_count > 1 and applied_at is null and ignored_at is null) as needs_review from (select *, id in (select asset_id from files) as h from assets)")
def identify_stats(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return I.identify_stats(c.assets, c.files, _now(), 500)


@query(f"{WITH} select id from assets where ignored_at is null and (checked_at is null or checked_at < {_NOW} - interval 500 day) and id in (select asset_id from files)")
def select_pending(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return I.select_pending(c.assets, c.files, _now(), 500).select("id")


_OUTCOME = "with o as (select o_orderkey as asset_id, (select count(*) from lineitem where l_orderkey = o_orderkey) as n_raw, (select count(*) from lineitem where l_orderkey = o_orderkey and l_quantity > 30) as n_candidates from orders), r as (select *, case when n_candidates = 1 then 'applied' when n_candidates > 1 or n_raw > 1 then 'review' else 'none' end as outcome from o)"


def _outcomes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "asset_id")
    return I.identify_outcome(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), lines, lines.where("l_quantity > 30"), True)


@query(f"{_OUTCOME} select * from r")
def identify_outcome(spark, sf_dir):
    return _outcomes(spark, sf_dir)


@query(f"{_OUTCOME} select count(*) as assets, count(*) filter (where n_raw > 0) as matched, count(*) filter (where outcome = 'applied') as applied, count(*) filter (where outcome = 'review') as review from r")
def outcome_totals(spark, sf_dir):
    return I.outcome_totals(_outcomes(spark, sf_dir))


@query(f"{WITH} select id, cast(case when favorite > 2 then (select count(*) from files where asset_id = id_) else match_count end as int) as match_count, epoch(case when favorite > 2 then {_NOW} else checked_at end)::bigint as checked from (select *, id as id_ from assets)".replace("where asset_id = id_", "where files.asset_id = id_"))
def record_checks(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return I.record_checks(c.assets, c.assets.where("favorite > 2").select(F.col("id").alias("asset_id")), c.files, _now()).select("id", "match_count", F.unix_timestamp("checked_at").alias("checked"))


@query(f"{WITH} select id, cast(case when favorite = 1 then 0 else match_count end as int) as match_count, epoch(case when favorite = 1 then coalesce(ignored_at, {_NOW}) else ignored_at end)::bigint as ignored, favorite <> 1 and applied_at is not null as applied from assets")
def set_ignored(spark, sf_dir):
    a = catalog(spark, sf_dir).assets
    return I.set_ignored(a, a.where("favorite = 1").select(F.col("id").alias("asset_id")), _now()).select("id", "match_count", F.unix_timestamp("ignored_at").alias("ignored"), F.col("applied_at").isNotNull().alias("applied"))


_FOREIGN = "select c_custkey * 3 as f_id, case when c_custkey % 2 = 0 then c_name else ' ' end as f_title, case when c_custkey % 4 = 0 then c_mktsegment end as f_details, case when c_custkey % 5 = 0 then 'france' when c_custkey % 5 = 1 then ' New Studio ' end as f_studio, 'Person ' || c_custkey % 7 as f_person, case when c_custkey % 6 = 0 then 'PROMO' else '' end as f_tag from customer"
_STUDIO = "coalesce((select min(cast(n_nationkey as varchar)) from nation where lower(n_name) = lower(trim(f_studio))), sha256('studio|' || lower(trim(f_studio))))"


def _imported(spark, sf_dir):
    f = table(spark, sf_dir, "customer").selectExpr("c_custkey * 3 as asset_id", "case when c_custkey % 2 = 0 then c_name else ' ' end as title", "case when c_custkey % 4 = 0 then c_mktsegment end as details", "case when c_custkey % 5 = 0 then 'france' when c_custkey % 5 = 1 then ' New Studio ' end as studio", "array(concat('Person ', c_custkey % 7)) as people", "array(case when c_custkey % 6 = 0 then 'PROMO' else '' end) as tags")
    return I.import_metadata(catalog(spark, sf_dir), f)


@query(f"{WITH}, f as ({_FOREIGN}) select id, coalesce(nullif(f_title, ' '), title) as title, coalesce(f_details, details) as details, case when f_studio is null then cast(studio_id as varchar) else {_STUDIO} end as studio_id from assets left join f on f_id = id")
def import_metadata(spark, sf_dir):
    return _imported(spark, sf_dir)[0].assets.select("id", "title", "details", "studio_id")


@query(f"{WITH}, f as ({_FOREIGN}) select asset_id, cast(person_id as varchar) as person_id from asset_people union select f_id, sha256('people|' || lower(f_person)) from f")
def import_people(spark, sf_dir):
    return _imported(spark, sf_dir)[0].asset_people


# Records that bring nothing but a blank title, and a link that half of the assets have already.
@query(f"{WITH}, f as (select l_orderkey as a, min(l_suppkey) as s from lineitem group by 1) select f.a as asset_id, o_custkey % 2 = 0 as changed from f join orders on o_orderkey = f.a")
def import_outcome(spark, sf_dir):
    c = catalog(spark, sf_dir)
    known = c.asset_people.groupBy("asset_id").agg(F.min("person_id").alias("id")).join(c.people, "id").select("asset_id", F.col("name").alias("known"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset_id"), "o_custkey")
    f = known.join(orders, "asset_id").select("asset_id", F.lit(" ").alias("title"), *[F.lit(None).cast("string").alias(x) for x in ("details", "studio")], F.array(F.when(F.col("o_custkey") % 2 == 0, "Nobody").otherwise(F.upper("known"))).alias("people"), F.array().cast("array<string>").alias("tags"))
    return I.import_metadata(c, f)[1]


@query(f"{WITH}, f as (select l_orderkey as a from lineitem group by 1) select count(*) as matched, count(*) filter (where o_custkey % 2 = 0) as updated, count(*) filter (where o_custkey % 2 <> 0) as skipped from f join orders on o_orderkey = f.a")
def import_summary(spark, sf_dir):
    return I.import_summary(import_outcome(spark, sf_dir))


@query("with n as (select distinct trim(p_brand) as name from part union select distinct lower(p_type) from part), d as (select distinct p_type as id, lower(p_type) as k from part) select name, coalesce((select min(id) from d where k = lower(name)), sha256('brand|' || lower(name))) as dim_id from n")
def resolve_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    names = p.select(F.concat(F.lit(" "), "p_brand").alias("name")).unionByName(p.select(F.lower("p_type").alias("name"))).unionByName(p.select(F.lit("  ").alias("name")))
    return I.resolve_names(names, p.select(F.col("p_type").alias("id"), F.col("p_type").alias("name")).distinct(), "brand")[0]


def _chosen(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("asset_id")).agg(F.min("l_partkey").alias("k"))
    url = lambda w, u: F.struct(F.lit(u).alias("url"), F.lit(w).alias("width"))
    return line.select("asset_id", F.lit("box").alias("provider_id"), F.col("k").cast("string").alias("remote_id"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("Part "), "k")).otherwise(" ").alias("title"), F.lit(None).cast("string").alias("details"), F.when(F.col("k") % 3 == 0, F.lit("CANADA")).otherwise("New Studio").alias("studio"), F.array(F.concat(F.lit("Person "), F.col("k") % 7)).alias("people"), F.array(F.lit("promo"), F.lit("Fresh")).alias("tags"), F.array(url(10, "a"), url(20, "b"), url(20, "c"), url(99, " ")).alias("images"))


@query(f"{WITH}, k as (select l_orderkey as o, min(l_partkey) as k from lineitem group by 1) select id, case when k is null then title when k % 2 = 0 then 'Part ' || k end as title, case when k is null then details end as details, case when k is null then cast(studio_id as varchar) when k % 3 = 0 then (select cast(min(n_nationkey) as varchar) from nation where lower(n_name) = 'canada') else sha256('studio|new studio') end as studio_id from assets left join k on o = id".replace("(select cast(min(n_nationkey) as varchar) from nation where lower(n_name) = 'canada')", "coalesce((select cast(min(n_nationkey) as varchar) from nation where lower(n_name) = 'canada'), sha256('studio|canada'))"))
def apply_matches(spark, sf_dir):
    return I.apply_matches(catalog(spark, sf_dir), _chosen(spark, sf_dir), _now()).assets.select("id", "title", "details", "studio_id")


@query(f"{WITH}, k as (select l_orderkey as o, min(l_partkey) as k from lineitem group by 1), promo as (select coalesce((select min(id) from tags where lower(name) = 'promo'), sha256('tags|promo')) as id), fresh as (select coalesce((select min(id) from tags where lower(name) = 'fresh'), sha256('tags|fresh')) as id) select 'tag' as kind, asset_id, tag_id as dim_id from asset_tags union select 'tag', o, id from k, promo union select 'tag', o, id from k, fresh union select 'person', asset_id, cast(person_id as varchar) from asset_people union select 'person', o, coalesce((select cast(min(id) as varchar) from people where lower(name) = 'person ' || k % 7), sha256('people|person ' || k % 7)) from k")
def apply_matches_links(spark, sf_dir):
    c = I.apply_matches(catalog(spark, sf_dir), _chosen(spark, sf_dir), _now())
    tags = c.asset_tags.select(F.lit("tag").alias("kind"), "asset_id", F.col("tag_id").cast("string").alias("dim_id"))
    return tags.unionByName(c.asset_people.select(F.lit("person").alias("kind"), "asset_id", F.col("person_id").cast("string").alias("dim_id")))


def _dictionary(spark):
    return spark.createDataFrame([("person", "1", "Mary Stone"), ("person", "2", "Stone"), ("studio", "3", "Glimmer"), ("studio", "4", "GLIMMER.com"), ("tag", "5", "4k"), ("tag", "6", "Al"), ("tag", "7", "uhd")], "kind string, dim_id string, name string")


def _asset_paths(spark, sf_dir):
    return _paths(spark, sf_dir).withColumnRenamed("doc_id", "id")


_WORDS = f"(select doc_id as id, ' ' || trim(regexp_replace(lower(substr(regexp_replace(path, '[.][^.]*$', ''), 3)), '[^a-z0-9]+', ' ', 'g')) || ' ' as w from {_FROM})"
_NAMES = "(values ('person', '1', 'mary stone'), ('person', '2', 'stone'), ('studio', '3', 'glimmer'), ('studio', '4', 'glimmer com'), ('tag', '7', 'uhd')) n(kind, dim_id, norm)"
_HITS = f"hits as (select id, kind, dim_id, norm from {_WORDS}, {_NAMES} where contains(w, ' ' || norm || ' '))"


@query(f"with {_HITS} select * from hits")
def match_catalog_names(spark, sf_dir):
    return E.match_catalog_names(_asset_paths(spark, sf_dir), _dictionary(spark)).select("id", "kind", "dim_id", "norm")


@query(f"with {_HITS} select * from hits h where not exists (select 1 from hits l where l.id = h.id and l.kind = h.kind and length(l.norm) > length(h.norm) and contains(l.norm, h.norm))")
def subsume_names(spark, sf_dir):
    return E.subsume_names(E.match_catalog_names(_asset_paths(spark, sf_dir), _dictionary(spark))).select("id", "kind", "dim_id", "norm")


_OPEN = "open_ as (select * from hits h where not exists (select 1 from hits l where l.id = h.id and l.kind = h.kind and length(l.norm) > length(h.norm) and contains(l.norm, h.norm)))"
_TAGGED = f"tagged as (select doc_id as id, unnest(list_distinct(list_filter(regexp_extract_all(lower(split_part(regexp_replace(path, '[.][^.]*$', ''), chr(92), 4)), '[a-z0-9]+'), lambda x: x in ({', '.join(repr(w) for w in TAG_WORDS)})))) as tag from {_FROM})"
_LINKS = f"with {_HITS}, {_OPEN}, {_TAGGED}, links as (select id, 'studio' as kind, arg_max(dim_id, length(norm)) as dim_id from open_ where kind = 'studio' group by 1 union select id, kind, dim_id from open_ where kind <> 'studio' union select doc_id, 'person', '1' from {_FROM} where doc_id % 3 = 1 union select id, 'tag', case tag when '4k' then '5' else '7' end from tagged where tag in ('4k', 'uhd'))"


# Every second asset has its person, every third its tag; every fourth has a studio, which stays.
_KNOWN = "(kind = 'person' and dim_id = '1' and id % 2 = 0 or kind = 'tag' and dim_id = '7' and id % 3 = 0)"


def _linked(spark, sf_dir):
    paths = _asset_paths(spark, sf_dir)
    known = paths.where("id % 2 = 0").select("id", F.lit("person").alias("kind"), F.lit("1").alias("dim_id")).unionByName(paths.where("id % 3 = 0").select("id", F.lit("tag").alias("kind"), F.lit("7").alias("dim_id")))
    return paths, paths.select("id", F.when(F.col("id") % 4 == 0, "9").alias("studio_id")), known


@query(f"{_LINKS} select * from links where not {_KNOWN} and not (kind = 'studio' and id % 4 = 0)")
def link_path_metadata(spark, sf_dir):
    paths, assets, known = _linked(spark, sf_dir)
    studio, new = E.link_path_metadata(assets, paths, _dictionary(spark), known)
    return studio.select("id", F.lit("studio").alias("kind"), F.col("studio_id").alias("dim_id")).unionByName(new)


@query(f"{_LINKS} select (select count(*) from documents) as assets_scanned, count(distinct id) as assets_linked, count(*) filter (where kind = 'studio') as studios_linked, count(*) filter (where kind = 'person') as persons_linked, count(*) filter (where kind = 'tag') as tags_linked from links")
def path_link_summary(spark, sf_dir):
    paths = _asset_paths(spark, sf_dir)
    none = spark.createDataFrame([], "id long, kind string, dim_id string")
    return E.path_link_summary(paths, *E.link_path_metadata(paths.select("id", F.lit(None).cast("string").alias("studio_id")), paths, _dictionary(spark), none))


_PLAIN = ", ".join(f"'{w}'" for w in PLAIN_TAGS)
_DICT = "(values ('person', '1', 'Mary Stone'), ('person', '2', 'Stone'), ('studio', '3', 'Glimmer'), ('studio', '4', 'GLIMMER.com'), ('tag', '5', '4k'), ('tag', '6', 'Al'), ('tag', '7', 'uhd'))"


@query(
    f"with {_HITS}, {_OPEN}, {_TAGGED}, dict as (select * from {_DICT} d(kind, dim_id, name)), "
    f"found as (select o.id, o.kind, d.name, 'catalog' as source, 0 as rank from open_ o join dict d using (kind, dim_id) "
    f"union all select doc_id, case when regexp_matches(split_part(path, chr(92), 2), '^Lib [A-Za-z]{{2,}}$') then 'person' else 'studio' end, split_part(path, chr(92), 2), 'folder', 1 from {_FROM} "
    f"union all select doc_id, case doc_id % 3 when 1 then 'person' else 'studio' end, case doc_id % 3 when 1 then 'Mary Stone' else 'Glimmer' end, 'folder', 1 from {_FROM} where doc_id % 3 <> 0 "
    f"union all select doc_id, 'studio', 'Glimmer', 'bracket', 2 from {_FROM} where doc_id % 5 = 0 "
    f"union all select id, 'tag', case when tag in ({_PLAIN}) then tag else upper(tag[1]) || tag[2:] end, 'token', 3 from tagged), "
    "one as (select * from (select *, row_number() over (partition by id, kind, lower(name) order by rank) as nth from found) where nth = 1) "
    "select id, one.kind, one.name, dim_id, source, dim_id is null as create_new, coalesce(one.kind = 'person' and dim_id = '1' and id % 2 = 0 or one.kind = 'tag' and dim_id = '7' and id % 3 = 0, false) as already_linked from one left join dict on dict.kind = one.kind and lower(dict.name) = lower(one.name)"
)
def suggest_path_metadata(spark, sf_dir):
    paths, _, known = _linked(spark, sf_dir)
    return E.suggest_path_metadata(paths, _dictionary(spark), known)


@query(f"{WITH}, r as (select asset_id, split_part(path, chr(92), 2) as top, regexp_extract(path, 'clip ([0-9]+) [0-9]+', 1) as p, regexp_extract(path, '(clip [0-9]+ [0-9]+)', 1) as stem from rep) select id, case when favorite > 2 then title when r.asset_id is null then null when length(p) not between 2 and 6 or regexp_full_match(p, '19[7-9][0-9]|20[0-9][0-9]|2100|[0-9]{{6}}') then top || ' - ' || stem else stem end as title from assets left join r on r.asset_id = id")
def backfill_titles(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return E.backfill_titles(c.assets.withColumn("title", F.when(F.col("favorite") > 2, F.col("title"))), representative_file(c.files)).select("id", "title")


def _embedded(spark, sf_dir):
    e = table(spark, sf_dir, "customer").selectExpr("c_custkey * 3 as asset_id", "concat(' ', c_name) as title", "concat(c_mktsegment, ' & x; ', c_name) as artist", "c_mktsegment as comment")
    return E.apply_embedded(catalog(spark, sf_dir), e)


@query(f"{WITH} select id, case when c_custkey is null then title else c_name end as title, coalesce(c_mktsegment, details) as details from assets left join customer on c_custkey * 3 = id")
def apply_embedded(spark, sf_dir):
    return _embedded(spark, sf_dir).assets.select("id", "title", "details")


@query(f"{WITH}, n as (select c_custkey * 3 as asset_id, c_mktsegment as name from customer union all select c_custkey * 3, c_name from customer) select asset_id, cast(person_id as varchar) as person_id from asset_people union select asset_id, coalesce((select min(cast(s_suppkey as varchar)) from supplier where lower(s_name) = lower(name)), sha256('people|' || lower(name))) from n")
def embedded_people(spark, sf_dir):
    return _embedded(spark, sf_dir).asset_people


# Names of a key in several spellings, rates as fractions and not, and text that is no JSON.
@query(
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_linenumber < 7 then round(l_extendedprice, 6) end as duration, case when l_linenumber < 7 then cast(l_quantity as int) end as height, "
    "case when l_linenumber = 1 then 25.0 when l_linenumber = 2 then round(30000.0::double / 1001, 6) end::double as fps, case when l_linenumber < 7 then 'flag ' || l_returnflag end as title, "
    "case l_linenumber when 1 then 'first' when 2 then 'second' when 3 then 'third' end as artist, case when l_linenumber < 7 then 'seen' end as comment from lineitem"
)
def parse_probe_json(spark, sf_dir):
    by_line = lambda *values: F.element_at(F.array(*map(F.lit, values)), F.least("l_linenumber", F.lit(len(values))).cast("int"))
    rate = by_line("25/1", "30000/1001", "0/0", "30", "")
    artist = by_line('"ARTIST": "first", "performer": "x"', '"Artist": " ", "Author": "second", "performer": "x"', '"PERFORMER": " third "', '"album_artist": "no"')
    text = F.concat(F.lit('{"format": {"format_name": "mp4", "duration": "'), F.col("l_extendedprice").cast("string"), F.lit('", "tags": {"TITLE": " flag '), "l_returnflag", F.lit(' ", "Description": "seen", '), artist, F.lit('}}, "streams": [{"codec_type": "audio", "avg_frame_rate": "1/1"}, {"codec_type": "video", "width": 1, "height": '), F.col("l_quantity").cast("int").cast("string"), F.lit(', "r_frame_rate": "60/1", "avg_frame_rate": "'), rate, F.lit('"}, {"codec_type": "video", "height": 1}]}'))
    text = F.when(F.col("l_linenumber") < 7, text).otherwise("{no json")
    p = media.parse_probe_json(table(spark, sf_dir, "lineitem").withColumn("text", text), "text")
    return p.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("probe.duration", 6).alias("duration"), "probe.height", F.round("probe.fps", 6).alias("fps"), "probe.title", "probe.artist", "probe.comment")


# Two lists: the first match comes again in the second under another title, beside one more; every third has neither id.
@query("select p_partkey as asset_id, p_brand as remote_id, p_name as title, p_type as tag, p_size as width from part where p_partkey % 3 <> 0 union all select p_partkey, p_brand || '+', 'More ' || p_name, p_type, p_size + 1 from part")
def parse_candidates_json(spark, sf_dir):
    match = lambda id_, title, tag, width: F.struct(id_.alias("id"), title.alias("title"), F.array(F.struct(tag.alias("name"))).alias("tags"), F.array(F.struct(F.lit("u").alias("url"), width.cast("int").alias("width"))).alias("images"))
    of = F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand"))
    one = match(of, F.col("p_name"), F.col("p_type"), F.col("p_size"))
    again = match(of, F.lit("Again"), F.col("p_type"), F.col("p_size") + 9)
    more = match(F.concat("p_brand", F.lit("+")), F.concat(F.lit("More "), "p_name"), F.col("p_type"), F.col("p_size") + 1)
    text = F.to_json(F.array(F.array(one), F.array(again, more)))
    p = records.parse_candidates_json(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("asset_id"), text.alias("j")), "j")
    return p.select("asset_id", "remote_id", "title", F.col("tags")[0].alias("tag"), F.col("images")[0]["width"].alias("width"))


@query("select doc_id as file_id, (floor(st)::bigint * 1000 + floor((st - floor(st)) * 1000)::bigint) as start_ms, (i % 5 * 160)::int as x from (select *, (i + 0.5::double) / n * d as st from (select doc_id, (n_chars % 2000)::double as d, least(36, greatest(1, floor((n_chars % 2000) / 30)))::int as n from documents where n_chars % 2000 > 0), range(0, 36) t(i) where i < n)")
def cues_round_trip(spark, sf_dir):
    cues = cue_plan(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 2000).cast("double").alias("duration")))
    back = records.parse_cues(records.write_cues(cues), "vtt")
    return back.select("file_id", F.round(F.col("start") * 1000).cast("long").alias("start_ms"), "x")


# A stored view with every field, one with none, and text that is no view.
_PAYLOAD = """{"search": "%s -x", "searchInverse": true, "sort": "title", "minFavorite": 3, "tagIds": ["t1", "t2"], "excludeTagIds": ["t3"], "tagMatchAny": true, "performerIds": ["p1"], "excludePerformerIds": ["p2"], "studioIds": ["s1"], "excludeStudioIds": ["s2", "s3"], "minDurationMins": %s, "maxDurationMins": null, "unplayedOnly": true, "minTagCount": 2, "identifiedOnly": true, "needsReviewOnly": false, "ignoreState": "%s", "folderPaths": ["E:\\\\x"], "minHeight": 720, "minPerformerCount": 1}"""
_FULL = "event_id % 3 = 0"


@query(
    f"select event_id, case when {_FULL} then event_type || ' -x' else '' end as search, {_FULL} as inverse, case when {_FULL} then 'title' else 'created' end as sort, case when {_FULL} then 3 else 0 end as min_favorite, case when {_FULL} then 't1,t2|t3|p1|p2|s1|s2,s3|E:' || chr(92) || 'x' else '||||||' end as lists, "
    f"{_FULL} as tags_any, case when {_FULL} then (event_id % 9) * 60 else 0 end::double as min_duration, 0::double as max_duration, {_FULL} as unplayed_only, {_FULL} as identified_only, false as needs_review_only, case when {_FULL} then 2 else 0 end as min_tags, case when {_FULL} then 1 else 0 end as min_people, case when {_FULL} then 720 else 0 end as min_height, "
    f"case when {_FULL} then [true, false, null][event_id % 2 + 1] end as ignored from events where event_id % 3 <> 2"
)
def parse_saved_view(spark, sf_dir):
    parts = _PAYLOAD.split("%s")
    full = F.concat(F.lit(parts[0]), "event_type", F.lit(parts[1]), (F.col("event_id") % 9).cast("string"), F.lit(parts[2]), F.when(F.col("event_id") % 2 == 0, "ignored").otherwise("not_ignored"), F.lit(parts[3]))
    text = F.when(F.col("event_id") % 3 == 0, full).when(F.col("event_id") % 3 == 1, '{"ignoreState": "any"}').when(F.col("event_id") % 2 == 0, "not json").otherwise("[]")
    good, _ = records.parse_saved_view(table(spark, sf_dir, "events").select("event_id", F.lit("v").alias("name"), text.alias("payload")))
    lists = F.concat_ws("|", *[F.array_join(f"view.{c}", ",") for c in ("tags", "exclude_tags", "people", "exclude_people", "studios", "exclude_studios", "folders")])
    return good.select("event_id", "view.search", "view.inverse", "view.sort", "view.min_favorite", lists.alias("lists"), *[f"view.{c}" for c in ("tags_any", "min_duration", "max_duration", "unplayed_only", "identified_only", "needs_review_only", "min_tags", "min_people", "min_height", "ignored")])


def _progress(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "ts", (F.col("event_type") == "error").alias("terminal"), "event_type")


# The clock moves from one report that passes to the next: the first that is six hours later and isn't the end.
@query(
    "with recursive n as (select user_id, ts, event_id from events where event_type <> 'error'), c as (select user_id, min((ts, event_id)) as st from n group by 1 "
    "union all select * from (select n.user_id, min((n.ts, n.event_id)) as st from c join n on n.user_id = c.user_id and n.ts >= struct_extract(c.st, 1) + interval 6 hour group by 1)) "
    "select user_id as run_id, struct_extract(st, 2) as seq, false as terminal from c union all select user_id, event_id, true from events where event_type = 'error'")
def throttle_progress(spark, sf_dir):
    return playback.throttle(_progress(spark, sf_dir), 6 * 3600 * 1000).select("run_id", "seq", "terminal")


@query("select run_id, seq, event_type from (select user_id as run_id, event_id as seq, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def latest_progress(spark, sf_dir):
    return playback.latest_progress(_progress(spark, sf_dir)).select("run_id", "seq", "event_type")


@query(f"{_DIFF} select path, status from d where status <> 'removed'")
def incremental_inventory(spark, sf_dir):
    return playback.incremental_inventory(*_views(spark, sf_dir), False).select("path", "status")


QUERIES, ORACLE_SQL = query.queries, query.sql
