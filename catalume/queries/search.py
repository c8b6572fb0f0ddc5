"""Queries of asset search and facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cluster import new_folder, table
from ..operators import search as S
from ..operators import textindex as X
from ..operators.files import latest_file, representative_file
from ..operators.search import SearchArgs
from ..plans.standins import WITH, catalog
from .register import Register

query = Register()
_GRID = ["id", "title", "favorite", "play_count", "studio_id", "path", "duration", "height", "total"]


def _found(where: str, order: str = "created_at desc", limit: int = 200, offset: int = 0) -> str:
    return f"{WITH}, found as (select a.*, path, duration, height from assets a join (select asset_id as rep_of, path, duration, height from rep) r on rep_of = id where {where}) select id, title, favorite, play_count, studio_id, path, duration, height, (select count(*) from found) as total from found order by {order}, id limit {limit} offset {offset}"


def _search(spark, sf_dir, **args):
    return S.search_assets(catalog(spark, sf_dir), SearchArgs(**args)).select(*_GRID)


@query(_found("favorite >= 2 and duration >= 20000 and height >= 400 and ignored_at is null and id in (select asset_id from asset_tags where tag_id in ('PROMO', 'ECONOMY') group by asset_id having count(distinct tag_id) = 2) and id not in (select asset_id from asset_tags where tag_id = 'SMALL')"))
def search_assets(spark, sf_dir):
    return _search(spark, sf_dir, min_favorite=2, min_duration=20000, min_height=400, ignored=False, tags_all=("PROMO", "ECONOMY"), tags_none=("SMALL",), limit=200)


@query(_found("favorite > 0 and play_count = 0", "favorite desc, created_at desc", 100, 50))
def search_favorites_unplayed(spark, sf_dir):
    return _search(spark, sf_dir, favorites_only=True, unplayed_only=True, sort="favorite", limit=100, offset=50)


@query(_found("match_count > 1 and applied_at is null and ignored_at is null", "play_count desc, created_at desc"))
def search_needs_review(spark, sf_dir):
    return _search(spark, sf_dir, needs_review_only=True, sort="play_count", limit=200)


@query(_found("applied_at is not null and ignored_at is not null and duration <= 60000", "coalesce(lower(title), 'zzz')"))
def search_identified_ignored(spark, sf_dir):
    return _search(spark, sf_dir, identified_only=True, ignored=True, max_duration=60000, sort="title", limit=200)


@query(_found("studio_id is not null and studio_id in (1, 2, 3) and id in (select asset_id from asset_tags group by asset_id having count(*) >= 3) and id in (select asset_id from asset_people group by asset_id having count(*) >= 2)"))
def search_studio_min_links(spark, sf_dir):
    return _search(spark, sf_dir, studios=(1, 2, 3), min_tags=3, min_people=2, limit=200)


@query(_found("(studio_id is null or studio_id not in (1, 2, 3)) and id in (select asset_id from asset_tags where tag_id in ('PROMO', 'SMALL')) and id not in (select asset_id from asset_people where person_id in (1, 2))"))
def search_not_studio_tags_any(spark, sf_dir):
    return _search(spark, sf_dir, not_studios=(1, 2, 3), tags_any=("PROMO", "SMALL"), people_none=(1, 2), limit=200)


@query(_found("id in (select asset_id from asset_people where person_id in (3, 4) group by asset_id having count(distinct person_id) = 2)"))
def search_people_all(spark, sf_dir):
    return _search(spark, sf_dir, people_all=(3, 4), limit=200)


@query(_found("id in (select asset_id from files where starts_with(lower(path), 'e:' || chr(92) || 'lib a' || chr(92) || 'f' || chr(92)))"))
def search_under_folder(spark, sf_dir):
    return _search(spark, sf_dir, folders=("e:\\LIB A\\F",), limit=200)


_LINKED = "select asset_id from files where lower(path) like '%{0}%' union select asset_id from asset_tags where lower(tag_id) like '%{0}%' union select asset_id from asset_people join people on people.id = person_id where lower(name) like '%{0}%'"
_INCLUDED = "id in (select id from assets where regexp_matches(lower(title), '(^|[^a-z0-9]){0}([^a-z0-9]|$)') or regexp_matches(lower(details), '(^|[^a-z0-9]){0}([^a-z0-9]|$)') union " + _LINKED + ")"
_EXCLUDED = "not (lower(title) like '%{0}%' or lower(details) like '%{0}%') and id not in (" + _LINKED + ")"


@query(_found(_INCLUDED.format("urgent") + " and " + _INCLUDED.format("promo") + " and " + _EXCLUDED.format("clip_11")))
def search_text_include_exclude(spark, sf_dir):
    return _search(spark, sf_dir, include=("urgent promo",), exclude=("clip_11",), stemmed=False, limit=200)


@query(_found(_EXCLUDED.format("urgent") + " and " + _EXCLUDED.format("promo")))
def search_text_inverse(spark, sf_dir):
    return _search(spark, sf_dir, include=("urgent promo",), inverse=True, limit=200)


# Every word form with the stem of the word asked for.
_STEMMED = _INCLUDED.replace("{0}([^a-z0-9]", "({forms})([^a-z0-9]").replace("%{0}%", "%{term}%")
_ORDERS, _CUSTOMERS = _STEMMED.format(forms="order|orders|ordered|ordering|orderings", term="orders"), _STEMMED.format(forms="custom|customs|customed|customing|customer|customers|customize|customization", term="customers")


@query(_found(_ORDERS + " and " + _CUSTOMERS + " and " + _EXCLUDED.format("clip_11")))
def search_text_stemmed(spark, sf_dir):
    return _search(spark, sf_dir, include=("orders", "customers"), exclude=("clip_11",), limit=200)


@query(_found(_ORDERS + " and " + _INCLUDED.format("1-urgent"), "favorite desc, created_at desc", 100, 0))
def search_text_indexed(spark, sf_dir):
    """With an index, in which one of the terms is a phrase of two tokens."""
    c, args = catalog(spark, sf_dir), SearchArgs(include=("orders 1-urgent",), sort="favorite", limit=100)
    return S.search_assets(c, args, X.build_index(c.assets)).select(*_GRID)


_DOCS = "select doc_id as id, split_part(text, chr(10), 1) as title, text as details from documents"
_CHANGED = f"select id, case when id % 10 = 3 then concat('Thes of ', title) end as title, case when id % 10 <> 7 then reverse(details) end as details from ({_DOCS}) where id % 5 in (2, 3)"
_TEXTS = f"with d as ({_DOCS}), ch as ({_CHANGED}), t as (select id, strip_accents(lower(coalesce(title, ''))) as title, strip_accents(lower(coalesce(details, ''))) as details from (select * from d where id % 5 not in (2, 3) union all select * from ch))"
_OF_THE = r"(^|[^\p{L}\p{N}])of[^\p{L}\p{N}]+(the|thes|theing|theings)([^\p{L}\p{N}]|$)"
_THE = r"(^|[^\p{L}\p{N}])(the|thes|theing|theings)([^\p{L}\p{N}]|$)"


@query(f"{_TEXTS} select id::varchar as asset_id, term from (select id, 0 as term from t where regexp_matches(title, '{_OF_THE}') or regexp_matches(details, '{_OF_THE}') union all select id, 1 from t where regexp_matches(title, '{_THE}') or regexp_matches(details, '{_THE}'))")
def indexed_text_hits(spark, sf_dir):
    """A phrase and a word in an index of all texts that took in a change log: changed, turned round and emptied ones."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id as id", "split_part(text, char(10), 1) as title", "text as details")
    index = X.build_index(docs)
    log = docs.where("id % 5 in (2, 3)").selectExpr("id", "case when id % 10 = 3 then concat('Thes of ', title) end as title", "case when id % 10 <> 7 then reverse(details) end as details")
    for k in (2, 3):
        index = X.updated_index(index, log.where(f"id % 5 = {k}"))
    path = new_folder(spark)
    X.write_index(index, path)
    return X.indexed_hits(X.read_index(spark, path), ["of-the", "Thes"]).distinct()


@query("select doc_id, array_to_string(list_filter(regexp_split_to_array(query, '\\s+'), lambda x: x <> '' and not (starts_with(x, '-') and length(x) > 1)), '|') as include, array_to_string(list_transform(list_filter(regexp_split_to_array(query, '\\s+'), lambda x: starts_with(x, '-') and length(x) > 1), lambda x: substr(x, 2)), '|') as exclude from (select doc_id, concat(source, ' -', lang, ' - ', text) as query from documents)")
def parse_search_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    parsed = docs.select("doc_id", S.parse_search_query(F.concat("source", F.lit(" -"), "lang", F.lit(" - "), "text")).alias("p"))
    return parsed.select("doc_id", F.array_join("p.include", "|").alias("include"), F.array_join("p.exclude", "|").alias("exclude"))


@query(f"{WITH} select asset_id, id, path, duration, height from rep")
def representative_files(spark, sf_dir):
    return representative_file(catalog(spark, sf_dir).files).select("asset_id", "id", "path", "duration", "height")


@query(f"{WITH} select asset_id, id, path from (select *, row_number() over (partition by asset_id order by scanned_at desc, id) as n from files) where n = 1")
def latest_files(spark, sf_dir):
    return latest_file(catalog(spark, sf_dir).files).select("asset_id", "id", "path")


@query(f"{WITH} select a.id, s.name as studio_name, (select count(*) from files f where f.asset_id = a.id) as n_files, (select string_agg(tag_id, ',' order by tag_id) from asset_tags t where t.asset_id = a.id) as tags, (select string_agg(name, ',' order by name) from asset_people p join people on people.id = person_id where p.asset_id = a.id) as people from assets a left join studios s on s.id = a.studio_id")
def asset_detail(spark, sf_dir):
    names = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",")
    return S.asset_detail(catalog(spark, sf_dir)).select("id", "studio_name", F.coalesce(F.size("files"), F.lit(0)).cast("long").alias("n_files"), names("tags").alias("tags"), names("people").alias("people"))


@query(f"{WITH} select count(*) as total, count(*) filter (where favorite > 0) as favorites from assets where id in (select asset_id from files)")
def asset_counts(spark, sf_dir):
    return S.asset_counts(catalog(spark, sf_dir))


@query(f"{WITH} select regexp_extract(path, '^(.*)[/' || chr(92) || chr(92) || '][^/' || chr(92) || chr(92) || ']*$', 1) as folder, count(*) as n_files, any_value(split_part(path, chr(92), 3)) as name from files group by 1")
def folder_facet(spark, sf_dir):
    return S.folder_facet(catalog(spark, sf_dir).files)


@query(f"{WITH} select t.id, t.name, count(l.asset_id) as n_assets from tags t left join asset_tags l on l.tag_id = t.id group by all")
def tag_counts(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return S.tag_counts(c.tags, c.asset_tags)


@query(f"{WITH} select id, name from people order by name, id")
def list_people(spark, sf_dir):
    return S.list_dimension(catalog(spark, sf_dir).people).select("id", "name")


@query(f"{WITH} select id, favorite, epoch(last_played_at)::bigint as played from assets where id in (select asset_id from asset_tags where tag_id = 'PROMO')")
def shuffle_meta(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return S.shuffle_meta(c, S.links_any(c.asset_tags, "tag_id", ("PROMO",))).select("id", "favorite", F.unix_timestamp("last_played_at").alias("played"))


QUERIES, ORACLE_SQL = query.queries, query.sql
