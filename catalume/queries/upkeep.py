"""Queries of inventory, duplicates, collections, plays, segments and downscale plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import Catalog
from ..cluster import table
from ..functions.hashing import median_bits
from ..operators import collections as C
from ..operators import duplicates as D
from ..operators import graph
from ..operators import inventory as I
from ..operators import plays as Y
from ..operators import segments as S
from ..operators.files import representative_file
from ..plans import downscale as Z
from ..plans.standins import WITH, catalog
from .register import Register

query = Register()

#: A listing in which every seventh file is gone, every fifth has another size and every eleventh stands elsewhere.
_LISTING = "select case when o_orderkey % 11 = 0 then concat('e:/moved/', o_orderkey) else concat('E:', chr(92), 'f', chr(92), o_orderkey) end as path, cast(o_totalprice as bigint) + case when o_orderkey % 5 = 0 then 1 else 0 end as size, o_orderdate as mtime, concat('h', o_orderkey % 1000) as oshash from orders where o_orderkey % 7 <> 0"
_OLD = "select o_orderkey as id, o_custkey as asset_id, concat('E:', chr(92), 'f', chr(92), o_orderkey) as path, cast(o_totalprice as bigint) as size_bytes, o_orderdate as modified_at from orders"
_NORMAL = "case when starts_with(path, 'e:/') then replace(path, '/', chr(92)) else path end"


def _views(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    listing = o.where("o_orderkey % 7 <> 0").selectExpr("case when o_orderkey % 11 = 0 then concat('e:/moved/', o_orderkey) else concat('E:', chr(92), 'f', chr(92), o_orderkey) end as path", "cast(o_totalprice as bigint) + case when o_orderkey % 5 = 0 then 1 else 0 end as size", "o_orderdate as mtime", "concat('h', o_orderkey % 1000) as oshash")
    files = o.selectExpr("o_orderkey as id", "o_custkey as asset_id", "concat('E:', chr(92), 'f', chr(92), o_orderkey) as path", "cast(o_totalprice as bigint) as size_bytes", "o_orderdate as modified_at")
    return listing, files


_DIFF = f"with l as (select {_NORMAL} as path, size, mtime from ({_LISTING})), f as ({_OLD}), d as (select coalesce(l.path, f.path) as path, id as file_id, asset_id, case when id is null then 'added' when l.path is null then 'removed' when size = size_bytes and mtime = modified_at then 'unchanged' else 'updated' end as status from l full join f on l.path = f.path)"


@query(f"{_DIFF} select path, status, file_id, asset_id from d")
def inventory_diff(spark, sf_dir):
    return I.inventory_diff(*_views(spark, sf_dir)).select("path", "status", "file_id", "asset_id")


@query(f"{_DIFF} select count(*) filter (where status <> 'removed') as found, count(*) filter (where status = 'added') as added, count(*) filter (where status = 'updated') as updated, count(*) filter (where status = 'removed') as removed from d")
def scan_summary(spark, sf_dir):
    return I.scan_summary(I.inventory_diff(*_views(spark, sf_dir)))


@query("with a as (select 'p' || doc_id as path, md5(text) as oshash from documents where doc_id % 2 = 1), k as (select md5(text) as oshash, min(doc_id) as asset from documents where doc_id % 2 = 0 group by 1) select path, coalesce(cast(asset as varchar), sha256('asset|' || a.oshash)) as asset_id, asset is not null as known from a left join k using (oshash)")
def detect_moves(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 2 = 0")
    prints = old.select(F.col("doc_id").alias("file_id"), F.lit("oshash").alias("hash_type"), F.md5("text").alias("value"))
    added = d.where("doc_id % 2 = 1").select(F.concat(F.lit("p"), "doc_id").alias("path"), F.md5("text").alias("oshash"))
    return I.detect_moves(added, prints, old.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("asset_id"))).select("path", "asset_id", "known")


def _roots(spark):
    return spark.createDataFrame([("e:/LIB A/", False), ("E:\\Lib N\\F", True), ("F:\\", True)], "path string, accessible boolean")


_UNDER_A, _UNDER_N = "starts_with(lower(path), 'e:' || chr(92) || 'lib a' || chr(92))", "starts_with(lower(path), 'e:' || chr(92) || 'lib n' || chr(92) || 'f' || chr(92))"


@query(f"{WITH} select id from files where {_UNDER_A} or {_UNDER_N}")
def under_root(spark, sf_dir):
    return I.under_root(catalog(spark, sf_dir).files, _roots(spark)).select("id")


@query(f"{WITH} select id from files where not {_UNDER_A}")
def protect_offline_roots(spark, sf_dir):
    return I.protect_offline_roots(catalog(spark, sf_dir).files, _roots(spark)).select("id")


_PRINTS = "select doc_id as file_id, t as hash_type, case t when 'oshash' then substr(md5(text), 1, 4) else md5(text || t) end as value from documents, (values ('oshash'), ('md5'), ('phash')) v(t) where not (t = 'phash' and doc_id % 3 = 0)"


def _prints(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    t = d.select("doc_id", "text", F.explode(F.array(*map(F.lit, ("oshash", "md5", "phash")))).alias("hash_type")).where("not (hash_type = 'phash' and doc_id % 3 = 0)")
    return t.select(F.col("doc_id").alias("file_id"), "hash_type", F.when(F.col("hash_type") == "oshash", F.substring(F.md5("text"), 1, 4)).otherwise(F.md5(F.concat("text", "hash_type"))).alias("value"))


_UPDATED = "select doc_id as file_id, case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then 'new' else substr(md5(text), 1, 4) end as oshash from documents where doc_id % 2 = 0 or doc_id % 5 = 1"


@query(f"with p as ({_PRINTS}), u as ({_UPDATED}), stale as (select u.file_id from u left join p on p.file_id = u.file_id and hash_type = 'oshash' where oshash is null or value is null or oshash <> value) select p.file_id, hash_type, case when hash_type = 'oshash' then coalesce(u.oshash, value) else value end as value from p left join u on u.file_id = p.file_id where not (hash_type in ('md5', 'phash') and p.file_id in (select file_id from stale))")
def invalidate_fingerprints(spark, sf_dir):
    u = table(spark, sf_dir, "documents").where("doc_id % 2 = 0 or doc_id % 5 = 1").select(F.col("doc_id").alias("file_id"), F.when(F.col("doc_id") % 4 == 0, None).when(F.col("doc_id") % 4 == 1, "new").otherwise(F.substring(F.md5("text"), 1, 4)).alias("oshash"))
    return I.invalidate_fingerprints(_prints(spark, sf_dir), u)


@query(f"with p as ({_PRINTS}), by_hash as (select o.value as oshash, min(h.value) as value from p o join p h on h.file_id = o.file_id and h.hash_type = 'phash' where o.hash_type = 'oshash' group by 1) select file_id, b.value from p join by_hash b on oshash = p.value where hash_type = 'oshash' and file_id not in (select file_id from p where hash_type = 'phash')")
def reuse_phash_by_oshash(spark, sf_dir):
    return I.reuse_phash_by_oshash(_prints(spark, sf_dir))


def _doc_files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 500).cast("double").alias("duration"), F.lit("2024-01-01").cast("timestamp").alias("scanned_at"), F.lit(None).cast("string").alias("thumb_path"))


@query(f"with p as ({_PRINTS}) select doc_id as id, o.value as oshash from documents left join p o on o.file_id = doc_id and o.hash_type = 'oshash' where n_chars % 500 > 0 and doc_id not in (select file_id from p where hash_type = 'phash')")
def missing_phash(spark, sf_dir):
    return I.missing_phash(_doc_files(spark, sf_dir), _prints(spark, sf_dir)).select("id", "oshash")


@query("select doc_id as id from documents where doc_id % 3 = 0")
def missing_md5(spark, sf_dir):
    return I.missing_hash(_doc_files(spark, sf_dir), _prints(spark, sf_dir).where("hash_type = 'md5' and file_id % 3 <> 0"), "md5").select("id")


@query("select doc_id as id from documents where doc_id % 3 <> 0 and doc_id % 4 <> 0")
def missing_previews(spark, sf_dir):
    files = _doc_files(spark, sf_dir).withColumns({"duration": F.when(F.col("id") % 3 != 0, F.col("duration")), "thumb_path": F.when(F.col("id") % 4 == 0, "made")})
    return I.missing_previews(files).select("id")


@query(f"{WITH} select id from assets where id in (select asset_id from files)")
def prune_orphans(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return I.prune_orphans(c.assets, c.files).select("id")


_ROWS = " union all ".join(f"select '{t}' as kind, asset_id, cast({k} as varchar) as key from {f}" for t, f, k in (("files", "files", "id"), ("asset_tags", "asset_tags", "tag_id"), ("asset_people", "asset_people", "person_id"), ("collection_items", "items", "collection_id")))


def _rows(c: Catalog):
    """All rows that hang on assets, and the assets."""
    out = c.assets.select(F.lit("assets").alias("kind"), F.col("id").alias("asset_id"), F.lit("").alias("key"))
    for t, key in (("files", "id"), ("asset_tags", "tag_id"), ("asset_people", "person_id"), ("collection_items", "collection_id")):
        out = out.unionByName(getattr(c, t).select(F.lit(t).alias("kind"), "asset_id", F.col(key).cast("string").alias("key")))
    return out


@query(f"{WITH}, r as (select 'assets' as kind, id as asset_id, '' as key from assets union all {_ROWS}) select * from r where asset_id not in (select id from assets where favorite = 5)")
def cascade_delete_assets(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return _rows(I.delete_assets(c, c.assets.where("favorite = 5").select("id")))


def _sizes(c: Catalog, **names):
    out = None
    for column, t in names.items():
        n = getattr(c, t).agg(F.count("*").alias(column))
        out = n if out is None else out.crossJoin(F.broadcast(n))
    return out


@query(f"{WITH}, gone as (select id from files where {_UNDER_A}), left_ as (select * from files where id not in (select id from gone)) select (select count(*) from left_) as files, (select count(*) from assets where id in (select asset_id from left_)) as assets, (select count(*) from asset_tags where asset_id in (select asset_id from left_)) as asset_tags")
def cascade_delete_root(spark, sf_dir):
    left = I.delete_root(catalog(spark, sf_dir), _roots(spark).where("not accessible"))
    return _sizes(left, files="files", assets="assets", asset_tags="asset_tags")


@query(f"{WITH} select (select count(*) from tags where id <> 'PROMO') as tags, (select count(*) from asset_tags where tag_id <> 'PROMO') as asset_tags, (select count(*) from assets where studio_id is not null and studio_id <> 3) as with_studio")
def cascade_delete_tag_studio(spark, sf_dir):
    c = catalog(spark, sf_dir)
    c = I.delete_studios(I.delete_tags(c, c.tags.where("id = 'PROMO'").select("id")), c.studios.where("id = 3").select("id"))
    return _sizes(c, tags="tags", asset_tags="asset_tags").crossJoin(F.broadcast(c.assets.agg(F.count("studio_id").alias("with_studio"))))


@query("select case l_linenumber % 4 when 0 then chr(92) || chr(92) || 'nas' || l_returnflag || chr(92) || 'share' when 1 then l_returnflag || ':' when 2 then 'mnt' else 'N:' end as volume, count(*) as n_files from lineitem group by 1")
def drive_histogram(spark, sf_dir):
    on = F.col("l_linenumber") % 4
    path = F.when(on == 0, F.concat(F.lit("\\\\nas"), "l_returnflag", F.lit("/share/x/y.mp4"))).when(on == 1, F.concat(F.lower("l_returnflag"), F.lit(":y.mp4"))).when(on == 2, "/mnt/x/y.mp4").otherwise("n:\\y.mp4")
    return I.drive_histogram(table(spark, sf_dir, "lineitem").select(path.alias("path")))


@query("select o_orderkey as id, case when o_orderkey % 11 = 0 then concat('e:', chr(92), 'moved', chr(92), o_orderkey) else concat('E:', chr(92), 'f', chr(92), o_orderkey) end as path from orders where o_orderkey % 7 <> 0")
def repair_paths(spark, sf_dir):
    listing, _ = _views(spark, sf_dir)
    return I.repair_paths(listing.select(F.regexp_extract("path", "([0-9]+)$", 1).cast("long").alias("id"), "path")).select("id", "path")


# Each vector's hash and a planted copy that differs in its lowest vec_id % 13 bits.
_BITS = "select vec_id, list_transform(range(1, 65), lambda i: embedding[i]::double > (list_sort(embedding)[32]::double + list_sort(embedding)[33]::double) / 2) as bits from embeddings"


def _hashes(spark, sf_dir):
    h = table(spark, sf_dir, "embeddings").select("vec_id", median_bits(F.col("embedding")).alias("hash"))
    copy = h.select((F.col("vec_id") + 1000000).alias("id"), F.expr("hash ^ (shiftleft(1L, cast(vec_id % 13 as int)) - 1)").alias("hash"))
    return h.select(F.col("vec_id").alias("id"), "hash").unionByName(copy)


_SIGNED = "case when h >= 9223372036854775808::hugeint then h - 18446744073709551616::hugeint else h end::bigint"
_HASH = f"(select vec_id, {_SIGNED} as hash from (select vec_id, list_sum(list_transform(range(0, 64), lambda i: case when bits[i + 1] then power(2::double, 63 - i)::hugeint else 0 end)) as h from ({_BITS})))"


# All pairs of distinct hashes, each vector's and its copy's, compared one by one.
@query(f"with o as {_HASH}, h as (select hash from o union select xor(hash, (1 << (vec_id % 13)::int)::bigint - 1) from o) select x.hash as a, y.hash as b, bit_count(xor(x.hash, y.hash))::int as distance from h x join h y on x.hash < y.hash and bit_count(xor(x.hash, y.hash)) <= 8")
def hamming_pairs(spark, sf_dir):
    return D.hamming_pairs(_hashes(spark, sf_dir)).select("a", "b", F.col("distance").cast("int").alias("distance"))


# Chains of up to four copies, each seven bits from the one before, in a catalog with several files an asset.
_CHAINED = f"with recursive o as {_HASH}, h as (select vec_id + 1000000 * k as id, xor(xor(xor(hash, case when k > 0 then 127 else 0 end::bigint), case when k > 1 then 127 * 128 else 0 end::bigint), case when k > 2 then 127 * 16384 else 0 end::bigint) as hash, k from (select *, unnest(range(vec_id % 4 + 1)) as k from o)), e as (select x.id as a, y.id as b from h x join h y on bit_count(xor(x.hash, y.hash)) <= 8), reach as (select id, id as other from h union select reach.id, e.b from reach join e on e.a = reach.other), g as (select id, min(other) as least_, count(*) as n_members from reach group by id), m as (select g.*, hash, k from g join h using (id) where n_members > 1), far as (select x.least_, max(bit_count(xor(x.hash, y.hash))) as max_distance from m x join m y using (least_) group by 1)"


def _chained(spark, sf_dir):
    h = table(spark, sf_dir, "embeddings").select("vec_id", median_bits(F.col("embedding")).alias("hash"), F.explode(F.sequence(F.lit(0), (F.col("vec_id") % 4).cast("int"))).alias("k"))
    turn = lambda k, bits: F.when(F.col("k") > k, F.lit(bits).cast("long")).otherwise(F.lit(0).cast("long"))
    h = h.select((F.col("vec_id") + F.col("k") * 1000000).alias("id"), F.col("hash").bitwiseXOR(turn(0, 127)).bitwiseXOR(turn(1, 127 * 128)).bitwiseXOR(turn(2, 127 * 16384)).alias("hash"), "k")
    each = h.withColumn("nth", F.explode(F.array(F.lit(0), F.lit(1))))
    files = each.select(F.concat_ws("-", "id", "nth").alias("id"), F.col("id").alias("asset_id"), F.concat(F.lit("E:\\v\\"), "id", F.lit("-"), "nth").alias("path"), F.when(F.col("k") == 2, "av1").otherwise("h264").alias("codec"), (F.col("nth") * 10.0 + 5).alias("duration"), F.lit(None).cast("timestamp").alias("scanned_at"))
    # The short file's hash plays no part.
    value = F.when(F.col("nth") == 1, F.lower(F.hex("hash"))).otherwise(F.lit("0"))
    prints = each.select(F.concat_ws("-", "id", "nth").alias("file_id"), F.lit("phash").alias("hash_type"), value.alias("value"))
    return Catalog(assets=h.select("id", F.concat(F.lit("Clip "), "id").alias("title")), files=files, fingerprints=prints)


@query(f"{_CHAINED} select m.id, n_members, max_distance, min(hash) over (partition by least_) as \"group\", 'Clip ' || m.id as title, 'E:' || chr(92) || 'v' || chr(92) || m.id || '-1' as path, case when k = 2 then 'av1' else 'h264' end as codec from m join far using (least_)")
def find_duplicates(spark, sf_dir):
    return D.find_duplicates(_chained(spark, sf_dir)).select("id", "n_members", F.col("max_distance").cast("long").alias("max_distance"), "group", "title", "path", "codec")


@query(f"{_CHAINED} select min(hash) as \"group\", count(*) as n_members, max(max_distance) as max_distance from m join far using (least_) group by least_")
def duplicate_group_summary(spark, sf_dir):
    g = D.duplicate_groups(D.representative_hashes(_chained(spark, sf_dir)))
    return D.duplicate_group_summary(g).select("group", "n_members", F.col("max_distance").cast("long").alias("max_distance"))


# Every vector's hash and its copy's, and the group of each hash: all that a chain of pairs within eight bits reaches. Of nine
# bands of seven bits such a pair has one alike.
_GROUPED = (
    f"with recursive o as {_HASH}, v as (select vec_id as id, hash from o union all select vec_id + 1000000, xor(hash, (1 << (vec_id % 13)::int)::bigint - 1) from o), "
    "band as (select hash, i, (hash >> (7 * i)::int) & 127 as part from (select distinct hash from v where hash is not null), range(9) t(i)), "
    "near as (select distinct x.hash as a, y.hash as b from band x join band y using (i, part) where x.hash <> y.hash and bit_count(xor(x.hash, y.hash)) <= 8), "
    "reach as (select distinct a, a as b from near union select reach.a, near.b from reach join near on near.a = reach.b), "
    "g as (select id, coalesce(least_, hash) as grp from v left join (select a, min(b) as least_ from reach group by 1) on a = hash)"
)


@query(f"{_GROUPED}, r as (select id, id % 1000000 % 6 + case when id >= 1000000 then id % 2 else 0 end as favorite, grp from g where grp is not null) select id as keeper, favorite from (select *, row_number() over (partition by grp order by favorite desc, id) as nth, count(*) over (partition by grp) as n from r) where nth = 1 and n > 1")
def default_keeper(spark, sf_dir):
    g = D.duplicate_groups(_hashes(spark, sf_dir))
    rated = g.select("id", (F.col("id") % 1000000 % 6 + F.when(F.col("id") >= 1000000, F.col("id") % 2).otherwise(0)).alias("favorite"))
    return D.default_keeper(g, rated).select("keeper", "favorite")


@query(f"{_GROUPED} select count(*) as n_assets, sum(best) as favorites from (select max(id % 1000000 % 6) as best from g group by grp, case when grp is null then id end)")
def merge_duplicates(spark, sf_dir):
    h = _hashes(spark, sf_dir)
    assets = h.select("id", (F.col("id") % 1000000 % 6).alias("favorite"))
    g = D.duplicate_groups(h)
    left = D.merge_duplicates(Catalog(assets=assets), g, D.default_keeper(g, assets))
    return left.assets.agg(F.count("*").alias("n_assets"), F.sum("favorite").alias("favorites"))


# The orders of a customer hang together as a chain, each with the next.
@query("select o_orderkey as node, least_ as component from (select o_orderkey, min(o_orderkey) over (partition by o_custkey) as least_, count(*) over (partition by o_custkey) as n from orders) where n > 1")
def connected_components(spark, sf_dir):
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy(F.xxhash64("o_orderkey"))).alias("b"))
    return graph.connected_components(e.where("b is not null"))


@query(f"{WITH} select c.id, count(i.asset_id) as n_items from collections c left join (select * from items where asset_id in (select asset_id from files)) i on i.collection_id = c.id group by 1")
def collection_counts(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return C.collection_counts(c.collections, c.collection_items, c.files).select("id", "n_items")


@query(f"{WITH} select collection_id, position, asset_id, title, path from items join assets a on a.id = asset_id join (select asset_id as r, path from rep) on r = asset_id")
def collection_assets(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return C.collection_assets(c.collection_items, c.assets, representative_file(c.files)).select("collection_id", "position", "asset_id", "title", "path")


@query(f"{WITH}, old as (select * from items where asset_id % 3 <> 0), new as (select o_custkey as collection_id, o_orderkey as asset_id from orders where o_orderkey % 2 = 0) select collection_id, asset_id, position from old union all select collection_id, asset_id, cast(coalesce((select max(position) from old o where o.collection_id = n.collection_id), -1) + row_number() over (partition by collection_id order by asset_id) as int) from new n where not exists (select 1 from old o where o.collection_id = n.collection_id and o.asset_id = n.asset_id)")
def append_items(spark, sf_dir):
    new = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("collection_id"), F.col("o_orderkey").alias("asset_id"), F.col("o_orderkey").alias("nth"))
    return C.append_items(catalog(spark, sf_dir).collection_items.where("asset_id % 3 <> 0"), new)


@query(f"{WITH} select collection_id, asset_id, cast(row_number() over (partition by collection_id order by position) - 1 as int) as position from items where asset_id % 3 <> 0")
def compact_positions(spark, sf_dir):
    return C.compact_positions(catalog(spark, sf_dir).collection_items.where("asset_id % 3 <> 0"))


@query(f"{WITH}, s as (select collection_id, asset_id, cast(row_number() over (partition by collection_id order by asset_id desc) - 1 as int) as nth from items where asset_id % 4 = 0) select i.collection_id, i.asset_id, cast(coalesce(nth, (select count(*) from s c where c.collection_id = i.collection_id) + row_number() over (partition by i.collection_id, nth is null order by position) - 1) as int) as position from items i left join s on s.collection_id = i.collection_id and s.asset_id = i.asset_id")
def reorder_items(spark, sf_dir):
    from pyspark.sql.window import Window

    items = catalog(spark, sf_dir).collection_items
    nth = F.row_number().over(Window.partitionBy("collection_id").orderBy(F.desc("asset_id"))) - 1
    return C.reorder_items(items, items.where("asset_id % 4 = 0").select("collection_id", "asset_id", nth.alias("nth")))


@query("select l_suppkey as collection_id, l_partkey as asset_id, min(l_orderkey) as position from lineitem group by 1, 2")
def dedupe_keep_oldest(spark, sf_dir):
    return C.dedupe_keep_oldest(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("collection_id"), F.col("l_partkey").alias("asset_id"), F.col("l_orderkey").alias("position"))).select("collection_id", "asset_id", "position")


_DRAW = "-ln((('0x' || substr(md5({key} || '|seed'), 1, 8))::bigint + 0.5) / 4294967296.0) / {weight}"


@query(f"{WITH} select id as asset_id, round(" + _DRAW.format(key="cast(id as varchar)", weight="greatest(favorite, 1)::double") + ", 9) as draw from assets")
def weighted_shuffle(spark, sf_dir):
    drawn = C.weighted_shuffle(catalog(spark, sf_dir).assets.select(F.col("id").alias("asset_id"), "favorite"), "seed")
    return drawn.select("asset_id", F.round(C.draw_key(F.col("asset_id"), F.greatest(F.col("favorite"), F.lit(1)).cast("double"), "seed"), 9).alias("draw"))


@query("select * from (select o_custkey as collection_id, o_orderkey as asset_id, cast(row_number() over (partition by o_custkey order by " + _DRAW.format(key="cast(o_orderkey as varchar)", weight="greatest(cast(o_orderkey % 6 as double), 0.05)") + ", o_orderkey) as int) as nth from orders) where nth <= 5")
def weighted_pick(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("collection_id"), F.col("o_orderkey").alias("asset_id"), (F.col("o_orderkey") % 6).alias("weight"))
    return C.weighted_pick(items, "seed", 5, "collection_id").select("collection_id", "asset_id", "nth")


_PASS = "row_number() over (partition by o_custkey order by {draw}, o_orderkey)"
_FIRST = _PASS.format(draw=_DRAW.format(key="cast(o_orderkey as varchar)", weight="w"))
_COOLED = _PASS.format(draw=_DRAW.format(key="cast(o_orderkey as varchar)", weight="greatest(w * case when nth > n - cool then 0.12 else 1 end, 0.05)").replace("|seed", "|seed|1"))


@query(f"with i as (select *, count(*) over (partition by o_custkey) as n, greatest(cast(o_orderkey % 6 as double), 0.05) as w from orders where o_orderkey % 8 <> 0), f as (select *, {_FIRST} as nth, case when n <= 1 then 0 else least(40, greatest(3, floor(n * 3 / 20))) end as cool from i), s as (select *, {_COOLED} as again from f) select o_custkey as collection_id, o_orderkey as asset_id, cast(nth as int) as nth from s where nth <= 12 union all select o_custkey, o_orderkey, cast(n + again as int) from s where n + again <= 12")
def weighted_pick_passes(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("collection_id"), F.col("o_orderkey").alias("asset_id"), F.greatest(F.col("o_orderkey") % 6, F.lit(0.05)).alias("weight"))
    return C.weighted_pick(items, "seed", 12, "collection_id", passes=2, excluded=items.where("asset_id % 8 = 0")).select("collection_id", "asset_id", "nth")


# A player for each customer, draw by draw: lists of what is drawn in this pass and of the last plays; every 8th order fails to load.
_W = "case when list_contains(recent, x.id) then x.c else x.w end"
_LEFT = "list_filter(q, lambda x: not list_contains(drawn, x.id) and x.id is distinct from failed)"
_SESSION = (
    "with recursive q as (select o_custkey as g, list(struct_pack(id := o_orderkey, w := greatest(o_orderkey % 6, 1) * 1000000, c := greatest(o_orderkey % 6, 1) * 120000) order by o_orderdate, o_orderkey) as q, case when count(*) <= 1 then 0 else least(40, greatest(3, count(*) * 3 // 20)) end::int as rest from orders group by 1), "
    "s as (select g, q, rest, 0 as nth, null::bigint as id, 0 as pass, [-1::bigint] as drawn, [-1::bigint] as recent, null::bigint as failed from q union all "
    "select g, q, rest, nth, id, pass, list_append(drawn, id), case when id % 8 = 0 then recent else list_append(list_filter(recent, lambda r: r <> id), id)[-greatest(rest, 1):] end, case when id % 8 = 0 then id end from "
    "(select *, (list_filter(list_transform(range(1, len(has) + 1), lambda i: struct_pack(id := has[i].id, upto := list_sum(list_transform(has[1:i], lambda x: x.w)))), lambda y: y.upto > (chance::hugeint * list_sum(list_transform(has, lambda x: x.w))) // 4294967296)[1]).id as id from "
    f"(select g, q, rest, nth + 1 as nth, pass + fresh::int as pass, case when fresh then [-1::bigint] else drawn end as drawn, recent, list_transform(case when fresh then list_filter(q, lambda x: x.id is distinct from failed) else has end, lambda x: struct_pack(id := x.id, w := {_W.replace('list_contains(recent, x.id)', 'rest > 0 and list_contains(recent, x.id)')})) as has, ('0x' || substr(md5(g || '|seed|' || (nth + 1)), 1, 8))::bigint as chance from "
    f"(select *, {_LEFT} as has, len({_LEFT}) = 0 as fresh from s where nth < 12)) where len(has) > 0)) "
)


@query(_SESSION + 'select g as collection_id, nth, id as asset_id, pass, id % 8 <> 0 as played from s where nth > 0')
def weighted_session(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("collection_id"), F.col("o_orderkey").alias("asset_id"), F.col("o_orderdate").alias("position"), (F.col("o_orderkey") % 6).alias("favorite"), F.lit(None).cast("timestamp").alias("last_played_at"), (F.col("o_orderkey") % 8 == 0).alias("dead"))
    return C.weighted_session(items, "seed", 12, "collection_id", fails="dead")


@query(f"{WITH} select 'kept' as state, asset_id, tag_id from asset_tags where asset_id % 2 = 0 union all select 'removed', asset_id, tag_id from asset_tags where asset_id % 2 <> 0 union all select distinct 'added', asset_id, 'NEW' from files where asset_id % 9 = 0 union all select 'after', asset_id, tag_id from asset_tags union all select distinct 'after', asset_id, 'NEW' from files where asset_id % 9 = 0")
def add_remove_links(spark, sf_dir):
    c = catalog(spark, sf_dir)
    # Some of the new ones are there already, some come twice.
    new = c.files.where("asset_id % 9 = 0").select("asset_id", F.lit("NEW").alias("tag_id")).unionByName(c.asset_tags.where("asset_id % 9 = 0"))
    after, fresh = C.add_links(c.asset_tags, new)
    kept, removed = C.remove_links(c.asset_tags, c.asset_tags.where("asset_id % 2 <> 0"))
    named = lambda df, n: df.select(F.lit(n).alias("state"), "asset_id", "tag_id")
    return named(kept, "kept").unionByName(named(removed, "removed")).unionByName(named(fresh, "added")).unionByName(named(after, "after"))


_SAMPLES = "select user_id * 100 + day(ts) as load_id, user_id as asset_id, ts, event_id % 40 * 1.5 + value % 2 as pos, event_type = 'error' as paused, event_type = 'signup' and event_id % 50 = 0 as eof, value as duration from events"


def _samples(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("user_id * 100 + day(ts) as load_id", "user_id as asset_id", "ts", "event_id % 40 * 1.5 + value % 2 as pos", "event_type = 'error' as paused", "event_type = 'signup' and event_id % 50 = 0 as eof", "value as duration")


_WATCH = f"with s as ({_SAMPLES}), d as (select *, pos - lag(pos) over w as step, lag(paused) over w as was from s window w as (partition by load_id order by ts, pos nulls first, paused nulls first)), w as (select load_id, asset_id, round(sum(case when not paused and not coalesce(was, true) and step > 0 and step <= 2 then step else 0 end), 6) as watched, max(duration) as duration, bool_or(eof) as eof from d group by 1, 2)"


@query(f"{_WATCH} select load_id, asset_id, watched, eof from w")
def forward_watch_time(spark, sf_dir):
    return Y.forward_watch_time(_samples(spark, sf_dir)).select("load_id", "asset_id", F.round("watched", 6).alias("watched"), "eof")


@query(f"{_WATCH} select load_id, asset_id from w where eof or watched >= case when duration > 0 then least(30.0, duration / 10) else 30.0 end")
def play_events(spark, sf_dir):
    return Y.play_events(_samples(spark, sf_dir)).select("load_id", "asset_id")


@query("select session_id, asset_id, nth from (select *, cast(row_number() over (partition by session_id order by ts desc, asset_id) as int) as nth from (select user_id as session_id, event_id % 25 as asset_id, max(ts) as ts from events group by 1, 2)) where nth <= 3")
def recent_plays_cooldown(spark, sf_dir):
    return Y.recent_plays_cooldown(table(spark, sf_dir, "events").selectExpr("user_id as session_id", "event_id % 25 as asset_id", "ts"), 25)


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("event_id") % 3000).alias("asset_id"), "ts", (F.col("event_id") % 11 - 2).alias("favorite"))


@query(f"{WITH}, p as (select event_id % 3000 as a, count(*) as n, max(ts) as ts from events group by 1) select id, play_count + coalesce(n, 0) as play_count, epoch(date_trunc('second', greatest(last_played_at, ts)))::bigint as played from assets left join p on a = id")
def apply_play_log(spark, sf_dir):
    return Y.apply_play_log(catalog(spark, sf_dir).assets, _log(spark, sf_dir)).select("id", "play_count", F.unix_timestamp("last_played_at").alias("played"))


@query(f"{WITH}, f as (select event_id % 3000 as a, arg_max(event_id % 11 - 2, (ts, event_id % 11 - 2)) as v from events group by 1) select id, cast(coalesce(greatest(0, least(5, v)), favorite) as int) as favorite from assets left join f on a = id".replace("arg_max(event_id % 11 - 2, (ts, event_id % 11 - 2))", "(list(event_id % 11 - 2 order by ts desc, event_id % 11 - 2 desc))[1]"))
def apply_favorites(spark, sf_dir):
    return Y.apply_favorites(catalog(spark, sf_dir).assets, _log(spark, sf_dir)).select("id", "favorite")


@query(f"{WITH}, e as (select event_id % 3000 as a, (list(event_type order by ts desc, event_id desc))[1] as v from events where event_id % 2 = 0 group by 1) select id, coalesce(v, title) as title, details from assets left join e on a = id")
def apply_edits(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id % 2 = 0").selectExpr("event_id % 3000 as asset_id", "struct(ts, event_id) as ts", "'title' as field", "event_type as value")
    return Y.apply_edits(catalog(spark, sf_dir).assets, e).select("id", "title", "details")


@query("select o_orderkey as id, o_custkey as asset_id, (case when o_orderkey % 3 = 0 then o_totalprice / 2 when o_orderkey % 3 = 1 and o_orderkey % 4 = 0 then 7 else o_orderkey % 100 end)::double as start_sec, case when o_orderkey % 3 = 0 then 'new' when o_orderkey % 3 = 1 and o_orderkey % 4 = 0 then '' else 'old' end as label from orders")
def upsert_segments(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    make = lambda start, end, label: o.selectExpr("o_orderkey as id", "o_custkey as asset_id", f"{start} as start_sec", f"{end} as end_sec", f"{label} as label", "cast(null as string) as tag_id", "'' as person_id")
    old = make("cast(o_orderkey % 100 as double)", "cast(null as double)", "'old'")
    # Two valid changes of one id; starts below 0; and ends that are infinite, no number, or fine.
    two = make("o_totalprice / 2", "o_totalprice", "' new '").unionByName(make("o_totalprice / 4", "o_totalprice", "'less'")).where("id % 3 = 0")
    ends = make("cast(7 as double)", "case o_orderkey % 4 when 0 then 8.0D when 1 then double('Infinity') when 2 then double('NaN') else 6.0D end", "cast(null as string)").where("id % 3 = 1")
    changes = two.unionByName(ends).unionByName(make("-1.0D", "o_totalprice", "'x'").where("id % 3 = 2"))
    good, _ = S.upsert_segments(old, changes)
    return S.segments_list(good).select("id", "asset_id", "start_sec", "label")


_CUES = "(select doc_id, d, n, i from (select doc_id, (n_chars % 2000)::double as d, least(36, greatest(1, floor((n_chars % 2000) / 30)))::int as n from documents where n_chars % 2000 > 0), range(0, 36) t(i) where i < n)"


def _cues(spark, sf_dir):
    return S.cue_plan(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 2000).cast("double").alias("duration")))


@query(f"select doc_id as file_id, i, round((i + 0.5::double) / n * d, 6) as start, round(case when i = n - 1 then d else (i + 1.5::double) / n * d end, 6) as \"end\", (i % 5 * 160)::int as x, (i // 5 * 90)::int as y from {_CUES}")
def cue_plan(spark, sf_dir):
    return _cues(spark, sf_dir).select("file_id", "i", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "x", "y")


@query(f"with c as (select doc_id, i, (i + 0.5::double) / n * d as start from {_CUES}), t as (select doc_id, (n_chars % 700)::double as t from documents) select t.doc_id as file_id, t, round(coalesce((select max(start) from c where c.doc_id = t.doc_id and start <= t), (select min(start) from c where c.doc_id = t.doc_id)), 6) as start from t")
def cue_at_time(spark, sf_dir):
    times = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), (F.col("n_chars") % 700).cast("double").alias("t"))
    return S.cue_at_time(_cues(spark, sf_dir), times).select("file_id", "t", F.round("start", 6).alias("start"))


_LATEST = f"{WITH}, late as (select asset_id, path, height, size_bytes from (select *, row_number() over (partition by asset_id order by scanned_at desc, id) as n from files) where n = 1)"


@query(f"{_LATEST} select case height when 480 then '480p' when 720 then '720p' when 1080 then '1080p' when 1440 then '1440p' when 2160 then '4K' else 'downscaled' end as token, count(*) as n_assets from late group by 1")
def resolution_buckets(spark, sf_dir):
    return Z.resolution_buckets(catalog(spark, sf_dir).files)


_PLAN = f"{_LATEST}, plan as (select a.id as asset_id, coalesce(height <= 720, true) as would_skip, case when height > 720 then cast(floor(size_bytes * (1 - greatest(pow(720.0::double / height, 2), 0.2))) as bigint) else 0 end as bytes_saved from assets a left join late on late.asset_id = a.id)"


@query(f"{_PLAN}, named as (select asset_id as a, regexp_replace(split_part(path, chr(92), 4), '^clip (480|720|1080|1440|2160|4320) ', 'clip 720p ') as new_name from late) select asset_id, would_skip, bytes_saved, new_name from plan left join named on a = asset_id")
def downscale_plan(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return Z.downscale_plan(c.assets, c.files, 720).select("asset_id", "would_skip", "bytes_saved", "new_name")


@query(f"{_PLAN} select count(*) filter (where not would_skip) as would_transcode, count(*) filter (where would_skip) as would_skip, sum(bytes_saved)::bigint as bytes_saved from plan")
def downscale_totals(spark, sf_dir):
    c = catalog(spark, sf_dir)
    return Z.plan_totals(Z.downscale_plan(c.assets, c.files, 720))


@query(f"{WITH}, t as (select asset_id, case when tag_id = 'PROMO' then '4K' else tag_id end as tag_id from asset_tags), gone as (select asset_id from t where tag_id = '4K' and asset_id % 2 = 0) select asset_id, tag_id from t where not (tag_id = '4K' and asset_id % 2 = 0) union select asset_id, '1080p' from gone")
def swap_resolution_tags(spark, sf_dir):
    c = catalog(spark, sf_dir)
    named = lambda col: F.when(F.col(col) == "PROMO", "4K").otherwise(F.col(col))
    tags = c.tags.select(named("id").alias("id"), named("name").alias("name"))
    links, new = Z.swap_resolution_tags(c.asset_tags.select("asset_id", named("tag_id").alias("tag_id")), tags, c.assets.where("id % 2 = 0").select("id"), 1080)
    return links.join(F.broadcast(new.select(F.col("id").alias("__n"), "name")), F.col("tag_id") == F.col("__n"), "left").select("asset_id", F.coalesce("name", "tag_id").alias("tag_id"))


QUERIES, ORACLE_SQL = query.queries, query.sql
