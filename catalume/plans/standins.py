"""The catalog's tables made of the given ones, by expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..cluster import table

ASSETS = {
    "id": "o_orderkey",
    "title": "concat(o_orderpriority, ' order ', cast(o_orderkey as string))",
    "details": "concat('bought by customer ', cast(o_custkey as string))",
    "favorite": "cast(o_orderkey % 6 as int)",
    "play_count": "o_custkey % 4",
    "last_played_at": "case when o_custkey % 4 > 0 then o_orderdate end",
    "checked_at": "case when o_orderkey % 5 <> 0 then o_orderdate end",
    "match_count": "cast(o_orderkey % 3 as int)",
    "applied_at": "case when o_orderstatus = 'F' then o_orderdate end",
    "ignored_at": "case when o_orderkey % 11 = 0 then o_orderdate end",
    "studio_id": "case when o_custkey % 7 <> 0 then o_custkey % 25 end",
    "created_at": "o_orderdate",
}
FILES = {
    "id": "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string), cast(cast(round(l_extendedprice * 100) as bigint) as string), cast(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) as string))",
    "asset_id": "l_orderkey",
    "path": "concat('E:', chr(92), 'Lib ', l_returnflag, chr(92), l_linestatus, chr(92), 'clip ', cast(l_partkey as string), ' ', cast(l_linenumber as string), '.mp4')",
    "size_bytes": "cast(round(l_extendedprice * 1000) as bigint)",
    "duration": "l_extendedprice",
    "height": "cast(l_quantity as int) * 40",
    "width": "cast(l_quantity as int) * 70",
    "scanned_at": "l_shipdate",
}
TAGS = {"id": "p_type", "name": "p_type"}
PEOPLE = {"id": "s_suppkey", "name": "s_name"}
STUDIOS = {"id": "cast(n_nationkey as bigint)", "name": "n_name"}
COLLECTIONS = {"id": "c_custkey", "name": "c_name"}


def _select(columns: dict[str, str], source: str, distinct: bool = False) -> str:
    return f"select {'distinct ' * distinct}{', '.join(f'{e} as {n}' for n, e in columns.items())} from {source}"


#: The same tables as common table expressions for DuckDB.
WITH = (
    "with assets as (" + _select(ASSETS, "orders") + "), files as (" + _select(FILES, "lineitem") + "), tags as (" + _select(TAGS, "part", True) + "), people as (" + _select(PEOPLE, "supplier") + "), studios as (" + _select(STUDIOS, "nation") + "), collections as (" + _select(COLLECTIONS, "customer") + "), "
    "asset_tags as (select distinct l_orderkey as asset_id, p_type as tag_id from lineitem join part on l_partkey = p_partkey), asset_people as (select distinct l_orderkey as asset_id, l_suppkey as person_id from lineitem), "
    "items as (select o_custkey as collection_id, o_orderkey as asset_id, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as int) as position from orders), "
    "rep as (select * from (select *, row_number() over (partition by asset_id order by duration desc nulls last, scanned_at, id) as rn from files) where rn = 1)"
)


def _made(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{e} as {n}" for n, e in columns.items()])


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    from pyspark.sql.window import Window

    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem")
    links = lines.join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    nth = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).cast("int")
    return Catalog(
        assets=_made(t("orders"), ASSETS),
        files=_made(lines, FILES),
        tags=_made(t("part"), TAGS).distinct(),
        people=_made(t("supplier"), PEOPLE),
        studios=_made(t("nation"), STUDIOS),
        collections=_made(t("customer"), COLLECTIONS),
        asset_tags=links.select(F.col("l_orderkey").alias("asset_id"), F.col("p_type").alias("tag_id")).distinct(),
        asset_people=lines.select(F.col("l_orderkey").alias("asset_id"), F.col("l_suppkey").alias("person_id")).distinct(),
        collection_items=t("orders").select(F.col("o_custkey").alias("collection_id"), F.col("o_orderkey").alias("asset_id"), nth.alias("position")),
    )
