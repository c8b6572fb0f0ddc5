"""What a downscale to a target height would do to the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.resolution import canonical_token, is_resolution_token, rewrite_resolution
from ..operators.files import latest_file
from ..operators.identify import resolve_names

#: Least share of a file's bytes that is left.
LEAST_SHARE = 0.2


def resolution_buckets(files: DataFrame) -> DataFrame:
    """Assets of each canonical resolution of their latest file; a null height is unknown."""
    return latest_file(files).groupBy(canonical_token(F.col("height")).alias("token")).agg(F.count("*").alias("n_assets"))


def downscale_plan(assets: DataFrame, files: DataFrame, target: int, mode: str = "replace") -> DataFrame:
    """Per asset of ``assets`` (id): whether it would be skipped (no file, unknown or no greater height), its new file name (null without a file), and the bytes saved."""
    f = latest_file(files).select(F.col("asset_id").alias("__a"), "path", "height", "size_bytes")
    j = assets.select(F.col("id").alias("asset_id")).join(f, F.col("asset_id") == F.col("__a"), "left")
    skip = F.col("__a").isNull() | F.coalesce(F.col("height") <= target, F.lit(True))
    share = F.greatest(F.pow(F.lit(float(target)) / F.col("height"), 2), F.lit(LEAST_SHARE))
    name = rewrite_resolution(F.regexp_extract("path", r"([^\\/]*)$", 1), mode, target)
    return j.select("asset_id", "height", skip.alias("would_skip"), name.alias("new_name"), F.when(~skip, F.floor(F.col("size_bytes") * (1 - share))).otherwise(0).cast("long").alias("bytes_saved"))


def plan_totals(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count_if(~F.col("would_skip")).alias("would_transcode"), F.count_if("would_skip").alias("would_skip"), F.coalesce(F.sum("bytes_saved"), F.lit(0)).alias("bytes_saved"))


def swap_resolution_tags(asset_tags: DataFrame, tags: DataFrame, assets: DataFrame, target: int, mode: str = "swap") -> tuple[DataFrame, DataFrame]:
    """Links without resolution tags of the assets (id), and with the target's when swapping; and the tags to be added."""
    none = tags.select(F.col("id").cast("string").alias("id"), "name").limit(0)
    if mode == "leave":
        return asset_tags, none
    stale = tags.where(is_resolution_token(F.col("name"))).select(F.col("id").alias("__t"))
    chosen = assets.select(F.col("id").alias("__a"))
    of_chosen = asset_tags.join(chosen, F.col("asset_id") == F.col("__a"), "left_semi")
    gone = of_chosen.join(stale, F.col("tag_id") == F.col("__t"), "left_semi").select("asset_id", "tag_id")
    kept = asset_tags.join(gone, ["asset_id", "tag_id"], "left_anti").select("asset_id", F.col("tag_id").cast("string").alias("tag_id"))
    if mode == "remove":
        return kept, none
    name = assets.sparkSession.range(1).select(canonical_token(F.lit(target)).alias("name"))
    named, new = resolve_names(name, tags, "tags")
    add = gone.select("asset_id").distinct().crossJoin(F.broadcast(named.select(F.col("dim_id").alias("tag_id"))))
    return kept.unionByName(add).distinct(), new
