"""Records from outside: provider responses, foreign catalogs, cues, saved views, scan runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plays import parse_vtt_time, vtt_time

_MATCH = "struct<id:string,title:string,code:string,details:string,duration:bigint,date:string,studio:struct<name:string>,tags:array<struct<name:string>>,performers:array<struct<performer:struct<name:string>>>,images:array<struct<url:string,width:int,height:int>>>"


def parse_candidates_json(df: DataFrame, column: str, key: str = "asset_id") -> DataFrame:
    """One row for each match of a nested response (a list of lists), the first of those with the same id."""
    rows = df.select(key, F.posexplode(F.from_json(F.col(column), f"array<array<{_MATCH}>>")).alias("i", "inner")).select(key, "i", F.posexplode("inner").alias("j", "m")).where("m.id is not null")
    # Dealt out first: else each task of the scan sorts all that its file part holds, as the aggregate of a struct sorts.
    dealt = rows.withColumn("remote_id", F.col("m.id")).repartition(key, "remote_id")
    first = dealt.groupBy(key, "remote_id").agg(F.min_by("m", F.struct("i", "j")).alias("m"))
    return first.select(key, "remote_id", "m.title", "m.code", "m.details", "m.duration", F.col("m.studio.name").alias("studio"), F.transform("m.performers", lambda p: p["performer"]["name"]).alias("people"), F.transform("m.tags", lambda t: t["name"]).alias("tags"), F.col("m.images").alias("images"))


def read_foreign_catalog(fingerprints: DataFrame, file_links: DataFrame, records: DataFrame, people: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remote_id, hash_type, value) and one row of metadata for each record, with sorted people and tags.

    fingerprints: file_id, hash_type, value; file_links: file_id, remote_id; records: remote_id, title, details, studio; people, tags: remote_id, name.
    """
    # Dealt out first: else each task of the scan holds and sorts the sets of all records in its part, and rows that lie by record are shuffled again.
    names = lambda df, c: df.repartition("remote_id").groupBy("remote_id").agg(F.sort_array(F.collect_set("name")).alias(c))
    none = F.array().cast("array<string>")
    meta = records.join(names(people, "people"), "remote_id", "left").join(names(tags, "tags"), "remote_id", "left")
    return fingerprints.join(file_links, "file_id").select("remote_id", "hash_type", "value"), meta.withColumns({c: F.coalesce(c, none) for c in ("people", "tags")})


def parse_cues(df: DataFrame, column: str, key: str = "file_id") -> DataFrame:
    """Cues of WebVTT text: key, start, end, x, y, w, h; a timing line whose next line has no cell is left out."""
    clock = r"[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]+"
    pattern = rf"({clock})[ \t]*-->[ \t]*({clock})[^\n]*\n[^\n]*#xywh=([0-9]+),([0-9]+),([0-9]+),([0-9]+)"
    found = df.select(key, F.explode(F.regexp_extract_all(F.regexp_replace(column, "\r\n", "\n"), F.lit(pattern), F.lit(0))).alias("block"))
    part = lambda k: F.regexp_extract("block", pattern, k)
    cell = [part(k).cast("int").alias(c) for k, c in zip((3, 4, 5, 6), "xywh", strict=True)]
    return found.select(key, parse_vtt_time(part(1)).alias("start"), parse_vtt_time(part(2)).alias("end"), *cell)


def write_cues(cues: DataFrame, sprite: str = "sprite.jpg", key: str = "file_id") -> DataFrame:
    """WebVTT text of each file's cues, each named by its start."""
    line = F.concat(vtt_time(F.col("start")), F.lit("\n"), vtt_time(F.col("start")), F.lit(" --> "), vtt_time(F.col("end")), F.lit(f"\n{sprite}#xywh="), F.concat_ws(",", *[F.col(c).cast("string") for c in "xywh"]))
    ordered = F.sort_array(F.collect_list(F.struct(F.col("start"), line.alias("line"))))
    return cues.groupBy(key).agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(ordered, lambda s: s["line"]), "\n\n"), F.lit("\n")).alias("vtt"))


# The fields of a saved view as they are stored.
_VIEW = "search string, searchInverse boolean, sort string, minFavorite int, tagIds array<string>, excludeTagIds array<string>, tagMatchAny boolean, performerIds array<string>, excludePerformerIds array<string>, studioIds array<string>, excludeStudioIds array<string>, minDurationMins double, maxDurationMins double, unplayedOnly boolean, minTagCount int, identifiedOnly boolean, needsReviewOnly boolean, ignoreState string, folderPaths array<string>, minHeight int, minPerformerCount int"
#: Column of the parsed view for each stored field, by its kind.
_FLAGS = {"inverse": "searchInverse", "tags_any": "tagMatchAny", "unplayed_only": "unplayedOnly", "identified_only": "identifiedOnly", "needs_review_only": "needsReviewOnly"}
_NUMBERS = {"min_favorite": "minFavorite", "min_tags": "minTagCount", "min_people": "minPerformerCount", "min_height": "minHeight"}
_LISTS = {"tags": "tagIds", "exclude_tags": "excludeTagIds", "people": "performerIds", "exclude_people": "excludePerformerIds", "studios": "studioIds", "exclude_studios": "excludeStudioIds", "folders": "folderPaths"}


def parse_saved_view(df: DataFrame, name: str = "name", payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Saved views with a struct ``view``, and the rows without name or with a payload that is no JSON object.

    Missing fields are off: "", 0, false or empty. Durations are seconds; ignored is null (any), true or false.
    """
    parsed = df.withColumn("__ok", F.schema_of_variant(F.try_parse_json(F.col(payload))).startswith("OBJECT"))
    good = F.coalesce(F.col("__ok") & (F.trim(name) != ""), F.lit(False))
    v = F.from_json(F.col(payload), _VIEW)
    default = lambda fields, value: [F.coalesce(v[f], value).alias(c) for c, f in fields.items()]
    seconds = [(F.coalesce(v[f"{m}DurationMins"], F.lit(0.0)) * 60).alias(f"{m}_duration") for m in ("min", "max")]
    ignored = F.when(v["ignoreState"] == "ignored", True).when(v["ignoreState"] == "not_ignored", False).alias("ignored")
    texts = [F.coalesce(v["search"], F.lit("")).alias("search"), F.coalesce(v["sort"], F.lit("created")).alias("sort")]
    view = F.struct(*texts, *default(_FLAGS, F.lit(False)), *default(_NUMBERS, F.lit(0)), *default(_LISTS, F.array().cast("array<string>")), *seconds, ignored)
    return parsed.where(good).withColumn("view", view).drop("__ok"), parsed.where(~good).drop("__ok")


def append_scan_run(summary: DataFrame, path: str, run_id: str, status: str, started: Column, finished: Column) -> None:
    """Add one row to the log of scan runs."""
    row = summary.select(F.lit(run_id).alias("id"), F.lit(status).alias("status"), started.alias("started_at"), finished.alias("finished_at"), *[F.col(c).cast("long").alias(c) for c in ("found", "added", "updated", "removed")])
    row.write.mode("append").parquet(path)
