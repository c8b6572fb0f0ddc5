"""The catalog: its tables with fixed schemas, as DataFrames that operators take and return."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

#: Schemas of the stored tables. Ids are text; times are UTC.
SCHEMAS = {
    "assets": "id string, title string, details string, title_source string, details_source string, studio_id string, cover_path string, cover_source string, favorite int, play_count long, last_played_at timestamp, checked_at timestamp, match_count int, applied_at timestamp, ignored_at timestamp, remote_id string, created_at timestamp, updated_at timestamp",
    "files": "id string, asset_id string, path string, size_bytes long, modified_at timestamp, format_name string, duration double, width int, height int, codec string, fps double, bitrate long, thumb_path string, thumb_sprite_path string, vtt_path string, scanned_at timestamp",
    "fingerprints": "file_id string, hash_type string, value string, created_at timestamp",
    "tags": "id string, name string, parent_id string, created_at timestamp",
    "people": "id string, name string, aliases array<string>, image_path string, created_at timestamp",
    "studios": "id string, name string, aliases array<string>, image_path string, created_at timestamp",
    "asset_tags": "asset_id string, tag_id string",
    "asset_people": "asset_id string, person_id string",
    "collections": "id string, name string, shuffle_by_default boolean, created_at timestamp, updated_at timestamp",
    "collection_items": "collection_id string, asset_id string, position int, added_at timestamp",
    "segments": "id string, asset_id string, start_sec double, end_sec double, label string, tag_id string, person_id string, created_at timestamp, updated_at timestamp",
    "rejected_matches": "asset_id string, provider_id string, remote_id string, rejected_at timestamp",
    "saved_views": "id string, name string, payload string, created_at timestamp, updated_at timestamp",
    "roots": "id string, path string, label string, created_at timestamp",
    "scan_runs": "id string, status string, started_at timestamp, finished_at timestamp, found long, added long, updated long, removed long",
}


@dataclass(frozen=True)
class Catalog:
    """Any table may be missing; an operator that needs it says so."""

    assets: DataFrame | None = None
    files: DataFrame | None = None
    fingerprints: DataFrame | None = None
    tags: DataFrame | None = None
    people: DataFrame | None = None
    studios: DataFrame | None = None
    asset_tags: DataFrame | None = None
    asset_people: DataFrame | None = None
    collections: DataFrame | None = None
    collection_items: DataFrame | None = None
    segments: DataFrame | None = None
    rejected_matches: DataFrame | None = None
    saved_views: DataFrame | None = None
    roots: DataFrame | None = None
    scan_runs: DataFrame | None = None

    def but(self, **tables: DataFrame) -> Catalog:
        return replace(self, **tables)


def read_catalog(spark: SparkSession, path: str, tables: list[str] | None = None) -> Catalog:
    """The tables under ``path``, read with their schemas, so that a missing column is null and no schema is inferred."""
    return Catalog(**{t: spark.read.schema(SCHEMAS[t]).parquet(f"{path}/{t}") for t in tables or SCHEMAS})


def write_catalog(catalog: Catalog, path: str) -> None:
    """Write every table that is there. The target must not be what the tables are read from."""
    for f in fields(catalog):
        if (table := getattr(catalog, f.name)) is not None:
            table.write.mode("overwrite").parquet(f"{path}/{f.name}")
