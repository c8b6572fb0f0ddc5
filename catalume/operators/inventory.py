"""Incremental inventory: a file listing against the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.paths import PATH_KEY, is_under, normalize_path, path_and_above, root_key

#: Hashes that are kept of a file while its content stays.
CONTENT_HASHES = ("md5", "phash")
#: Roots that are broadcast at most.
FEW_ROOTS = 100


def inventory_diff(listing: DataFrame, files: DataFrame, removed: bool = True) -> DataFrame:
    """path and status (unchanged, updated, added, removed) with the old id and asset and the new size, time and, if listed, oshash.

    listing: path, size, mtime and maybe oshash; files: id, asset_id, path, size_bytes, modified_at. Paths meet in their normal
    form, which files of a store are bucketed by, so that these aren't shuffled; where several listed ones share it, the greatest
    size and time count. Without ``removed`` files that aren't listed are left out.
    """
    given = [c for c in ("size", "mtime", "oshash") if c in listing.columns]
    new = listing.groupBy(normalize_path(F.col("path")).alias("path")).agg(F.max(F.struct(*given)).alias("s"), F.lit(True).alias("__listed")).select("path", "s.*", "__listed")
    key = F.col(PATH_KEY) if PATH_KEY in files.columns else normalize_path(F.col("path"))
    old = files.select(key.alias("path"), F.col("id").alias("file_id"), "asset_id", "size_bytes", "modified_at")
    both = new.join(old, "path", "full_outer" if removed else "left")
    same = F.col("size").eqNullSafe(F.col("size_bytes")) & F.col("mtime").eqNullSafe(F.col("modified_at"))
    status = F.when(F.col("file_id").isNull(), "added").when(F.col("__listed").isNull(), "removed").when(same, "unchanged").otherwise("updated")
    return both.select("path", status.alias("status"), "file_id", "asset_id", *given)


def detect_moves(added: DataFrame, fingerprints: DataFrame, files: DataFrame) -> DataFrame:
    """added (path, oshash) with the asset each belongs to: one that has the hash, else a new one shared by
    all that have it, else one of its own. New ids follow from hash or path, so a retry gives the same."""
    known = fingerprints.where("hash_type = 'oshash'").join(files.select(F.col("id").alias("file_id"), "asset_id"), "file_id").groupBy(F.col("value").alias("oshash")).agg(F.min("asset_id").alias("__asset"))
    own = F.sha2(F.concat_ws("|", F.lit("asset"), F.coalesce("oshash", "path")), 256)
    return added.join(known, "oshash", "left").select(*added.columns, F.coalesce(F.col("__asset").cast("string"), own).alias("asset_id"), F.col("__asset").isNotNull().alias("known"))


def _by_root(files: DataFrame, roots: DataFrame, how: str) -> DataFrame:
    """Files joined (left_semi or left_anti) with the roots above them. A few roots are broadcast; more of them
    meet the folders above each file by equality, so that no file is compared with every root."""
    r = roots.select(F.col("path").alias("__root")).distinct()
    if r.count() <= FEW_ROOTS:
        return files.join(F.broadcast(r), is_under(F.col("path"), F.col("__root")), how)
    paths = files.select(F.col("path").alias("__path")).distinct()
    above = paths.select("__path", F.explode(path_and_above(F.col("__path"))).alias("__key"))
    below = above.join(r.select(root_key(F.col("__root")).alias("__key")).distinct(), "__key", "left_semi").select("__path").distinct()
    return files.join(below, F.col("path") == F.col("__path"), how)


def under_root(files: DataFrame, roots: DataFrame) -> DataFrame:
    """The files at or below any root (column path)."""
    return _by_root(files, roots, "left_semi")


def protect_offline_roots(removed: DataFrame, roots: DataFrame) -> DataFrame:
    """Removed files but those under a root that isn't accessible now."""
    return _by_root(removed, roots.where(~F.col("accessible")), "left_anti")


def upsert_fingerprints(fingerprints: DataFrame, changes: DataFrame) -> DataFrame:
    """One value for each (file_id, hash_type): the changed one, else the old one."""
    ranked = fingerprints.select("file_id", "hash_type", "value", F.lit(0).alias("__new")).unionByName(changes.select("file_id", "hash_type", "value", F.lit(1).alias("__new")))
    return ranked.groupBy("file_id", "hash_type").agg(F.max_by("value", F.struct("__new", "value")).alias("value"))


def invalidate_fingerprints(fingerprints: DataFrame, updated: DataFrame) -> DataFrame:
    """Without the content hashes of updated files (file_id, oshash) whose oshash is new or unknown; oshashes upserted."""
    old = fingerprints.where("hash_type = 'oshash'").select("file_id", F.col("value").alias("__old"))
    stale = updated.join(old, "file_id", "left").where(F.col("oshash").isNull() | ~F.col("oshash").eqNullSafe(F.col("__old"))).select("file_id")
    gone = fingerprints.where(F.col("hash_type").isin(*CONTENT_HASHES)).join(stale, "file_id", "left_semi").select("file_id", "hash_type")
    kept = fingerprints.join(gone, ["file_id", "hash_type"], "left_anti")
    return upsert_fingerprints(kept, updated.where("oshash is not null").select("file_id", F.lit("oshash").alias("hash_type"), F.col("oshash").alias("value")))


def prune_orphans(assets: DataFrame, files: DataFrame) -> DataFrame:
    """The assets that have a file."""
    return assets.join(files.select(F.col("asset_id").alias("__a")), F.col("id") == F.col("__a"), "left_semi")


def scan_summary(diff: DataFrame) -> DataFrame:
    """found, added, updated and removed files of a diff, in one row."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return diff.agg(F.count_if(F.col("status") != "removed").alias("found"), n("added"), n("updated"), n("removed"))


#: What hangs on an asset.
_OF_ASSET = ("files", "asset_tags", "asset_people", "collection_items", "segments", "rejected_matches")


def _without(df: DataFrame | None, key: str, ids: DataFrame) -> DataFrame | None:
    return None if df is None else df.join(ids.select(F.col(ids.columns[0]).alias("__gone")), F.col(key) == F.col("__gone"), "left_anti")


def _unset(df: DataFrame | None, key: str, ids: DataFrame) -> DataFrame | None:
    if df is None or key not in df.columns:
        return df
    gone = ids.select(F.col(ids.columns[0]).alias("__gone"), F.lit(True).alias("__hit")).distinct()
    return df.join(gone, F.col(key) == F.col("__gone"), "left").withColumn(key, F.when(F.col("__hit").isNull(), F.col(key))).drop("__gone", "__hit").select(*df.columns)


def delete_assets(catalog: Catalog, ids: DataFrame) -> Catalog:
    """Without the assets and all that hangs on them; ids has one column."""
    tables = {t: _without(getattr(catalog, t), "asset_id", ids) for t in _OF_ASSET}
    if catalog.fingerprints is not None and catalog.files is not None:
        files = catalog.files.join(ids.select(F.col(ids.columns[0]).alias("__gone")), F.col("asset_id") == F.col("__gone"), "left_semi").select("id")
        tables["fingerprints"] = _without(catalog.fingerprints, "file_id", files)
    return catalog.but(assets=_without(catalog.assets, "id", ids), **tables)


def delete_tags(catalog: Catalog, ids: DataFrame) -> Catalog:
    """Without the tags and their links; segments and child tags lose the reference."""
    return catalog.but(tags=_unset(_without(catalog.tags, "id", ids), "parent_id", ids), asset_tags=_without(catalog.asset_tags, "tag_id", ids), segments=_unset(catalog.segments, "tag_id", ids))


def delete_people(catalog: Catalog, ids: DataFrame) -> Catalog:
    return catalog.but(people=_without(catalog.people, "id", ids), asset_people=_without(catalog.asset_people, "person_id", ids), segments=_unset(catalog.segments, "person_id", ids))


def delete_studios(catalog: Catalog, ids: DataFrame) -> Catalog:
    return catalog.but(studios=_without(catalog.studios, "id", ids), assets=_unset(catalog.assets, "studio_id", ids))


def delete_root(catalog: Catalog, root: DataFrame) -> Catalog:
    """Without the root (column path), the files under it, and the assets that are left without file."""
    gone = under_root(catalog.files, root).select("id")
    files = _without(catalog.files, "id", gone)
    orphans = catalog.assets.select("id").join(files.select(F.col("asset_id").alias("__a")), F.col("id") == F.col("__a"), "left_anti")
    roots = None if catalog.roots is None else _without(catalog.roots, "path", root.select("path"))
    return delete_assets(catalog.but(files=files, roots=roots, fingerprints=_without(catalog.fingerprints, "file_id", gone)), orphans)


def missing_hash(files: DataFrame, fingerprints: DataFrame, kind: str) -> DataFrame:
    """Files without a hash of the kind, last scanned first; perceptual hashes need a positive duration."""
    have = fingerprints.where(F.col("hash_type") == kind).select(F.col("file_id").alias("__f"))
    out = files.join(have, F.col("id") == F.col("__f"), "left_anti")
    return (out.where("duration > 0") if kind == "phash" else out).orderBy(F.desc("scanned_at"), "id")


def missing_phash(files: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Files that need a perceptual hash, each with its oshash."""
    own = fingerprints.where("hash_type = 'oshash'").select(F.col("file_id").alias("__f"), F.col("value").alias("oshash"))
    return missing_hash(files, fingerprints, "phash").join(own, F.col("id") == F.col("__f"), "left").drop("__f")


def missing_previews(files: DataFrame) -> DataFrame:
    return files.where("duration is not null and thumb_path is null")


def reuse_phash_by_oshash(fingerprints: DataFrame) -> DataFrame:
    """(file_id, value): a perceptual hash for files without one, from any file with the same oshash (the least value)."""
    os = fingerprints.where("hash_type = 'oshash'").select("file_id", F.col("value").alias("oshash"))
    ph = fingerprints.where("hash_type = 'phash'").select("file_id", F.col("value").alias("phash"))
    by = os.join(ph, "file_id").groupBy("oshash").agg(F.min("phash").alias("value"))
    return os.join(ph, "file_id", "left_anti").join(by, "oshash").select("file_id", "value")


def drive_histogram(files: DataFrame) -> DataFrame:
    """Files of each volume."""
    from ..functions.paths import volume_key

    return files.select(volume_key(F.col("path")).alias("volume")).groupBy("volume").agg(F.count("*").alias("n_files"))


def repair_paths(files: DataFrame) -> DataFrame:
    """Files with normalised paths; one whose normal form another file has already stays as it is."""
    fixed = files.withColumn("__path", normalize_path(F.col("path")))
    taken = files.select(F.col("path").alias("__taken"), F.col("id").alias("__id"))
    first = fixed.where(F.col("__path") != F.col("path")).groupBy("__path").agg(F.min("id").alias("__first")).withColumnRenamed("__path", "__p")
    clash = fixed.where(F.col("__path") != F.col("path")).join(taken, F.col("__path") == F.col("__taken")).select(F.col("id").alias("__clash")).distinct()
    out = fixed.join(clash, F.col("id") == F.col("__clash"), "left").join(first, F.col("__path") == F.col("__p"), "left")
    free = F.col("__clash").isNull() & F.col("__first").eqNullSafe(F.col("id"))
    return out.withColumn("path", F.when(free, F.col("__path")).otherwise(F.col("path"))).select(*files.columns)
