"""Inventory and identification from end to end, composed of their operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..cluster import checkpointed
from ..operators import identify as I
from ..operators import inventory as V
from ..operators.files import representative_file


def _ids_as_text(catalog: Catalog) -> Catalog:
    text = {"assets": ("id",), "files": ("id", "asset_id"), "fingerprints": ("file_id",)}
    return catalog.but(**{t: getattr(catalog, t).withColumns({c: F.col(c).cast("string") for c in columns}) for t, columns in text.items()})


def _padded(rows: DataFrame, like: DataFrame) -> DataFrame:
    """rows with the columns of ``like``, null where they have none."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def scan(catalog: Catalog, listing: DataFrame, roots: DataFrame, now: Column, complete: bool = True) -> tuple[Catalog, DataFrame]:
    """The catalog after a listing (path, size, mtime, oshash) of all roots, and found, added, updated, removed.

    Only new and changed files need an oshash. A new file joins the asset that has its hash, also when that
    asset's own file is gone in the same listing; new files with one new hash share an asset. Changed files
    lose their content hashes. Files that aren't listed go, unless the listing isn't complete or their root
    (path, accessible) is offline; assets left without file go with all that hangs on them.
    """
    catalog = _ids_as_text(catalog)
    # Four outputs follow from the diff, which is joined once.
    diff = checkpointed(V.inventory_diff(listing, catalog.files, complete))
    gone = V.protect_offline_roots(diff.where("status = 'removed'"), roots)
    added = V.detect_moves(diff.where("status = 'added'").select("path", "size", "mtime", "oshash"), catalog.fingerprints, catalog.files)
    # Files, fingerprints, assets and orphans all follow from the new files.
    new = checkpointed(added.select(F.sha2(F.concat_ws("|", F.lit("file"), "path"), 256).alias("id"), "asset_id", "path", F.col("size").alias("size_bytes"), F.col("mtime").alias("modified_at"), now.alias("scanned_at"), "oshash", "known"))
    changed = diff.where("status = 'updated'").select("file_id", "oshash", F.col("size").alias("__size"), F.col("mtime").alias("__mtime"))
    files = catalog.files.join(gone.select(F.col("file_id").alias("__gone")), F.col("id") == F.col("__gone"), "left_anti")
    files = files.join(changed.select(F.col("file_id").alias("__f"), "__size", "__mtime"), F.col("id") == F.col("__f"), "left")
    hit = F.col("__f").isNotNull()
    files = files.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in (("size_bytes", F.col("__size")), ("modified_at", F.col("__mtime")), ("scanned_at", now))}).select(*catalog.files.columns)
    prints = V.invalidate_fingerprints(catalog.fingerprints.join(gone.select(F.col("file_id").alias("__gone")), F.col("file_id") == F.col("__gone"), "left_anti"), changed.select("file_id", "oshash"))
    prints = V.upsert_fingerprints(prints, new.where("oshash is not null").select(F.col("id").alias("file_id"), F.lit("oshash").alias("hash_type"), F.col("oshash").alias("value")))
    fresh = new.where("not known").select(F.col("asset_id").alias("id")).distinct().withColumns({"favorite": F.lit(0), "play_count": F.lit(0), "created_at": now})
    assets = catalog.assets.unionByName(_padded(fresh, catalog.assets))
    after = catalog.but(files=files.unionByName(_padded(new, catalog.files)), fingerprints=prints, assets=assets)
    summary = V.scan_summary(diff.where("status != 'removed'").unionByName(gone))
    if not complete:
        return after, summary
    orphans = checkpointed(assets.select("id").join(after.files.select(F.col("asset_id").alias("__a")), F.col("id") == F.col("__a"), "left_anti"))
    # No file, and so no fingerprint, is an orphan's.
    return V.delete_assets(after.but(files=None, fingerprints=None), orphans).but(files=after.files, fingerprints=after.fingerprints), summary


def identify(catalog: Catalog, prints: DataFrame, records: DataFrame, providers: DataFrame, now: Column, days: int = 0, auto: bool = True) -> tuple[Catalog, DataFrame]:
    """The catalog after a round of identification, and its totals (assets, matched, applied, review).

    prints: provider_id, remote_id, hash_type, value; records: provider_id, remote_id, title, code, details,
    duration, studio, people, tags, images; providers: provider_id, rank, 0 for the active one. Assets that are due
    are matched by the hashes of their representative file with the first provider that has any match, else by
    text with the active one. Rejected and implausible records fall away; with ``auto`` a single one left is applied.
    """
    wanted = I.due_assets(catalog.assets, now, days).select("id", "title")
    # Files of other assets are left out before those of one are compared; all that follows reads what is due once.
    held = catalog.files.select("id", "asset_id", "path", "duration", "scanned_at").join(wanted.select(F.col("id").alias("__d")), F.col("asset_id") == F.col("__d"), "left_semi")
    file = representative_file(held).select(F.col("id").alias("file_id"), "asset_id", "path", "duration")
    pending = checkpointed(file.join(wanted, F.col("asset_id") == F.col("id")))
    due, rep = pending.select("id", "title"), pending.select(F.col("file_id").alias("id"), "asset_id", "path", "duration")
    reused = V.reuse_phash_by_oshash(catalog.fingerprints).select("file_id", F.lit("phash").alias("hash_type"), "value")
    key = [F.lower("hash_type").alias("hash_type"), F.lower("value").alias("value")]
    own = catalog.fingerprints.select("file_id", "hash_type", "value").unionByName(reused).select("file_id", *key)
    local = own.join(rep.select(F.col("id").alias("file_id"), "asset_id"), "file_id").select("asset_id", "hash_type", "value")
    hits = local.join(prints.select("provider_id", "remote_id", *key), ["hash_type", "value"]).select("asset_id", "provider_id", "remote_id").distinct()
    first = checkpointed(I.provider_waterfall(hits, providers).select("asset_id", "provider_id", "remote_id"))
    active = providers.where("rank = 0").select("provider_id")
    searched = I.title_search_fallback(I.search_terms(due.join(first.select(F.col("asset_id").alias("__m")), F.col("id") == F.col("__m"), "left_anti"), rep), first, records.join(F.broadcast(active), "provider_id", "left_semi"))
    text = searched.select("asset_id", "remote_id").crossJoin(F.broadcast(active)).select("asset_id", "provider_id", "remote_id")
    # Both are read several times below.
    raw = checkpointed(first.unionByName(text))
    length = rep.select(F.col("asset_id").alias("__a"), F.col("duration").alias("__own"))
    left = I.drop_rejected(raw, catalog.rejected_matches).join(records, ["provider_id", "remote_id"]).join(length, F.col("asset_id") == F.col("__a"))
    left = checkpointed(left.where(I.duration_plausible(F.col("__own"), F.col("duration"))).drop("__a", "__own"))
    outcome = checkpointed(I.identify_outcome(due, raw, left, auto))
    chosen = checkpointed(left.join(outcome.where("outcome = 'applied'").select(F.col("asset_id").alias("__x")), F.col("asset_id") == F.col("__x"), "left_semi"))
    checked = catalog.but(assets=I.record_checks(catalog.assets, due.select(F.col("id").alias("asset_id")), raw, now))
    return I.apply_matches(checked, chosen, now), I.outcome_totals(outcome)
