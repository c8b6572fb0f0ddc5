"""Stored catalogs: versions, streams that stop and go on, and listings that arrive in parts."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catalume.operators.inventory import inventory_diff
from catalume.plans.workflows import scan
from catalume.store import CatalogStore, Conflict
from catalume.streaming import playback

from .test_operators import three_assets

T0 = datetime(2024, 1, 1)


def now(batch):
    return F.lit("2024-02-01").cast("timestamp")


def library(spark, n):
    """n files, each of an asset with a tag, in a catalog as it is stored."""
    files = spark.createDataFrame([(f"f{i}", f"a{i}", f"E:\\lib\\{i}.mp4", i, T0, T0) for i in range(n)], "id string, asset_id string, path string, size_bytes long, modified_at timestamp, scanned_at timestamp")
    assets = files.select(F.col("asset_id").alias("id"), F.lit(3).alias("favorite"), F.lit(0).cast("long").alias("play_count"), F.lit(T0).alias("created_at"), F.lit(None).cast("timestamp").alias("last_played_at"))
    prints = files.select(F.col("id").alias("file_id"), F.lit("oshash").alias("hash_type"), F.concat(F.lit("h"), "id").alias("value"))
    return {"files": files, "assets": assets, "fingerprints": prints, "asset_tags": files.select("asset_id", F.lit("t").alias("tag_id"))}


def rows_of(spark, ids, snapshot, expected, size=None):
    return spark.createDataFrame([(f"E:/lib/{i}.mp4", i if size is None else size, T0, f"hf{i}", snapshot, expected) for i in ids], playback.LISTING)


@pytest.fixture
def store(spark, tmp_path):
    s = CatalogStore(spark, str(tmp_path / "catalog"), 4)
    s.commit(library(spark, 8))
    return s


def state(store):
    c = store.read()
    return {r.path[7:-4]: (r.id, r.asset_id, r.size_bytes) for r in c.files.collect()}, {r.id for r in c.assets.collect()}, c.asset_tags.count()


def test_versions(spark, store):
    e = store.entry()
    assert e.version == 0 and store.read().files.count() == 8
    later = store.commit({"asset_tags": store.read().asset_tags.limit(2)}, on=e)
    assert later.version == 1 and later.tables["files"] == e.tables["files"]
    assert store.read().asset_tags.count() == 2 and store.read(e).asset_tags.count() == 8
    with pytest.raises(Conflict):
        store.commit({}, on=e)
    assert store.vacuum() == 1 and store.read().asset_tags.count() == 2
    with pytest.raises(ValueError, match="not tables"):
        store.commit({"nothing": store.read().assets})


def test_another_session_reads_buckets(spark, store):
    folder, buckets = store.entry().tables["files"]
    spark.sql(f"drop table `{store._name(folder)}`")
    files = CatalogStore(spark, store.path).read().files
    assert buckets == 4 and sorted(r.id for r in files.collect()) == [f"f{i}" for i in range(8)]
    one = files.where(F.col("path_key") == "E:\\lib\\5.mp4")
    assert one.first().id == "f5"
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        # Else the planner names no buckets for so small a scan, though it leaves them out as well.
        assert "SelectedBucketsCount: 1 out of 4" in files.where(F.col("path_key") == "E:\\lib\\5.mp4").select("id", "path_key")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_diff_leaves_stored_files_where_they_are(spark, store):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        diff = inventory_diff(rows_of(spark, range(2, 10), 1, 8), store.read().files)
        plan = diff._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and plan.count("Exchange") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    got = {r.path[7:-4]: r.status for r in diff.collect()}
    assert got == {**dict.fromkeys("01", "removed"), **dict.fromkeys("234567", "unchanged"), **dict.fromkeys("89", "added")}


def offline(spark, *roots):
    return spark.createDataFrame([(r, False) for r in roots], "path string, accessible boolean")


def test_whole_listing_in_two_batches_keeps_all(spark, store):
    before = state(store)
    merge = playback.apply_listing_stream(store, offline(spark), now)
    merge(rows_of(spark, range(4), 1, 8), 0)
    assert state(store) == before
    merge(rows_of(spark, range(4, 8), 1, 8), 1)
    assert state(store) == before and store.entry().snapshot["whole"]


def test_barrier_equals_one_scan(spark, store, tmp_path):
    """Five batches out of order, one delivered twice, one file listed twice, some files gone, changed and new."""
    listed = [i for i in range(12) if i % 3]
    whole = rows_of(spark, listed, 5, None).withColumn("size", F.when(F.col("oshash") == "hf4", 99).otherwise(F.col("size")).cast("long"))
    once, _ = scan(store.read(), whole.drop("snapshot", "expected"), offline(spark), now(0))
    want = {(r.path, r.id, r.asset_id, r.size_bytes) for r in once.files.collect()}
    merge = playback.apply_listing_stream(store, offline(spark), now)
    dealt = [listed[k::5] for k in (3, 0, 4, 1, 2)]
    counts = []
    for batch, ids in enumerate(dealt):
        rows = whole.where(F.col("oshash").isin(*[f"hf{i}" for i in ids])).withColumn("expected", F.lit(len(listed) if batch == 1 else None).cast("long"))
        rows = rows.unionByName(rows.limit(1))
        merge(rows, batch)
        merge(rows, batch)
        counts.append(store.read().files.count())
    assert counts[:4] == sorted(counts[:4]) and counts[3] > counts[4] == len(listed)
    assert {(r.path, r.id, r.asset_id, r.size_bytes) for r in store.read().files.collect()} == want
    assert {r.id for r in store.read().assets.collect()} == {r.id for r in once.assets.collect()}


def test_late_rows_of_an_older_snapshot(spark, store):
    merge = playback.apply_listing_stream(store, offline(spark), now)
    merge(rows_of(spark, range(3), 1, 3), 0)
    assert len(state(store)[0]) == 3
    merge(rows_of(spark, range(5), 3, 6), 1)
    merge(rows_of(spark, [0], 2, 1, size=77), 2)
    files, assets, tags = state(store)
    assert set(files) == set("01234") and files["0"][2] == 0 and len(assets) == 5 and tags == 3
    merge(rows_of(spark, [5], 3, 6), 3)
    assert set(state(store)[0]) == set("012345")


def test_broken_or_wrong_listings_remove_nothing(spark, store):
    merge = playback.apply_listing_stream(store, offline(spark), now)
    merge(rows_of(spark, range(3), 1, 8), 0)
    merge(rows_of(spark, range(3), 1, 8), 1)
    merge(rows_of(spark, range(3), 1, 8), 2)
    assert len(state(store)[0]) == 8
    merge(rows_of(spark, range(3), 2, 2), 3)
    assert len(state(store)[0]) == 8
    merge(rows_of(spark, [], 3, 0), 4)
    assert len(state(store)[0]) == 8


def test_offline_roots_keep_their_files(spark, store):
    playback.apply_listing_stream(store, offline(spark, "e:/lib"), now)(rows_of(spark, range(2), 1, 2), 0)
    assert len(state(store)[0]) == 8


def test_plays_count_once_whenever_a_session_stops(spark, tmp_path, monkeypatch):
    store = CatalogStore(spark, str(tmp_path / "c"))
    store.commit({"assets": three_assets(spark).assets})
    plays = spark.createDataFrame([("0", T0 + timedelta(days=d)) for d in range(3)], "asset_id string, ts timestamp")

    def stop(entry):
        raise OSError("killed between data and log")

    with monkeypatch.context() as m:
        m.setattr(store, "_log", stop)
        with pytest.raises(OSError, match="killed"):
            playback.apply_play_stream(store)(plays, 0)
    for _ in range(2):
        playback.apply_play_stream(CatalogStore(spark, store.path))(plays, 0)
    assert store.read().assets.where("id = '0'").first().play_count == 3
    assert store.seen("plays", 0) and not store.seen("plays", 1) and not store.seen("other", 0)
    assert store.vacuum() == 2
