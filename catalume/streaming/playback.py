"""Streams of playback samples, progress reports and listings."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.paths import normalize_path
from ..operators.inventory import inventory_diff
from ..operators.plays import LONGEST_STEP, apply_play_log
from ..store import CatalogStore

#: Milliseconds of event time without a sample after which a load's state is dropped.
IDLE_MS = 6 * 3600 * 1000


def _threshold(duration: float | None) -> float:
    return min(30.0, duration / 10) if duration and duration > 0 else 30.0


#: Loads are dealt by a hash to so many groups; a call, and a row of state, is for all loads of one. State can't be read with another number.
BUCKETS = 4096
_KEPT = np.dtype([("load", "i8"), ("named", "?"), ("watched", "f8"), ("last", "f8"), ("playing", "?"), ("sent", "?"), ("until", "i8")])
_NO_TIME = -(1 << 63)


def _watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: of each load of the bucket its id and whether it has one, seconds watched, last position or NaN, whether it
    was playing, play sent, and the event time in milliseconds up to which it is kept."""
    kept = {r[:2]: r[2:] for r in np.frombuffer(state.get[0], _KEPT).tolist()} if state.exists else {}
    now = state.getCurrentWatermarkMs()
    out = []
    if not state.hasTimedOut:
        rows = {c: v.to_numpy() for c, v in pd.concat(list(batches)).drop(columns="ts").items()}
        order = np.lexsort((rows["paused"], np.nan_to_num(rows["pos"]), ~np.isnan(rows["pos"]), rows["us"], rows["load"], rows["named"]))
        for load, named, asset, us, pos, paused, eof, duration in zip(*(rows[c][order].tolist() for c in ("load", "named", "asset", "us", "pos", "paused", "eof", "duration")), strict=True):
            watched, last, playing, sent, _ = kept.get((load, named), (0.0, math.nan, False, False, 0))
            # No comparison with NaN holds, so a null position is no step's end.
            if playing and paused != 1 and 0 < pos - last <= LONGEST_STEP:
                watched += pos - last
            if not sent and (eof or round(watched, 6) >= _threshold(None if math.isnan(duration) else duration)):
                sent = True
                out.append((load if named else None, asset, None if us == _NO_TIME else us))
            kept[load, named] = (watched, pos, paused != 1, sent, max(now, us // 1000) + IDLE_MS)
    kept = {k: v for k, v in kept.items() if v[-1] >= now}
    if kept:
        state.update((np.array([(*k, *v) for k, v in kept.items()], _KEPT).tobytes(),))
        state.setTimeoutTimestamp(min(v[-1] for v in kept.values()))
    else:
        state.remove()
    if out:
        loads, assets, times = zip(*out, strict=True)
        yield pd.DataFrame({"load_id": pd.array(loads, "Int64"), "asset_id": pd.array([None if a is None else int(a) for a in assets], "Int64"), "us": pd.array(times, "Int64")})


def play_event_stream(samples: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """A stream of plays from a stream of samples (load_id, asset_id, ts, pos, paused, eof, duration): one for each load at most.

    Samples of a load must come in the order of their time between batches; those later than the
    watermark are dropped. State is by load, packed in buckets of loads, so no user or asset is a hot key; a load's
    goes when the watermark has left the load behind by hours.
    """
    load = F.col("load_id").cast("long")
    dealt = samples.withWatermark("ts", lateness).select(
        F.pmod(F.xxhash64(load), F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.coalesce(load, F.lit(0)).alias("load"),
        load.isNotNull().alias("named"),
        # As text, since pandas would make longs beside a null inexact.
        F.col("asset_id").cast("string").alias("asset"),
        "ts",
        F.coalesce(F.unix_micros("ts"), F.lit(_NO_TIME)).alias("us"),
        F.col("pos").cast("double").alias("pos"),
        F.coalesce(F.col("paused").cast("int"), F.lit(-1)).alias("paused"),
        F.coalesce("eof", F.lit(False)).alias("eof"),
        F.col("duration").cast("double").alias("duration"),
    )
    plays = dealt.groupBy("bucket").applyInPandasWithState(_watch, "load_id long, asset_id long, us long", "loads binary", "append", GroupStateTimeout.EventTimeTimeout)
    return plays.select("load_id", "asset_id", F.timestamp_micros("us").alias("ts"))


def throttle(progress: DataFrame, interval_ms: int = 200) -> DataFrame:
    """progress (run_id, seq, ts, terminal, ...) with the reports that pass: of each run the first, then one an
    interval since the last that passed; terminal ones always pass and don't move the clock.

    Runs are read in order, part by part; only the clock of the run at hand is kept, however long it is.
    """
    def pass_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, last = None, None
        for rows in batches:
            keep = []
            for key, ts, terminal in zip(rows["run_id"], rows["ts"], rows["terminal"], strict=True):
                if key != run:
                    run, last = key, None
                due = last is None or (ts - last).total_seconds() * 1000 >= interval_ms
                keep.append(bool(terminal) or due)
                if due and not terminal:
                    last = ts
            yield rows[keep]

    return progress.repartition("run_id").sortWithinPartitions("run_id", "ts", "seq").mapInPandas(pass_on, progress.schema)


def latest_progress(progress: DataFrame) -> DataFrame:
    """The last report of each run; in a stream, in update mode."""
    return progress.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in progress.columns if c != "run_id"]), F.struct("ts", "seq")).alias("p")).select("run_id", "p.*")


def apply_play_stream(store: CatalogStore, stream: str = "plays") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merge plays into the store's assets. What a batch changes and that it is done are committed as one,
    so a batch that is retried, by this session or the next, counts once."""
    def merge(plays: DataFrame, batch: int) -> None:
        entry = store.entry()
        if batch > entry.streams.get(stream, -1):
            store.commit({"assets": apply_play_log(store.read(entry).assets, plays)}, stream, batch, on=entry)

    return merge


def incremental_inventory(listing: DataFrame, files: DataFrame, complete: bool) -> DataFrame:
    """The diff of a listing against the files; of a partial listing nothing counts as removed."""
    return inventory_diff(listing, files, complete)


LISTING = "path string, size long, mtime timestamp, oshash string, snapshot long, expected long"


def listing_stream(spark: SparkSession, folder: str, files_a_batch: int | None = None) -> DataFrame:
    """A stream of listings that arrive as Parquet files of any number and order: path, size, mtime, oshash, the number of
    the snapshot that a row belongs to, and how many paths that snapshot has, null where the lister does not know it yet."""
    reader = spark.readStream.schema(LISTING)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(folder)


def apply_listing_stream(store: CatalogStore, offline: DataFrame, now: Callable[[int], Column], stream: str = "listing", report: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over ``listing_stream``: scan listings into the store, files that are gone only behind a barrier.

    New and changed files of the newest snapshot are taken in with each batch. Its rows are staged beside the catalog
    until as many paths have come as it is expected to have; that batch scans the whole snapshot, and only then do files
    go that it does not list (but those under ``offline`` roots). A snapshot that breaks off, or lists more than it
    promised, removes nothing. Rows of a snapshot older than the newest seen are late and change nothing, so a removal by
    an older one never follows a newer one. The rows seen, the staged folders and the catalog are committed as one, so a
    retried batch, or a row that comes twice, changes nothing twice. ``report`` gets the summary of each batch.
    """
    from ..plans.workflows import scan

    def merge(listing: DataFrame, batch: int) -> None:
        entry = store.entry()
        if batch <= entry.streams.get(stream, -1):
            return
        newest = listing.agg(F.max("snapshot")).first()[0]
        if newest is None:
            return
        state = entry.snapshot
        if state and newest < state["number"]:
            store.commit({}, stream, batch, on=entry)
            return
        if not state or newest > state["number"]:
            state = {"number": newest, "expected": None, "rows": 0, "whole": False, "parts": []}
        part = store.stage(listing.where(F.col("snapshot") == newest).drop("snapshot"))
        rows = store.spark.read.parquet(part)
        n, expected = rows.agg(F.count("*"), F.max("expected")).first()
        parts = [*state["parts"], part]
        expected = max((e for e in (expected, state["expected"]) if e is not None), default=None)
        state = state | {"expected": expected, "rows": state["rows"] + n, "parts": parts}
        complete = False
        # Rows are counted first, as that costs nothing; only when they could be all are paths told apart.
        if not state["whole"] and expected is not None and state["rows"] >= expected:
            every = store.spark.read.parquet(*parts)
            complete = every.select(normalize_path(F.col("path"))).distinct().count() == expected
            rows = every if complete else rows
        catalog, summary = scan(store.read(entry), rows.drop("expected"), offline, now(batch), complete)
        if state["whole"] or complete:
            state |= {"whole": True, "parts": []}
        changed = [f.name for f in fields(catalog)] if complete else ["assets", "files", "fingerprints"]
        store.commit({t: getattr(catalog, t) for t in changed if getattr(catalog, t) is not None}, stream, batch, state, entry)
        if report:
            report(summary, batch)

    return merge
