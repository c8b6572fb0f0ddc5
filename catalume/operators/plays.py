"""Plays from playback samples, and change logs merged into assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.plays import cooldown_size, watch_threshold

#: A longer step between two samples is a seek, not watching.
LONGEST_STEP = 2.0


def forward_watch_time(samples: DataFrame) -> DataFrame:
    """Per load_id the seconds watched: steps forward of at most two seconds between consecutive samples that play.

    samples: load_id, asset_id, ts, pos, paused, eof, duration. A null position breaks the run; a paused sample is the base of no step.
    Samples go by time, position and paused, the paused one last; the sum is rounded to the microsecond.
    """
    order = Window.partitionBy("load_id").orderBy("ts", "pos", "paused")
    before = lambda c: F.lag(c).over(order)
    step = F.col("pos") - before("pos")
    counted = ~F.col("paused") & ~F.coalesce(before("paused"), F.lit(True)) & (step > 0) & (step <= LONGEST_STEP)
    return samples.withColumn("__step", F.when(counted, step).otherwise(0.0)).groupBy("load_id").agg(F.min("asset_id").alias("asset_id"), F.round(F.sum("__step"), 6).alias("watched"), F.max("duration").alias("duration"), F.max("ts").alias("ts"), F.max(F.coalesce("eof", F.lit(False))).alias("eof"))


def play_events(samples: DataFrame) -> DataFrame:
    """One play for each load that was watched long enough or reached its end."""
    w = forward_watch_time(samples)
    return w.where((F.col("watched") >= watch_threshold(F.col("duration"))) | F.col("eof")).select("load_id", "asset_id", "ts")


def recent_plays_cooldown(play_log: DataFrame, n_assets: int | Column) -> DataFrame:
    """Per session the assets played last, as many as rest among n assets."""
    n = F.lit(n_assets) if isinstance(n_assets, int) else n_assets
    last = play_log.groupBy("session_id", "asset_id").agg(F.max("ts").alias("ts"))
    nth = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ts"), "asset_id"))
    return last.withColumn("nth", nth).where(F.col("nth") <= cooldown_size(n)).select("session_id", "asset_id", "nth")


def apply_play_log(assets: DataFrame, play_log: DataFrame) -> DataFrame:
    """Assets with their plays counted and the last one noted."""
    p = play_log.groupBy(F.col("asset_id").alias("__a")).agg(F.count("*").alias("__n"), F.max("ts").alias("__ts"))
    j = assets.join(p, F.col("id") == F.col("__a"), "left")
    return j.withColumn("play_count", F.col("play_count") + F.coalesce("__n", F.lit(0))).withColumn("last_played_at", F.greatest("last_played_at", "__ts")).select(*assets.columns)


def apply_favorites(assets: DataFrame, changes: DataFrame) -> DataFrame:
    """Assets with the latest favorite of a change log (asset_id, ts, favorite), held to 0..5."""
    c = changes.groupBy(F.col("asset_id").alias("__a")).agg(F.max_by("favorite", F.struct("ts", "favorite")).alias("__f"))
    value = F.greatest(F.lit(0), F.least(F.lit(5), F.col("__f")))
    return assets.join(c, F.col("id") == F.col("__a"), "left").withColumn("favorite", F.coalesce(value, F.col("favorite")).cast("int")).select(*assets.columns)


def apply_edits(assets: DataFrame, edits: DataFrame) -> DataFrame:
    """Assets with the latest title and details of a change log (asset_id, ts, field, value), marked as manual."""
    last = edits.groupBy(F.col("asset_id").alias("__a")).agg(*[F.max_by(F.when(F.col("field") == f, F.struct("value")), F.when(F.col("field") == f, F.col("ts"))).alias(f"__{f}") for f in ("title", "details")])
    out = assets.join(last, F.col("id") == F.col("__a"), "left")
    for f in ("title", "details"):
        edited = F.col(f"__{f}").isNotNull()
        out = out.withColumn(f, F.when(edited, F.col(f"__{f}")["value"]).otherwise(F.col(f)))
        if f"{f}_source" in assets.columns:
            out = out.withColumn(f"{f}_source", F.when(edited, "manual").otherwise(F.col(f"{f}_source")))
    return out.select(*assets.columns)
