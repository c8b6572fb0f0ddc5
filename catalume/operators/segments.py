"""Segments of assets, and preview cues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A cue for so many seconds, and the most cues; the sprite's columns and cell.
SECONDS, MOST_CUES, COLUMNS, WIDTH, HEIGHT = 30, 36, 5, 160, 90


def upsert_segments(segments: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments with the valid changes merged by id, and the changes that are invalid.

    Valid: a finite start from 0 on, an end that is null or finite and not before it. Labels are trimmed, a null one is
    empty; an empty link is null. Of several valid changes of one id the greatest by start, end and the rest counts.
    """
    start, end = F.col("start_sec"), F.col("end_sec")
    ok = F.coalesce(~F.isnan(start) & (start >= 0) & (start < float("inf")) & (end.isNull() | (~F.isnan(end) & (end < float("inf")) & (end >= start))), F.lit(False))
    blank = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)).alias(c)
    columns = ["id", "asset_id", "start_sec", "end_sec", "label", "tag_id", "person_id"]
    good = changes.where(ok).select("id", "asset_id", "start_sec", "end_sec", F.trim(F.coalesce("label", F.lit(""))).alias("label"), blank("tag_id"), blank("person_id"))
    good = good.groupBy("id").agg(F.max(F.struct(*columns[1:])).alias("s")).select("id", "s.*")
    old = segments.select(*columns).join(good.select(F.col("id").alias("__id")), F.col("id") == F.col("__id"), "left_anti")
    return old.unionByName(good), changes.where(~ok)


def segments_list(segments: DataFrame) -> DataFrame:
    return segments.orderBy("asset_id", "start_sec", "id")


def cue_plan(files: DataFrame) -> DataFrame:
    """Per file the cues of its preview: start, end, and the sprite cell each shows; files without duration have none."""
    n = F.least(F.lit(MOST_CUES), F.greatest(F.lit(1), F.floor(F.col("duration") / SECONDS))).cast("int")
    rows = files.where("duration > 0").select(F.col("id").alias("file_id"), "duration", n.alias("n")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda i: (i + 0.5) / F.col("n") * F.col("duration")
    end = F.when(F.col("i") == F.col("n") - 1, F.col("duration")).otherwise(at(F.col("i") + 1))
    return rows.select("file_id", "i", at(F.col("i")).alias("start"), end.alias("end"), (F.col("i") % COLUMNS * WIDTH).cast("int").alias("x"), (F.floor(F.col("i") / COLUMNS) * HEIGHT).cast("int").alias("y"), F.lit(WIDTH).alias("w"), F.lit(HEIGHT).alias("h"))


def cue_at_time(cues: DataFrame, times: DataFrame) -> DataFrame:
    """times (file_id, t) with the cue (start, x, y) that covers each; past the last start the last, before the first the first, null without cues.

    One pass: the last cue that has started, by a window over cues and times of a file together.
    """
    first = cues.groupBy(F.col("file_id").alias("__f")).agg(F.min_by(F.struct("start", "x", "y"), "start").alias("__first"))
    both = cues.select("file_id", F.col("start").alias("at"), F.struct("start", "x", "y").alias("cue"), F.lit(0).alias("kind")).unionByName(times.select("file_id", F.col("t").alias("at"), F.lit(None).cast("struct<start:double,x:int,y:int>").alias("cue"), F.lit(1).alias("kind")))
    upto = Window.partitionBy("file_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("seen", F.last("cue", ignorenulls=True).over(upto)).where("kind = 1")
    found = F.coalesce("seen", "__first")
    return seen.join(first, F.col("file_id") == F.col("__f"), "left").select("file_id", F.col("at").alias("t"), found["start"].alias("start"), found["x"].alias("x"), found["y"].alias("y"))
