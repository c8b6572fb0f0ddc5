"""Which file stands for an asset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def representative_order(duration: Column, scanned_at: Column, id: Column) -> Column:
    """What sorts the file that stands for an asset before its others: longest, null last, then scanned first, then least id."""
    early = F.unix_micros(F.coalesce(scanned_at.cast("timestamp"), F.lit("9999-01-01").cast("timestamp")))
    return F.struct(_down(duration), early, id)


def representative_file(files: DataFrame) -> DataFrame:
    """Per asset the longest file; then the one scanned first, then the least id. Null durations come last.

    One aggregation with a partial step before the shuffle; structs compare field by field.
    """
    best = files.groupBy("asset_id").agg(F.min_by(F.struct(*files.columns), representative_order(F.col("duration"), F.col("scanned_at"), F.col("id"))).alias("__f"))
    return best.select("__f.*")


def _down(value: Column) -> Column:
    """A key that sorts a nullable double downwards with nulls last."""
    return F.struct(value.isNull().alias("n"), (-F.coalesce(value, F.lit(0.0))).alias("v"))


def latest_file(files: DataFrame) -> DataFrame:
    """Per asset the file scanned last; of several the least id."""
    late = -F.unix_micros(F.coalesce(F.col("scanned_at").cast("timestamp"), F.lit("0001-01-01").cast("timestamp")))
    return files.groupBy("asset_id").agg(F.min_by(F.struct(*files.columns), F.struct(late, F.col("id"))).alias("__f")).select("__f.*")
