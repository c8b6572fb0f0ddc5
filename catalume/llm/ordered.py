"""Rows numbered through in a total order, and runs of equal keys inside a sorted partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import checkpointed

#: Salt of rows that are equal in the whole order, so that a group of copies is cut between partitions as well.
SALT = "__salt"


def numbered(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """df with the place of each row (from 0) in the order of the columns, nulls first; rows alike in all of them in any order.

    A range sort, kept; the driver gets one count of each partition. A group of equal rows may be cut anywhere.
    """
    salted = df.withColumn(SALT, F.monotonically_increasing_id())
    kept = checkpointed(salted.repartitionByRange(*order, SALT).sortWithinPartitions(*order, SALT).drop(SALT).withColumn("__id", F.monotonically_increasing_id()))
    kept = kept.withColumn("__part", F.shiftright("__id", 33)).withColumn("__nth", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    before, n = [], 0
    for s in sorted(kept.groupBy("__part").count().collect()):
        before.append((s["__part"], n))
        n += s["count"]
    offsets = df.sparkSession.createDataFrame(before, "__p long, __before long")
    placed = kept.join(F.broadcast(offsets), F.col("__part") == F.col("__p"))
    return placed.withColumn(name, F.col("__before") + F.col("__nth")).select(*df.columns, name)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of a sorted partition as one table for each run that is alike in the keys, none of which is null."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fresh = np.zeros(n, bool)
        for k in keys:
            c = batch.column(k)
            fresh[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(fresh).tolist(), n]
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(cuts[-2]))
    if held:
        yield pa.Table.from_batches(held)
