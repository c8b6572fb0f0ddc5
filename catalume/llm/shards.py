"""Shards cut from a Hilbert curve over document metadata, for file pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import checkpointed

#: Bits of each dimension; the curve index has three times as many.
BITS = 8
#: Distinct values of a dimension up to which their cells are broadcast.
FEW_VALUES = 100_000


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of axes (n x dimensions, values below 2 ** bits).

    Skilling's transform (AIP Conference Proceedings 707, 2004), for all rows at once.
    """
    x = axes.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def ranked_cells(docs: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """(value, cell) of the distinct values of a column: their ranks, spread over so many bits, so that
    neighbouring cells are neighbouring values. Null comes first.

    Values are sorted over all partitions; one count of each partition reaches the driver.
    """
    values = docs.select(F.col(column).cast("string").alias("value")).distinct()
    kept = checkpointed(values.repartitionByRange("value").sortWithinPartitions("value").withColumn("__id", F.monotonically_increasing_id()))
    kept = kept.withColumn("__part", F.shiftright("__id", 33)).withColumn("__nth", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    before, n = [], 0
    for s in kept.groupBy("__part").count().orderBy("__part").collect():
        before.append((s["__part"], n))
        n += s["count"]
    offsets = docs.sparkSession.createDataFrame(before, "__p long, __before long")
    rank = F.col("__before") + F.col("__nth")
    cell = F.floor(rank * (1 << bits) / F.lit(max(n, 1))) if n > 1 << bits else rank * ((1 << bits) // max(n, 1))
    return kept.join(F.broadcast(offsets), F.col("__part") == F.col("__p")).select("value", cell.cast("int").alias("cell"))


def size_cell(size: Column, bits: int = BITS) -> Column:
    """Eight steps for each doubling of the size, so that files differ in it."""
    return F.least(F.floor(F.log2(size.cast("double")) * 8), F.lit((1 << bits) - 1)).cast("int")


def _placed(rows: DataFrame, docs: DataFrame, column: str, name: str, bits: int) -> DataFrame:
    cells = ranked_cells(docs, column, bits)
    cells = cells.select(F.col("value").alias(f"__{name}"), F.col("cell").alias(name))
    if cells.count() <= FEW_VALUES:
        cells = F.broadcast(cells)
    return rows.join(cells, F.col(column).eqNullSafe(F.col(f"__{name}"))).drop(f"__{name}")


def hilbert_shards(docs: DataFrame, shards: int = 16, law: str = "rows", bits: int = BITS) -> DataFrame:
    """Per row of ``docs``: doc_id, size (UTF-8 bytes and 1), text_crc32, curve (Hilbert index over the ranks of
    language and source and the size), law, shard, slot (its place in the shard, from 0).

    Runs of the curve are cut at equal counts (law ``rows``, at most one apart) or at equal bytes
    (``bytes``). docs: doc_id, text, lang, source; other columns are ignored. Null and empty texts
    have size 1; null lang or source is a cell of its own; ties on the curve go by checksum, size and doc_id,
    so equal texts of a cell are neighbours and any rows left equal are interchangeable. An empty
    table gives an empty result; with fewer rows than shards some shards are empty.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(curve=hilbert_index(rows[["a", "b", "c"]].to_numpy(), bits))[["doc_id", "size", "text_crc32", "curve"]]

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    cells = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[F.col(c).cast("string").alias(c) for c in ("lang", "source")])
    cells = checkpointed(cells)
    cells = _placed(_placed(cells, cells, "lang", "a", bits), cells, "source", "b", bits)
    cells = cells.withColumn("c", size_cell(F.col("size"), bits)).mapInPandas(place, "doc_id long, size long, text_crc32 long, curve long")
    order = ["curve", "text_crc32", "size", "doc_id"]
    # A sorted range of rows in each partition, kept, so that numbers given in it stay.
    ranges = checkpointed(checkpointed(cells).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    ranges = ranges.withColumn("__part", F.shiftright("__id", 33)).withColumn("__nth", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    return _cut(ranges, shards, law)


def _cut(ranges: DataFrame, shards: int, law: str) -> DataFrame:
    """Number all rows through, from the sums of the partitions before each, and cut."""
    sums = ranges.groupBy("__part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).orderBy("__part").collect()
    rows, total = sum(s["n"] for s in sums), sum(s["bytes"] for s in sums)
    starts, n, b = [], 0, 0
    for s in sums:  # one for each partition
        starts.append((s["__part"], n, b))
        n, b = n + s["n"], b + s["bytes"]
    before = ranges.sparkSession.createDataFrame(starts or [(0, 0, 0)], "__p long, __rows long, __bytes long")
    placed = ranges.join(F.broadcast(before), F.col("__part") == F.col("__p")).withColumn("__rank", F.col("__rows") + F.col("__nth"))
    if law == "rows":
        cut = [-(-rows * k // shards) for k in range(shards + 1)]
        shard = F.expr(f"cast((__rank * {shards}L) div {max(rows, 1)}L as int)")
        first = F.element_at(F.array(*[F.lit(c).cast("long") for c in cut]), F.col("shard") + 1)
        placed = placed.withColumn("shard", shard).withColumn("slot", F.col("__rank") - first)
    else:
        from pyspark.sql.window import Window

        run = F.sum("size").over(Window.partitionBy("__part").orderBy("__nth").rowsBetween(Window.unboundedPreceding, -1))
        placed = placed.withColumn("__at", F.col("__bytes") + F.coalesce(run, F.lit(0))).withColumn("shard", F.expr(f"cast((cast(__at as decimal(38,0)) * {shards}) div {max(total, 1)}L as int)"))
        firsts = placed.groupBy("shard").agg(F.min("__rank").alias("__first")).withColumnRenamed("shard", "__shard")
        placed = placed.join(F.broadcast(firsts), F.col("shard") == F.col("__shard")).withColumn("slot", F.col("__rank") - F.col("__first"))
    return placed.select("doc_id", "size", "text_crc32", "curve", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def zone_map(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Per shard its rows and the least and greatest value of each column, by which a reader prunes files; nulls have
    no part in either, and an empty table gives no rows."""
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def write_shards(docs: DataFrame, sharded: DataFrame, path: str) -> None:
    """Write ``docs`` as one folder of files per shard, each file a run of slots in their order; columns shard and
    slot that docs has are replaced. doc_ids must be distinct and none null, as rows are found by them; an empty table writes no file."""
    where = sharded.select(F.col("doc_id").alias("doc"), "shard", "slot")
    packed = docs.select(F.struct(*[c for c in docs.columns if c.lower() not in ("shard", "slot")]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    rows = packed.join(where, F.col("id") == F.col("doc")).select("row.*", "shard", "slot")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
