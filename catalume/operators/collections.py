"""Collections: positions of their items, and weighted orders."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.plays import COOLED, cooldown_size, recency_multiplier


def collection_counts(collections: DataFrame, items: DataFrame, files: DataFrame) -> DataFrame:
    """Items of each collection whose asset has a file; those without items too."""
    n = items.join(files.select(F.col("asset_id").alias("__a")), F.col("asset_id") == F.col("__a"), "left_semi").groupBy("collection_id").agg(F.count("*").alias("n_items"))
    return collections.join(n, F.col("id") == F.col("collection_id"), "left").select(*collections.columns, F.coalesce("n_items", F.lit(0)).alias("n_items"))


def collection_assets(items: DataFrame, assets: DataFrame, representative: DataFrame) -> DataFrame:
    """A collection's assets by position with what the grid shows; those without file are left out."""
    file = representative.select(F.col("asset_id").alias("__a"), "path", "duration")
    return items.join(assets.select(F.col("id").alias("__id"), "title", "favorite"), F.col("asset_id") == F.col("__id")).join(file, F.col("asset_id") == F.col("__a")).drop("__id", "__a").orderBy("collection_id", "position")


def append_items(items: DataFrame, new: DataFrame) -> DataFrame:
    """items with the new ones (collection_id, asset_id, nth) behind, from position 0 in an empty collection; what is in already is left out."""
    known = items.select(F.col("collection_id").alias("__c"), F.col("asset_id").alias("__a"))
    fresh = new.join(known, (F.col("collection_id") == F.col("__c")) & (F.col("asset_id") == F.col("__a")), "left_anti").groupBy("collection_id", "asset_id").agg(F.min("nth").alias("nth"))
    last = items.groupBy(F.col("collection_id").alias("__c")).agg(F.max("position").alias("__last"))
    n = F.row_number().over(Window.partitionBy("collection_id").orderBy("nth", "asset_id"))
    placed = fresh.withColumn("__n", n).join(last, F.col("collection_id") == F.col("__c"), "left")
    return items.select("collection_id", "asset_id", "position").unionByName(placed.select("collection_id", "asset_id", (F.coalesce("__last", F.lit(-1)) + F.col("__n")).cast("int").alias("position")))


def compact_positions(items: DataFrame) -> DataFrame:
    """Positions 0, 1, 2 ... in the old order."""
    return items.withColumn("position", (F.row_number().over(Window.partitionBy("collection_id").orderBy("position", "asset_id")) - 1).cast("int"))


def reorder_items(items: DataFrame, submitted: DataFrame) -> DataFrame:
    """Items in the submitted order (collection_id, asset_id, nth from 0) first, the others behind in theirs; ids that aren't in leave gaps."""
    s = submitted.select(F.col("collection_id").alias("__c"), F.col("asset_id").alias("__a"), F.col("nth").alias("__nth"))
    n = submitted.groupBy(F.col("collection_id").alias("__of")).agg(F.count("*").alias("__n"))
    joined = items.join(s, (F.col("collection_id") == F.col("__c")) & (F.col("asset_id") == F.col("__a")), "left").join(n, F.col("collection_id") == F.col("__of"), "left")
    rest = F.row_number().over(Window.partitionBy("collection_id", F.col("__nth").isNull()).orderBy("position", "asset_id")) - 1
    return joined.withColumn("position", F.when(F.col("__nth").isNotNull(), F.col("__nth")).otherwise(F.coalesce("__n", F.lit(0)) + rest).cast("int")).select(*items.columns)


def dedupe_keep_oldest(items: DataFrame, by: str = "position") -> DataFrame:
    """One row for each collection and asset, the oldest."""
    return items.groupBy("collection_id", "asset_id").agg(F.min_by(F.struct(*items.columns), F.struct(by)).alias("i")).select("i.*")


def seeded_uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that follows from key and seed: 32 bits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(seed))), 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0


def draw_key(key: Column, weight: Column, seed: str) -> Column:
    """Ordering by this key draws without replacement by weight (Efraimidis and Spirakis, 2006)."""
    return -F.log(seeded_uniform(key, seed)) / weight


def weighted_shuffle(items: DataFrame, seed: str, key: str = "asset_id", weight: str = "favorite") -> DataFrame:
    """Items in weighted random order, weights below 1 as 1; the same seed gives the same order."""
    return items.orderBy(draw_key(F.col(key), F.greatest(F.col(weight), F.lit(1)).cast("double"), seed), key)


def weighted_pick(items: DataFrame, seed: str, k: int, group: str, key: str = "asset_id", weight: str = "weight", passes: int = 1, excluded: DataFrame | None = None) -> DataFrame:
    """k draws of each group by weight (0.05 at least), with their order (nth, from 1).

    A pass draws all items of the group without replacement; the next one, up to ``passes``, starts anew with
    the items played last (as many as rest, see ``cooldown_size``) cooled to 0.12 of their weight.
    excluded: group and key of items that are skipped.
    """
    if excluded is not None:
        items = items.join(excluded.select(F.col(group).alias("__g"), F.col(key).alias("__k")), (F.col(group) == F.col("__g")) & (F.col(key) == F.col("__k")), "left_anti")
    base = F.col(weight).cast("double")
    out = items.withColumn("__n", F.count("*").over(Window.partitionBy(group)))
    for p in range(passes):
        w = base
        if p:
            cooled = F.col(f"__nth{p - 1}") > F.col("__n") - cooldown_size(F.col("__n"))
            w = base * F.when(cooled, COOLED).otherwise(1.0)
        out = out.withColumn("__draw", draw_key(F.col(key), F.greatest(w, F.lit(0.05)), f"{seed}|{p}" if p else seed))
        out = out.withColumn(f"__nth{p}", F.row_number().over(Window.partitionBy(group).orderBy("__draw", key)))
    nths = F.array(*[F.col(f"__nth{p}") + p * F.col("__n") for p in range(passes)])
    drawn = out.withColumn("nth", F.explode(nths)).where(F.col("nth") <= k)
    return drawn.select(*items.columns, F.col("nth").cast("int").alias("nth"))


class _SumTree:
    """Whole weights by place, with the place that a share of their sum falls on; each change costs the logarithm of their number."""

    def __init__(self, weights: list[int]) -> None:
        self.n, self.weights, self.sums = len(weights), [0] * len(weights), [0] * (len(weights) + 1)
        self.top = 1 << max(self.n.bit_length() - 1, 0)
        self.total = 0
        for i, w in enumerate(weights):
            self.put(i, w)

    def put(self, i: int, weight: int) -> None:
        more = weight - self.weights[i]
        self.weights[i] = weight
        self.total += more
        i += 1
        while i <= self.n:
            self.sums[i] += more
            i += i & -i

    def at(self, share: int) -> int:
        """The first place up to which weights sum up to more than the share."""
        i, step = 0, self.top
        while step:
            if i + step <= self.n and self.sums[i + step] <= share:
                i += step
                share -= self.sums[i]
            step >>= 1
        return i


def player_session(weights: list[int], cooled: list[int], fails: list[bool], rest: int, draws: int, chance: Callable[[int], int]) -> Iterator[tuple[int, int, bool]]:
    """(place in the queue, pass, played) for each draw of a player that shuffles.

    A draw takes one of those not drawn in this pass, by weight. What was played among the last ``rest`` plays has its
    cooled weight, which slides on with every play; a new pass keeps it. An item that fails to load counts as drawn, is no play,
    and is left out of the very next draw even if that begins a pass. chance(nth) is a number of 32 bits.
    """
    tree, drawn, recent = _SumTree(weights), set(), []
    number, failed = 0, None

    def weight(i: int) -> int:
        return cooled[i] if rest and i in recent[-rest:] else weights[i]

    for nth in range(draws):
        if failed is not None and tree.weights[failed]:
            tree.put(failed, 0)
        if not tree.total:
            drawn.clear()
            number += 1
            for i in range(len(weights)):
                tree.put(i, 0 if i == failed else weight(i))
            if not tree.total:
                return
        i = tree.at(chance(nth) * tree.total >> 32)
        if failed is not None and failed not in drawn:
            tree.put(failed, weight(failed))
        drawn.add(i)
        tree.put(i, 0)
        failed = i if fails[i] else None
        if failed is None:
            before = recent[-rest:] if rest else []
            recent = [*[r for r in recent if r != i], i][-max(rest, 1) :]
            for r in {*before, *recent} - drawn:
                tree.put(r, weight(r))
        yield i, number, failed is None


def weighted_session(items: DataFrame, seed: str, draws: int, group: str, key: str = "asset_id", position: str = "position", favorite: str = "favorite", last: str = "last_played_at", fails: str | None = None, now: Column | None = None) -> DataFrame:
    """(group, nth from 1, key, pass, played): the draws of a player for each queue, one after another, see ``player_session``.

    Weights are those of ``shuffle_weight`` at ``now`` (recency plays no part without it), in millionths, so that sums are
    exact; the nth chance is 32 bits of an MD5 of group, seed and nth. Draws depend on each other, so a queue is one task's
    work, with some 100 bytes an item; for a whole catalog at once take ``weighted_pick``.
    """
    base = F.greatest(F.col(favorite), F.lit(1)) * (recency_multiplier(F.col(last), now) if now is not None else F.lit(1.0))
    whole = lambda w: F.round(F.greatest(F.lit(0.05), w) * 1_000_000).cast("long")
    rows = items.select(group, key, F.col(position).alias("position"), whole(base).alias("w"), whole(base * COOLED).alias("cooled"), (F.coalesce(F.col(fails), F.lit(False)) if fails else F.lit(False)).alias("fails"))
    schema = StructType([rows.schema[group], StructField("nth", IntegerType()), rows.schema[key], StructField("pass", IntegerType()), StructField("played", BooleanType())])

    def played(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (r for b in batches for r in zip(*[b.column(c).to_pylist() for c in (group, key, "w", "cooled", "fails")], strict=True))
        for found, queue in groupby(each, itemgetter(0)):
            _, keys, weights, cooled, dead = zip(*queue, strict=True)
            n = len(keys)
            rest = 0 if n <= 1 else min(40, max(3, n * 3 // 20))
            chance = lambda nth, g=found: int(hashlib.md5(f"{g}|{seed}|{nth + 1}".encode(), usedforsecurity=False).hexdigest()[:8], 16)
            session = list(player_session(list(weights), cooled, dead, rest, draws, chance))
            columns = ([found] * len(session), range(1, len(session) + 1), [keys[i] for i, _, _ in session], [p for _, p, _ in session], [x for _, _, x in session])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made, strict=True)], schema=made)

    made = to_arrow_schema(schema)
    return rows.repartition(group).sortWithinPartitions(group, "position", key).mapInArrow(played, schema)


def add_links(links: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links with the new ones, and the new ones that weren't there."""
    fresh = new.select(*links.columns).distinct().join(links, links.columns, "left_anti")
    return links.unionByName(fresh), fresh


def remove_links(links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links without those, and the ones really removed."""
    return links.join(gone, links.columns, "left_anti"), links.join(gone, links.columns, "left_semi")
