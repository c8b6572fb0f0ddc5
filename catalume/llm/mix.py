"""Mixing sources to target weights by the cube method.

A source's documents get one inclusion expectation, target / size. Its whole
part is taken for certain; the fraction is drawn by balanced sampling, so that
each source's taken words and documents meet their expectation but for the
landing of a dozen documents.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import checkpointed

#: Weights of the sources by code point, again and again.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix holds, and the most that a source is repeated.
SHARE, MOST = 1.5, 2.0
#: Documents that one task moves at a time.
BLOCK = 2_000
#: Documents of a source that are settled together at the end.
LANDING = 10
_EPS = 1e-9
_STATE = "source string, doc_id long, size long, pi double"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size, n_docs) with target added: min(most x size, level x weight), where
    the level makes the targets add up to share x all words. One pass over the sources a step; only sums reach the driver."""
    ranked = sizes.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = checkpointed(ranked.withColumn("__weight", F.element_at(cycle, (F.col("__rank") % len(weights) + 1).cast("int"))))
    cap = F.col("source_size") * F.lit(float(most))
    total, level, before = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share, 0.0, None
    while level != before:
        full = F.col("__weight") * F.lit(level) >= cap
        s = ranked.agg(F.sum(F.when(full, cap)).alias("capped"), F.sum(F.when(~full, F.col("__weight"))).alias("open")).first()
        before = level
        if s["open"]:
            level = max(level, (total - (s["capped"] or 0.0)) / s["open"])
    return ranked.withColumn("target", F.least(cap, F.col("__weight") * F.lit(level))).drop("__rank", "__weight")


def flight(pi: list[float], size: list[int], draw: random.Random, land: bool) -> None:
    """Move the probabilities, in place, through the null space of the two constraints (documents,
    words) until at most two are fractional. To land, ``LANDING`` units stay out of the flight and
    are settled with those two by the subset that is nearest in words and within three documents."""
    open_ = [k for k in range(len(pi)) if _EPS < pi[k] < 1 - _EPS]
    for k in set(range(len(pi))) - set(open_):
        pi[k] = float(round(pi[k]))
    flying = len(open_) - LANDING if land else len(open_)
    active: list[int] = []
    for k in open_[: max(flying, 0)]:
        active.append(k)
        if len(active) == 3:
            _move(pi, size, active, draw)
    if land and (rest := active + open_[max(flying, 0) :]):
        taken = np.arange(1 << len(rest))[:, None] >> np.arange(len(rest)) & 1
        p, words = np.array([pi[k] for k in rest]), np.array([size[k] for k in rest], float)
        off = np.abs(taken @ words - p @ words) + np.where(np.abs(taken.sum(1) - p.sum()) < 3, 0, np.inf)
        for k, x in zip(rest, taken[off.argmin()], strict=True):
            pi[k] = float(x)


def _move(pi: list[float], size: list[int], active: list[int], draw: random.Random) -> None:
    a, b, c = (size[k] for k in active)
    u = (float(c - b), float(a - c), float(b - a))
    _step(pi, active, u if any(u) else (1.0, -1.0, 0.0), draw)
    active[:] = [k for k in active if 0 < pi[k] < 1]


def _step(pi: list[float], units: list[int], u: tuple[float, ...], draw: random.Random) -> None:
    up = min((1 - pi[k]) / x if x > 0 else pi[k] / -x for k, x in zip(units, u, strict=True) if x)
    down = min(pi[k] / x if x > 0 else (1 - pi[k]) / -x for k, x in zip(units, u, strict=True) if x)
    move = up if draw.random() * (up + down) < down else -down
    for k, x in zip(units, u, strict=True):
        p = pi[k] + move * x
        pi[k] = 0.0 if p < _EPS else 1.0 if p > 1 - _EPS else p


def _flown(rows: pd.DataFrame) -> pd.DataFrame:
    """A block after its flight; a source's only block lands."""
    rows = rows.sort_values(["doc_id", "size"], kind="stable", na_position="last")
    first = rows.iloc[0]
    seed = hashlib.md5(f"{first['source']}|{first['doc_id']}|{len(rows)}".encode()).hexdigest()
    pi, size = rows["pi"].tolist(), rows["size"].astype("int64").tolist()
    flight(pi, size, random.Random(seed), first["__blocks"] == 1)
    return rows.assign(pi=pi)[["source", "doc_id", "size", "pi"]]


def cube_sample(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """units (source, doc_id, size, pi in [0, 1]) with pi moved to 0 or 1, balanced within each source.

    A source is dealt over blocks; what a block leaves fractional (two documents at most) meets
    that of other blocks on the next level, until the source fits one block and lands there, whatever other sources do.
    """
    units = units.select("source", F.col("doc_id").cast("long").alias("doc_id"), F.col("size").cast("long").alias("size"), F.col("pi").cast("double").alias("pi"))
    left, decided, level = units, [], 0
    while True:
        blocks = left.groupBy("source").agg(F.ceil(F.count("*") / F.lit(block)).alias("__blocks"))
        last = (blocks.agg(F.max("__blocks")).first()[0] or 0) <= 1
        left = left.withColumn("__source", F.col("source")).join(blocks.withColumnRenamed("source", "__other"), F.col("source").eqNullSafe(F.col("__other")))
        left = left.withColumn("__block", F.pmod(F.xxhash64("doc_id", "size", F.lit(level)), "__blocks"))
        flown = left.groupBy("__source", "__block").applyInPandas(_flown, _STATE)
        if last:
            return _union([*decided, flown])
        flown = checkpointed(flown)
        open_ = (F.col("pi") > 0) & (F.col("pi") < 1)
        decided.append(flown.where(~open_))
        left, level = flown.where(open_), level + 1


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, size (words), source, source_size, target of its source, times (how often it is taken).

    docs: doc_id, text, source; other columns are ignored. A null or empty text has size 0; a source
    of size 0 gets target 0 and nothing is taken of it. A null source is a source of its own, the
    last; rows that repeat are units of their own. An empty table gives an empty result. The draw
    depends on doc_ids and sizes alone, so reruns and other partitionings agree.
    """
    sized = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("size")))
    per_source = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, share, most)
    wanted = per_source.select(F.col("source").alias("__of"), "source_size", "target", F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0).alias("__each"))
    units = sized.join(wanted, F.col("source").eqNullSafe(F.col("__of")))
    drawn = cube_sample(units.select("source", "doc_id", "size", (F.col("__each") - F.floor("__each")).alias("pi")), block)
    back = drawn.join(wanted, F.col("source").eqNullSafe(F.col("__of")))
    return back.select("doc_id", "size", "source", "source_size", "target", (F.floor("__each") + F.round("pi")).cast("long").alias("times"))


def digest(mixed: DataFrame) -> DataFrame:
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns kept, each as often as the mix takes it.

    Rows that share doc_id and source share what the mix takes of them, as evenly as it divides, rows with a null
    doc_id by source. Null and empty texts are of size 0; they are drawn like others where their source has words, else
    not taken. An empty table stays empty.
    """
    key = lambda doc, source: F.to_json(F.struct(doc.cast("long").alias("d"), source.cast("string").alias("s")))
    taken = mix_sources(docs, **how).groupBy(key(F.col("doc_id"), F.col("source")).alias("__key")).agg(F.sum("times").alias("__times"), F.count("*").alias("__rows"))
    # The row as one struct, so that no column of docs can clash with those used here.
    packed = docs.select(F.struct(*docs.columns).alias("row"), key(F.col("doc_id"), F.col("source")).alias("key"), F.xxhash64(*docs.columns).alias("order"))
    rows = packed.join(taken, F.col("key") == F.col("__key"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("order"))
    each = F.floor(F.col("__times") / F.col("__rows")) + (nth <= F.col("__times") % F.col("__rows")).cast("long")
    rows = rows.withColumn("each", each).where("each > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("each").cast("int")))).select("row.*")
