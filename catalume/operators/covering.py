"""Exact candidates for pairs of 64-bit numbers within a Hamming radius: covering codes (R. Pagh, SODA 2016).

Every bit gets a vector of radius + 1 bits, and every non-zero such vector v a mask of the bits whose vectors have an odd
product with v. Up to radius differing bits span less than the whole space, so some v is orthogonal to all of them: two
numbers within the radius agree under one of the 2 ** (radius + 1) - 1 masks, always. Bits are cut in parts first, and the
radius with them: differences of t bits in k parts leave some part with no more than its share.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import checkpointed

#: What a key costs against a compared pair.
KEY_COST = 3.0
#: Masks at most.
MOST_MASKS = 1023
#: Drawings of bit vectors of which the one with the fewest chance meetings is taken.
DRAWINGS = 60
#: Numbers under one mask and value that meet as they are; more of them meet under further masks.
BUCKET = 2_000


@dataclass(frozen=True)
class Cover:
    """Masks over 64 bits, and the share of unrelated pairs that meet under one, summed over all."""

    masks: tuple[int, ...]
    meetings: float


def _masks(bits: list[int], radius: int, seed: int) -> list[int]:
    """Masks that cover all differences of up to radius of these bits."""
    size = (1 << (radius + 1)) - 1
    best: tuple[float, list[int]] | None = None
    for n in range(DRAWINGS if radius > 1 else 1):
        r = random.Random(seed * 1000 + n)
        # All vectors about equally often, so that masks are alike in weight.
        vectors = [v for _ in range(-(-len(bits) // size)) for v in r.sample(range(1, size + 1), size)][: len(bits)]
        masks = [sum(1 << b for b, m in zip(bits, vectors, strict=True) if (v & m).bit_count() % 2) for v in range(1, size + 1)]
        cost = sum(2.0 ** -m.bit_count() for m in masks)
        if best is None or cost < best[0]:
            best = cost, masks
    return best[1]


@cache
def cover(radius: int, parts: int) -> Cover | None:
    """A cover of 64 bits in so many parts; None if it takes too many masks."""
    if not 1 <= parts <= radius + 1:
        return None
    # Shares sum up so that radius differences can't exceed all: sum of (share + 1) is radius + 1.
    shares = [(radius + 1) // parts + (i < (radius + 1) % parts) - 1 for i in range(parts)]
    if sum((1 << (s + 1)) - 1 for s in shares) > MOST_MASKS:
        return None
    # A larger share gets more bits.
    whole = sum(s + 1 for s in shares)
    cuts, upto = [0], 0
    for s in shares:
        upto += s + 1
        cuts.append(round(64 * upto / whole))
    masks = [m for k, s in enumerate(shares) for m in _masks(list(range(cuts[k], cuts[k + 1])), s, radius * 64 + k)]
    return Cover(tuple(masks), sum(2.0 ** -m.bit_count() for m in masks))


def best_cover_for(radius: int, n: int) -> Cover:
    """The cover with the least work for n numbers: more of them take fewer and wider parts."""
    known = [c for k in range(1, radius + 2) if (c := cover(radius, k))]
    return min(known, key=lambda c: KEY_COST * len(c.masks) + n * c.meetings)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covered(number: Column, c: Cover) -> Column:
    """An array of (no, value) under each mask."""
    return F.array(*[F.struct(F.lit(i).cast("short").alias("no"), number.bitwiseAND(F.lit(signed(m))).alias("value")) for i, m in enumerate(c.masks)])


def first_agreement(a: Column, b: Column, c: Cover) -> Column:
    """The number of the first mask under which both agree."""
    masks = F.array(*[F.lit(signed(m)) for m in c.masks])
    return F.array_position(F.transform(masks, lambda m: a.bitwiseXOR(b).bitwiseAND(m) == 0), True).cast("int") - 1


def meeting_pairs(left: DataFrame, right: DataFrame | None, keys: list[str], radius: int, n: int, bucket: int = BUCKET) -> DataFrame:
    """Rows (keys, a, b): a number of left (keys, number) and one of right, or of left again if right is None, that share the keys
    and are within the Hamming radius; each pair once, of left with itself with a < b. n: about how many numbers meet.

    Numbers under their masks are written once; buckets of too many rows are cut by a second cover of other parts, under
    which their pairs meet too.
    """
    c = best_cover_for(radius, n)
    second = cover(radius, min(radius + 1, 4)) or c
    at = [*keys, "no", "value"]

    def under_masks(rows: DataFrame) -> DataFrame:
        return checkpointed(rows.select(*keys, "number", F.explode(covered(F.col("number"), c)).alias("k")).select(*keys, "number", "k.*"))

    x = under_masks(left)
    y = x if right is None else under_masks(right)
    hot = checkpointed(x.groupBy(at).count().where(F.col("count") > bucket).select(*at, F.lit(True).alias("hot")))
    if hot.isEmpty():
        x, y = (t.withColumn("no2", F.lit(-1)) for t in (x, y))
    else:
        at += ["no2", "value2"]

        def further(rows: DataFrame) -> DataFrame:
            more = F.when(F.col("hot"), covered(F.col("number"), second)).otherwise(F.array(F.struct(F.lit(-1).cast("short").alias("no"), F.lit(0).cast("long").alias("value"))))
            marked = rows.join(hot, at[:-2], "left").select(*at[:-2], "number", F.explode(more).alias("k"))
            return checkpointed(marked.select(*at[:-2], "number", F.col("k.no").cast("int").alias("no2"), F.col("k.value").alias("value2")))

        x, y = (further(x),) * 2 if right is None else (further(x), further(y))
    both = x.withColumnRenamed("number", "a").join(y.withColumnRenamed("number", "b").drop(*({"no2"} - set(at))), at)
    a, b = F.col("a"), F.col("b")
    near = both.where(F.bit_count(a.bitwiseXOR(b)) <= radius)
    near = near.where("a < b") if right is None else near
    once = (F.col("no") == first_agreement(a, b, c)) & ((F.col("no2") < 0) | (F.col("no2") == first_agreement(a, b, second)))
    return near.where(once).select(*keys, "a", "b")
