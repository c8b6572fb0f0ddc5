"""Hamming pairs and group diameters against brute force, and what they cost."""

from __future__ import annotations

import random

import numpy as np
import pytest

from catalume.operators import covering as K
from catalume.operators import duplicates as D


def popcount(x):
    return np.bitwise_count(x)


def brute(hashes, t):
    u = np.unique(np.array(hashes, np.int64))
    d = popcount((u[:, None] ^ u[None]).view(np.uint64))
    i, j = np.nonzero((d <= t) & (np.arange(len(u))[:, None] < np.arange(len(u))))
    return {(int(u[a]), int(u[b]), int(d[a, b])) for a, b in zip(i, j, strict=True)}


@pytest.mark.parametrize("radius", [1, 3, 8, 12, 16])
def test_covers_miss_nothing(radius):
    r = random.Random(radius)
    for parts in range(1, radius + 2):
        c = K.cover(radius, parts)
        if c is None:
            continue
        for _ in range(300):
            x = sum(1 << b for b in r.sample(range(64), radius))
            assert any(x & m == 0 for m in c.masks)
        assert len(c.masks) <= K.MOST_MASKS


def test_wider_parts_for_more_hashes():
    n, work = [10**k for k in range(3, 10)], []
    for rows in n:
        c = K.best_cover_for(8, rows)
        work.append(K.KEY_COST * len(c.masks) + rows * c.meetings)
    # Work a hash grows by less than 60 while the hashes grow by a million; all against all would grow by a million.
    assert work == sorted(work) and work[-1] < 60 * work[0]
    assert K.best_cover_for(16, 10**6).meetings < 0.05


@pytest.mark.parametrize("threshold", [0, 8, 16])
def test_pairs_equal_brute_force(spark, threshold):
    r = random.Random(3)
    base = [r.getrandbits(64) - (1 << 63) for _ in range(150)] + [-1, 0, (1 << 63) - 1, -(1 << 63)]
    hashes = base + [b ^ K.signed(sum(1 << i for i in r.sample(range(64), r.randrange(20)))) for b in base]
    df = spark.createDataFrame([(h,) for h in [*hashes, *base[:5], None]], "hash long")
    got = [(x.a, x.b, x.distance) for x in D.hamming_pairs(df, threshold).collect()]
    assert set(got) == brute(hashes, threshold) and len(got) == len(set(got))


def test_large_buckets_are_cut(spark):
    """Hashes whose lower half is one value, so that half of the first masks tell nothing."""
    r = random.Random(5)
    hashes = [(r.getrandbits(31) << 32) | 7 for _ in range(300)] + [(5 << 40) | i for i in range(40)]
    df = spark.createDataFrame([(h,) for h in hashes], "hash long")
    df = df.toDF("number")
    got = [(x.a, x.b) for x in K.meeting_pairs(df, None, [], 8, 300, bucket=20).collect()]
    assert set(got) == {(a, b) for a, b, _ in brute(hashes, 8)} and len(got) == len(set(got))
    other = K.meeting_pairs(df, df, [], 8, 300, bucket=20)
    assert sorted((x.a, x.b) for x in other.where("a < b").collect()) == sorted(got) and other.where("a = b").count() == len(hashes)


def test_twice_the_rows_are_little_more_work_each(spark):
    r = random.Random(8)
    work = []
    for n in (4000, 8000):
        c = K.best_cover_for(8, n)
        h = spark.createDataFrame([(r.getrandbits(64) - (1 << 63),) for _ in range(n)], "a long").select(K.covered(K.F.col("a"), c).alias("k"))
        compared = h.select(K.F.explode("k").alias("k")).groupBy("k").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]
        assert compared < 0.006 * n * (n - 1) / 2
        work.append(K.KEY_COST * len(c.masks) + compared / n)
    assert work[1] < 1.3 * work[0]


def diameters(spark, groups):
    df = spark.createDataFrame([(g, h) for g, hs in groups.items() for h in hs], "group long, hash long")
    got = {x.group: x.max_distance for x in D.group_diameters(df, 50).collect()}
    want = {}
    for g, hs in groups.items():
        u = np.unique(np.array(hs, np.int64))
        want[g] = int(popcount((u[:, None] ^ u[None]).view(np.uint64)).max())
    return got, want


def test_diameters_equal_brute_force(spark):
    r = random.Random(9)
    flip = lambda h, n: h ^ K.signed(sum(1 << i for i in r.sample(range(64), n)))
    any_ = lambda: r.getrandbits(64) - (1 << 63)
    chain = [any_()]
    for _ in range(300):
        chain.append(flip(chain[-1], 5))
    core = any_()
    groups = {1: [7], 2: [7, 8], 3: [7, 7, 7], 4: chain, 5: [flip(core, r.randrange(5)) for _ in range(400)], 6: [any_() for _ in range(600)], 7: [any_() for _ in range(300)] + [core, ~core], 8: [0, -1] + [any_() for _ in range(60)]}
    got, want = diameters(spark, groups)
    assert got == want


def test_a_large_group_without_all_pairs(spark):
    """10^5 hashes round one of them: only the outermost are compared."""
    r = np.random.default_rng(4)
    bits = np.zeros((100_000, 64), np.uint8)
    for k in range(4):
        bits[np.arange(100_000), r.integers(64, size=100_000)] ^= 1 if k else 1
    h = np.unique(np.packbits(bits, axis=1).view(">i8").astype(np.int64).ravel())
    far = np.array([(1 << 6) - 1, ((1 << 6) - 1) << 20], np.int64)
    df = spark.createDataFrame([(1, int(x)) for x in np.concatenate([h, far])], "group long, hash long")
    assert D.group_diameters(df).first().max_distance == 12


def test_groups_join_by_chains(spark):
    df = spark.createDataFrame([("a", 0), ("b", 127), ("c", 127 * 129), ("d", 127 * 129), ("e", -1), ("f", None)], "id string, hash long")
    groups = D.duplicate_groups(df)
    assert {(r.id, r.group) for r in groups.collect()} == {(i, 0) for i in "abcd"}
    assert [tuple(r) for r in D.duplicate_group_summary(groups).collect()] == [(0, 4, 14)]
    assert D.duplicate_group_summary(D.duplicate_groups(df.limit(0))).collect() == []
