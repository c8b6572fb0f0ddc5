"""The player's shuffle against a plain one, hashes of large files, names in paths by two ways."""

from __future__ import annotations

import hashlib
import random
import resource

import pytest

from catalume.operators import collections as C
from catalume.operators import enrich as E
from catalume.sources import media


def plain_session(weights, cooled, fails, rest, draws, chance):
    """The same without a tree: everything is worked out anew for each draw."""
    played, recent, failed, number = set(), [], None, 0
    for nth in range(draws):
        left = [i for i in range(len(weights)) if i not in played and i != failed]
        if not left:
            played, number = set(), number + 1
            left = [i for i in range(len(weights)) if i != failed]
            if not left:
                return
        cool = set(recent[max(0, len(recent) - rest) :])
        w = [cooled[i] if i in cool else weights[i] for i in left]
        share = chance(nth) * sum(w) >> 32
        for i, x in zip(left, w, strict=True):
            if share < x:
                break
            share -= x
        played.add(i)
        if fails[i]:
            failed = i
        else:
            failed = None
            recent = [*[r for r in recent if r != i], i]
            recent = recent[max(0, len(recent) - max(rest, 1)) :]
        yield i, number, not fails[i]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 300])
def test_sessions_equal_a_plain_player(n):
    for seed in range(25):
        r = random.Random(seed * 1000 + n)
        weights = [r.randrange(1, 50) * 100_000 for _ in range(n)]
        fails = [r.random() < (0.9 if seed == 3 else 0.2) for _ in range(n)]
        chances = [r.getrandbits(32) for _ in range(3 * n + 20)]
        args = (weights, [w * 3 // 25 for w in weights], fails, 0 if n <= 1 else min(40, max(3, n * 3 // 20)), len(chances), chances.__getitem__)
        assert list(C.player_session(*args)) == list(plain_session(*args))


def test_cooled_items_are_rarer_after_a_pass(spark):
    items = spark.createDataFrame([(g, i, i, 1, None) for g in range(300) for i in range(12)], "q long, asset_id long, position long, favorite int, last_played_at timestamp")
    drawn = C.weighted_session(items, "s", 13, "q").toPandas()
    last = drawn[drawn.nth.between(10, 12)].groupby("q").asset_id.apply(set)
    again = drawn[drawn.nth == 13].set_index("q").asset_id
    assert (drawn[drawn.nth <= 12].groupby("q").asset_id.nunique() == 12).all()
    share = sum(again[q] in last[q] for q in again.index) / len(again)
    assert share < 0.1  # 3 x 0.12 of 9.36


def test_large_sparse_file_in_flat_memory(spark, tmp_path):
    big = tmp_path / "big one.mkv"
    with big.open("wb") as f:
        f.write(b"head")
        f.seek(3 << 30)
        f.write(b"tailtail")
    (tmp_path / "small.mp4").write_bytes(b"x" * 100)
    listing = media.list_media(spark, [str(tmp_path)])
    got = {r.path.rsplit("/", 1)[1]: (r.oshash, r.md5) for r in media.file_hashes(listing, ("oshash", "md5")).collect()}
    want = ((3 << 30) + 8 + int.from_bytes(b"head", "little") + int.from_bytes(b"tailtail", "little")) % (1 << 64)
    digest = hashlib.md5(b"head" + bytes((1 << 20) - 4))
    for _ in range((3 << 10) - 1):
        digest.update(bytes(1 << 20))
    digest.update(b"tailtail")
    assert got["big%20one.mkv" if "big%20one.mkv" in got else "big one.mkv"] == (f"{want:016x}", digest.hexdigest())
    small = {r.path.rsplit("/", 1)[1]: r.oshash for r in media.file_oshash(media.file_contents(spark, [str(tmp_path / "small.mp4")])).collect()}
    assert got["small.mp4"] == (small["small.mp4"], hashlib.md5(b"x" * 100).hexdigest())
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert media._whole_hash(str(big)) == digest.hexdigest() and media._ends_hash(str(big)) == f"{want:016x}"
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 100_000


def test_names_by_automaton_and_by_join(spark):
    r = random.Random(6)
    word = lambda: r.choice(["ab", "abc", "bc", "xyz", "x1", "long", "longer", "the"])
    names = [(r.choice(["tag", "person"]), str(i), " ".join(word() for _ in range(r.randrange(1, 5)))) for i in range(60)] + [("tag", "60", "!!"), ("tag", "61", "ABC"), ("tag", "62", None)]
    paths = [(i, "E:\\" + "\\".join("-".join(word() for _ in range(r.randrange(6))) for _ in range(3)) + ".mp4") for i in range(200)] + [(200, None), (201, "")]
    d = spark.createDataFrame(names, "kind string, dim_id string, name string")
    p = spark.createDataFrame(paths, "id long, path string")
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    one, other = rows(E.match_catalog_names(p, d)), rows(E.match_catalog_names(p, d, most=10))
    assert one == other and len(one) > 200
    assert rows(E.match_catalog_names(p, d.limit(0))) == []
