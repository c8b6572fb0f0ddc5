"""The manifest, the prefix trie and the nearest neighbours against brute force, and with messy tables."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalume.llm import manifest, neighbours, ordered, prefixtrie
from tests.conftest import SMALL

from .conftest import MESSY, documents


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# ---- manifest


def manifest_rows(rows):
    """(doc_id, source, lang, n_chars, text) as the contract's rows, node by node."""
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, add=0: sha("".join(map(value, (r[0], r[1], r[2], None if r[3] is None else r[3] + add, r[4]))))

    def tree(digests):
        proofs, level = [[] for _ in digests], [(d, [i]) for i, d in enumerate(digests)]
        while len(level) > 1:
            above = []
            for k in range(0, len(level), 2):
                run = level[k : k + 2]
                for j, (_, own) in enumerate(run):
                    for i in own:
                        proofs[i].append(("".join(d for d, _ in run[:j]), "".join(d for d, _ in run[j + 1 :])))
                above.append((sha("".join(d for d, _ in run)), [i for _, own in run for i in own]))
            level = above
        return level[0][0], proofs

    langs = defaultdict(list)
    for r in rows:
        langs[r[2]].append(r)
    trees = []
    for lang in sorted(langs, key=lambda x: (x is not None, (x or "").encode())):
        of = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((of, *tree([leaf(r) for r in of])))
    root, upper = tree([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (of, subroot, proofs), above in zip(trees, upper, strict=True):
        for r, p in zip(of, proofs, strict=True):
            found = leaf(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            for a, b in p + above:
                found = sha(a + found + b)
            out.append((r[0], leaf(r), subroot, root, sha("".join(a + b for a, b in p + above)), found, found == root))
    return sorted(out, key=str)


def made_manifest(docs, levels=manifest.LEVELS):
    return sorted(map(tuple, manifest.digest(manifest.merkle_manifest(docs, levels, tampered=manifest.tampered())).collect()), key=str)


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_equals_brute_force(spark, levels):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert made_manifest(docs, levels) == manifest_rows([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()])


def test_manifest_messy(spark, messy, empty):
    made = made_manifest(messy.withColumn("n_chars", F.when(F.col("doc_id") != 7, F.col("n_chars"))))
    assert made == manifest_rows([(d, s, g, None if d in (7, None) else len(t or ""), t) for d, t, g, s in MESSY])
    assert made_manifest(empty) == []


def test_manifest_single_rows_and_nulls(spark):
    rows = [(i, "t", g, "s") for i, g in ((7, None), (7, ""), (None, "a"), (None, "a"))]
    docs = documents(spark, rows).withColumn("n_chars", F.lit(None).cast("long"))
    assert made_manifest(docs) == manifest_rows([(d, s, g, None, t) for d, t, g, s in rows])
    one = documents(spark, [(3, "x", "en", "s")])
    (row,) = made_manifest(one)
    assert row[1] == row[2] == row[3] and row[4] == sha("")


@pytest.mark.parametrize("n", range(1, 40))
def test_sweeps(n):
    leaves = [sha(str(i)) for i in range(n)]
    top, nodes = manifest.forward(leaves, (n - 1).bit_length())
    for i, proof in enumerate(manifest.backward(nodes, n, (("l", "r"), ()))):
        digest = leaves[i]
        steps = list(manifest._flat(proof))
        for a, b in steps[:-1]:
            digest = sha(a + digest + b)
        assert digest == top and steps[-1] == ("l", "r") and len(steps) == 1 + (n - 1).bit_length()


def test_numbered_cuts_copies(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("k"), "id")
    got = ordered.numbered(df, ["k"]).toPandas().sort_values("rank")
    assert got["rank"].tolist() == list(range(5000)) and got["k"].is_monotonic_increasing and sorted(got["id"]) == list(range(5000))


# ---- trie


def trie_rows(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append(((t is not None, t or 0), sha(f"{len(r.encode())}:{r}{x}"), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(o)] for c, o in own.items()}
    made = {}
    for c, o in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = own.get(c - c % 100, [])[:h] + o[h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c, o in made.items():
        for d in range(len(o) + 1):
            members[tuple(o[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(",".join(map(str, sorted(c for c in m if len(made[c]) == len(p)))))) for p, m in members.items()), key=str)


def made_trie(turns, n_shards=None, chunk=prefixtrie.CHUNK):
    return sorted(map(tuple, prefixtrie.prefix_trie(prefixtrie.rebuilt(prefixtrie.paths(turns)), n_shards, chunk).collect()), key=str)


@pytest.mark.parametrize(("n_shards", "most"), [(None, 200_000), (13, 200_000), (40, 20)])
def test_trie_equals_brute_force(spark, monkeypatch, n_shards, most):
    monkeypatch.setattr(prefixtrie, "MOST_SKELETON", most)
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    assert made_trie(turns, n_shards) == trie_rows([(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()])


TURNS = "conv_id long, turn long, role string, text string, path string, depth int, sid long"


def test_trie_of_copies_cut_apart(spark):
    """One conversation and its prefixes many times over, so that its end node lies in many shards, in small pieces."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if c % 10 else f"own {c % 30}", "x", 1, 2) for c in range(1, 400) for t in range(3 + (c % 4 == 0))]
    assert made_trie(spark.createDataFrame(rows, TURNS), 9, 10) == trie_rows([r[:4] for r in rows])


def test_trie_messy(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 5, "", "été \U0001f642"), (None, 1, "user", "lost"), (205, 3, None, "late"), (300, 1, "x", "y" * 100_000), (301, 0, "x", "z")]
    rows = [(*r, "clash", 1, 2) for r in rows]
    assert made_trie(spark.createDataFrame(rows, TURNS)) == trie_rows([r[:4] for r in rows])
    assert made_trie(spark.createDataFrame([], TURNS)) == []


def test_common_prefix():
    for n in range(6):
        for k in range(n + 1):
            a = bytes(range(16)) * n
            b = a[: 16 * k] + bytes(16) * (5 - k)
            assert prefixtrie._common(a, b) == k


# ---- neighbours


def nearest(ids, x, k=20, every=20):
    out = {}
    for q in range(len(ids)):
        if ids[q] % every == 0:
            s = neighbours.inner_products(np.repeat(x[q : q + 1], len(x), 0), x)
            by = [i for i in np.lexsort((ids, -s)) if i != q][:k]
            out[ids[q]] = [(ids[i], s[i]) for i in by]
    return out


def found(df, **kw):
    out = defaultdict(list)
    for r in neighbours.nearest_neighbours(df, **kw).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out[r.query_id]) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_neighbours_recall_and_scores(spark, block):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = df.toPandas()
    ids, x = p["vec_id"].to_numpy(), np.array(p["embedding"].tolist(), np.float64)
    want, got = nearest(ids, x), found(df, block_rows=block, part_bytes=10_000 * block)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    place = {i: n for n, i in enumerate(ids)}
    for q, rows in got.items():
        exact = neighbours.inner_products(np.repeat(x[[place[q]]], len(rows), 0), x[[place[i] for i, _ in rows]])
        assert [s for _, s in rows] == exact.tolist()
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0]))


def test_neighbours_of_lengths_and_copies(spark):
    """Lengths from 1 to 50, and one vector in a third of all rows: the largest product wins, copies tie by id."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(3000, 8)) * rng.uniform(1, 50, size=(3000, 1))).astype(np.float32)
    x[1000:2000] = x[1000]
    df = spark.createDataFrame([(i, v.tolist(), 1, 2, 0.5) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int, rank int, score double")
    want, got = nearest(np.arange(3000), x.astype(np.float64)), found(df)
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    assert all(g == w for q, g in got.items() if (w := want[q]) and len({s for _, s in w}) == 1)


def test_neighbours_messy(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (40, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (7, []), (60, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, neighbours.nearest_neighbours(df).collect()))
    each = [(1, 20, 4.0), (2, 1, 2.0), (3, 0, 0.0)]
    assert got == sorted([(0, 1, 1, 1.0), (0, 2, 20, 0.0), (0, 3, 20, 0.0), *[(20, *r) for r in each for _ in range(2)]])
    assert neighbours.nearest_neighbours(df.limit(0)).collect() == []
    assert neighbours.nearest_neighbours(df.where("vec_id = 0")).collect() == []


def test_graph_search_finds_the_lists():
    rng = np.random.default_rng(5)
    lists = neighbours.Lists.fit(rng.normal(size=(20_000, 16)), 20_000, 10.0)
    q = neighbours.asked(rng.normal(size=(200, 16)))
    row, node, _ = lists.search(q, 1.05)
    c = lists.centroids.astype(np.float64)
    far = np.sqrt(1 + (c**2).sum(1)[None] - 2 * q @ c.T)
    want = set(zip(*np.nonzero(far <= 1.05 * far.min(1)[:, None] * (1 - 1e-6)), strict=True))
    assert len(want & set(zip(row, node, strict=True))) >= 0.98 * len(want)
    sizes = np.bincount(lists.homes(rng.normal(size=(20_000, 16)))[1], minlength=len(c))
    assert sizes.max() < 8 * sizes.mean()
