"""Approximate nearest neighbours by largest inner product: balanced posting lists on the executors, their centroids in
memory.

Vectors are lifted onto a sphere by one more component, so that the largest inner product is the least distance.
Centroids are the means of a sample's leaves under repeated halving, hence balanced. A vector stands in its nearest
list and, near a boundary, in a few more; a query reads the lists whose centroids are at most ``ratio`` times as far
as the nearest one. That ratio is not set but measured: the least one with which enough of a few exactly answered
queries' true neighbours stand in a list that is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..cluster import checkpointed

#: Vectors that the lists are fitted on at most, chosen by a hash. All vectors are indexed.
SAMPLE = 65_536
#: Vectors of a list that are aimed at, and lists at most, as all centroids are in each worker's memory.
LIST_ROWS, MOST_LISTS = 64, 8_192
#: Lists that hold a vector, and how much farther than the nearest centroid the others may be.
COPIES, BOUNDARY = 3, 1.02
#: Vectors of a list that stay together; a longer list is cut into blocks, all of which its queries read. Neighbouring
#: lists make a part, with so many bytes of vectors, which a task holds. A query goes once to each part that it reads from.
BLOCK_ROWS, PART_BYTES = 4_096, 1 << 23
#: Neighbours of a centroid in the graph, and the nearest centroids that a search looks around at least.
DEGREE, BREADTH = 16, 24
#: Centroids that a search starts from, and those beyond the ratio whose neighbours it looks at in a step.
ENTRIES, STEPS = 64, 4
#: Queries answered exactly to measure the ratio, and the share of their neighbours that must be found.
TRIALS, TARGET = 256, 0.95
#: Queries that are compared with a part together.
CHUNK = 1_024


def taking_part(vec_id: Column, vector: Column) -> Column:
    """Vectors that can be compared: with an id, not null, not zero, all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec_id.isNotNull() & F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column without nulls, all of one length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product of each row of a with that of b, added up in the order of the components, so that equal vectors tie."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def halves(x: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Means of at least so many parts of x, a power of two of them, equal in size but for one row; equal means once."""
    rng, leaves = np.random.default_rng(seed), [np.arange(len(x))]
    while len(leaves) < parts:
        cut = []
        for rows in leaves:
            y, h = x[rows], len(rows) // 2
            way = y[rng.integers(len(y))] - y[rng.integers(len(y))]
            for _ in range(6):
                by = np.argsort(y @ way, kind="stable")
                way = y[by[h:]].mean(0) - y[by[:h]].mean(0) if h else way
            by = np.argsort(y @ way, kind="stable")
            cut += [rows[by[:h]], rows[by[h:]]]
        leaves = [rows for rows in cut if len(rows)]
        if len(leaves) == len(x):
            break
    means = np.stack([x[rows].mean(0) for rows in leaves])
    _, first = np.unique(means, axis=0, return_index=True)
    return means[np.sort(first)]


@dataclass
class Lists:
    """Centroids on the sphere, a graph over them, and the greatest length of a vector."""

    centroids: np.ndarray
    graph: np.ndarray
    longest: float

    @staticmethod
    def fit(sample: np.ndarray, rows: int, longest: float) -> Lists:
        x = lifted(sample, longest)
        wanted = max(1, min(MOST_LISTS, rows // LIST_ROWS))
        centroids = halves(x, wanted)
        n, rng = len(centroids), np.random.default_rng(1)
        norms, near = (centroids**2).sum(1), []
        for at in range(0, n, 512):
            d = norms[None] - 2 * centroids[at : at + 512] @ centroids.T
            near.append(np.argsort(d, 1)[:, 1 : DEGREE + 1])
        near = np.concatenate(near)
        # Edges both ways, the neighbours in the order of halving, which connect all, and a few far ones.
        back: list[list[int]] = [[] for _ in range(n)]
        for i, row in enumerate(near):
            for j in row:
                if len(back[j]) < DEGREE:
                    back[j].append(i)
        graph = np.empty((n, 2 * DEGREE + 4), np.int32)
        for i in range(n):
            own = [*near[i], *back[i], (i + 1) % n, (i - 1) % n, *rng.integers(n, size=2)]
            graph[i] = np.resize(own, graph.shape[1])
        return Lists(centroids.astype(np.float32), graph, longest)

    def search(self, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, distance) of the lists at most ``ratio`` times as far from each row as its nearest, by a best-first
        walk over the graph for many rows at once; nearest first for each row.

        A row's candidates are its BREADTH nearest lists so far and all others in the ratio; each step looks at the
        neighbours of those in the ratio and of the next few.
        """
        n, out = len(self.centroids), []
        norms, wide = (self.centroids**2).sum(1), np.float32(ratio) ** 2
        entries = np.unique(np.linspace(0, n - 1, ENTRIES).astype(np.int64))
        for start in range(0, len(x), step := max(1, (1 << 22) // n)):
            y = x[start : start + step].astype(np.float32)
            m, own = len(y), (y**2).sum(1)
            seen, mark = np.zeros(m * n, bool), np.empty(m * n, np.int32)
            node = np.tile(entries, (m, 1))
            far = np.maximum(own[:, None] + norms[entries] - 2 * y @ self.centroids[entries].T, 0)
            seen.reshape(m, n)[:, entries] = True
            walked = np.zeros(node.shape, bool)
            while True:
                by = np.argsort(far, 1)
                far, node, walked = (np.take_along_axis(c, by, 1) for c in (far, node, walked))
                inside = far <= far[:, :1] * wide
                width = max(BREADTH, int(inside.sum(1).max()))
                far, node, walked, inside = far[:, :width], node[:, :width], walked[:, :width], inside[:, :width]
                fresh = ~walked & np.isfinite(far)
                fresh &= inside | (np.cumsum(fresh, 1) <= STEPS) & (np.arange(fresh.shape[1]) < BREADTH)
                row, at = np.nonzero(fresh)
                if not len(row):
                    break
                walked[row, at] = True
                to = (row[:, None] * n + self.graph[node[row, at]]).ravel()
                to = to[~seen[to]]
                mark[to] = np.arange(len(to))
                to = np.sort(to[mark[to] == np.arange(len(to))])
                seen[to] = True
                r, c = np.divmod(to, n)
                d = np.empty(len(to), np.float32)
                for part in range(0, len(to), 1 << 16):
                    i, j = r[part : part + (1 << 16)], c[part : part + (1 << 16)]
                    d[part : part + (1 << 16)] = np.maximum(own[i] + norms[j] - 2 * np.einsum("ij,ij->i", y[i], self.centroids[j]), 0)
                nth = np.arange(len(r)) - np.searchsorted(r, r)
                shape = (m, int(nth.max()) + 1 if len(nth) else 0)
                more, which = np.full(shape, np.inf, np.float32), np.zeros(shape, np.int64)
                more[r, nth], which[r, nth] = d, c
                far, node, walked = np.concatenate([far, more], 1), np.concatenate([node, which], 1), np.concatenate([walked, np.zeros(shape, bool)], 1)
            row, at = np.nonzero(far <= far[:, :1] * wide)
            out.append((row + start, node[row, at], np.sqrt(far[row, at])))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def homes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): each vector's nearest list, and up to COPIES in all near a boundary."""
        row, node, _ = self.search(lifted(x, self.longest), BOUNDARY)
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        return row[nth < COPIES], node[nth < COPIES]


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors as points of the unit sphere with one more component."""
    y = x / longest
    return np.concatenate([y, np.sqrt(np.maximum(1 - (y**2).sum(1, keepdims=True), 0))], 1)


def asked(x: np.ndarray) -> np.ndarray:
    """Queries as directions, with nothing in the last component."""
    y = x / np.sqrt((x**2).sum(1, keepdims=True))
    return np.concatenate([y, np.zeros((len(y), 1))], 1)


def _index(lists: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, node = lists.value.homes(matrix(b.column("vector")))
        offsets = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(node.astype(np.int32)))], [*b.schema.names, "lists"])


def _best(score: np.ndarray, vec_id: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each line: greatest score, then least vec_id, each row once. Empty places have row -1 and come last."""
    for last in (False, True):
        for name in ("row", "vec_id", "less"):
            by = np.argsort({"row": row, "vec_id": vec_id, "less": -score}[name], 1, kind="stable")
            score, vec_id, row = (np.take_along_axis(a, by, 1) for a in (score, vec_id, row))
        if not last:
            again = np.zeros(row.shape, bool)
            again[:, 1:] = row[:, 1:] == row[:, :-1]
            score, row = np.where(again, -np.inf, score), np.where(again, -1, row)
    return score[:, :k], vec_id[:, :k], row[:, :k]


class Running:
    """The k best so far of some queries, given by the rows they are, their ids and vectors."""

    def __init__(self, k: int, query: np.ndarray, query_id: np.ndarray, q: np.ndarray) -> None:
        self.k, self.query, self.query_id, self.q = k, query, query_id, q
        shape = (len(query), k)
        self.score, self.vec_id, self.row = np.full(shape, -np.inf), np.zeros(shape, np.int64), np.full(shape, -1, np.int64)

    def compare(self, at: np.ndarray, row: np.ndarray, vec_id: np.ndarray, x: np.ndarray) -> None:
        """Hold the queries at these places against the vectors x; a query's own row is left out."""
        q, query = self.q[at], self.query[at]
        s = q @ x.T
        s[query[:, None] == row[None]] = -np.inf
        # Products in another order differ in the last digits; what may tie is added up anew.
        slack = 1e-12 * np.sqrt((q**2).sum(1) * (x**2).sum(1).max()) * q.shape[1]
        least = self.score[at, self.k - 1]
        if s.shape[1] > self.k:
            least = np.maximum(least, -np.partition(-s, self.k - 1, 1)[:, self.k - 1])
        i, j = np.nonzero((s >= (least - slack)[:, None]) & np.isfinite(s))
        if not len(i):
            return
        exact = np.concatenate([inner_products(q[i[a : a + 65_536]], x[j[a : a + 65_536]]) for a in range(0, len(i), 65_536)])
        by = np.lexsort((row[j], vec_id[j], -exact, i))
        i, j, exact = i[by], j[by], exact[by]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, exact, nth = (a[nth < self.k] for a in (i, j, exact, nth))
        new = [np.full((len(q), self.k), -np.inf), np.zeros((len(q), self.k), np.int64), np.full((len(q), self.k), -1, np.int64)]
        for a, v in zip(new, (exact, vec_id[j], row[j]), strict=True):
            a[i, nth] = v
        hit = np.unique(i)
        old = at[hit]
        self.score[old], self.vec_id[old], self.row[old] = _best(*[np.concatenate([a[old], b[hit]], 1) for a, b in zip((self.score, self.vec_id, self.row), new, strict=True)], self.k)

    def taken(self) -> Iterator[pa.RecordBatch]:
        at, nth = np.nonzero(self.row >= 0)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in (self.query[at], self.query_id[at], self.row[at, nth], self.vec_id[at, nth], self.score[at, nth])], ["query", "query_id", "row", "vec_id", "score"])


_FOUND = "query long, query_id long, row long, vec_id long, score double"


def _trial(k: int, queries: Broadcast, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k nearest in this partition of a few queries."""
    best = Running(k, *queries.value)
    every = np.arange(len(best.query))
    for b in batches:
        for at in range(0, b.num_rows, BLOCK_ROWS):
            c = b.slice(at, BLOCK_ROWS)
            best.compare(every, *[c.column(n).to_numpy() for n in ("row", "vec_id")], matrix(c.column("vector")))
    yield from best.taken()


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, from the best of several parts; a vector that stands in several lists counts once."""
    each = found.groupBy("query", "query_id").agg(F.collect_set(F.struct((-F.col("score")).alias("less"), "vec_id", "row")).alias("all"))
    best = each.select("query", "query_id", F.posexplode(F.slice(F.array_sort("all"), 1, k)).alias("nth", "b"))
    return best.select("query", "query_id", (F.col("nth") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.row").alias("row"), (-F.col("b.less")).alias("score"))


def measured_ratio(indexed: DataFrame, lists: Lists, k: int, target: float = TARGET, trials: int = TRIALS) -> float:
    """The least ratio with which the wanted share of the true neighbours of some vectors stand in a list that is read."""
    spark = indexed.sparkSession
    some = _sampled(indexed, trials, indexed.count()).select("row", "vec_id", "vector").toArrow()
    q = matrix(some.column("vector"))
    queries = spark.sparkContext.broadcast((some.column("row").to_numpy(), some.column("vec_id").to_numpy(), q))
    true = _ranked(indexed.select("row", "vec_id", "vector").mapInArrow(partial(_trial, k, queries), _FOUND), k)
    true = true.select("query", "row").join(indexed.select("row", "lists"), "row").toArrow()
    if not true.num_rows:
        return 1.0
    c = lists.centroids.astype(np.float64)
    far = np.sqrt(np.maximum(1 + (c**2).sum(1)[None] - 2 * asked(q) @ c.T, 0))
    place = {r: i for i, r in enumerate(some.column("row").to_pylist())}
    need = [min(far[place[r], n] for n in own) / far[place[r]].min() for r, own in zip(true.column("query").to_pylist(), true.column("lists").to_pylist(), strict=True)]
    return float(np.quantile(need, target, method="higher")) * (1 + 1e-6)


def _sampled(vectors: DataFrame, most: int, rows: int) -> DataFrame:
    """At most so many rows, those of least hash; all but a few more than these drop out before they are sorted."""
    hashed = vectors.withColumn("__h", F.xxhash64("row", "vec_id"))
    share = min(1.0, (1.2 * most + 100) / max(rows, 1))
    return hashed.where(F.pmod("__h", F.lit(1 << 30)) < int(share * (1 << 30))).orderBy("__h").limit(most).drop("__h")


@dataclass
class Routes:
    """Where lists go: how many blocks each is cut into, the rows of all before it, and of all."""

    blocks: np.ndarray
    before: np.ndarray
    size: np.ndarray
    parts: int

    def part(self, node: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Neighbouring lists share a part, and parts have about equal rows."""
        middle = self.before[node] + (block + 0.5) * self.size[node] / self.blocks[node]
        return np.minimum((middle * self.parts / max(1, self.size.sum())).astype(np.int32), self.parts - 1)


def _routed(lists: Broadcast, routes: Routes, ratio: float, every: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector to the blocks it stands in (kind 0), each query once to every part with lists it reads (kind 1)."""
    names = ["part", "kind", "buckets", "row", "vec_id", "vector"]
    for b in batches:
        row, vec_id = b.column("row").to_numpy(), b.column("vec_id").to_numpy()
        own = b.column("lists")
        node = own.flatten().to_numpy().astype(np.int64)
        at = np.repeat(np.arange(b.num_rows), np.diff(own.offsets.to_numpy()))
        block = (row[at] * 0x9E3779B1 >> 16) % routes.blocks[node]
        rows = [(routes.part(node, block), 0, np.arange(len(at) + 1, dtype=np.int32), node << 32 | block, at)]
        ask = np.flatnonzero(vec_id % every == 0)
        if len(ask):
            at, node, _ = lists.value.search(asked(matrix(b.column("vector").take(pa.array(ask)))), ratio)
            at, n = ask[at], routes.blocks[node]
            at, node, block = np.repeat(at, n), np.repeat(node, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            part = routes.part(node, block)
            by = np.lexsort((node, part, at))
            at, node, block, part = at[by], node[by], block[by], part[by]
            first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (part[1:] != part[:-1])])) if len(at) else np.zeros(0, np.int64)
            rows.append((part[first], 1, np.append(first, len(at)).astype(np.int32), node << 32 | block, at[first]))
        for part, kind, offsets, buckets, at in rows:
            taken = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(np.full(len(part), kind, np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(buckets)), *[taken.column(c) for c in names[3:]]], names)


def _compared(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by part, vectors before queries: holds the vectors of one part, by bucket, and some queries at a time."""
    for part in _parts(batches):
        held: list[tuple] = []
        bucket = at = np.zeros(0, np.int64)
        for kind, b in part:
            if kind == 0:
                held.append((b.column("buckets").flatten().to_numpy(), b.column("row").to_numpy(), b.column("vec_id").to_numpy(), matrix(b.column("vector"))))
                continue
            if not held:
                continue
            if len(held) > 1 or not len(bucket):
                every = [np.concatenate(c) for c in zip(*held, strict=True)]
                by = np.argsort(every[0], kind="stable")
                held = [tuple(c[by] for c in every)]
                bucket, at = np.unique(held[0][0], return_index=True)
                at = np.append(at, len(by))
            _, row, vec_id, x = held[0]
            for i in range(0, b.num_rows, CHUNK):
                c = b.slice(i, CHUNK)
                best = Running(k, c.column("row").to_numpy(), c.column("vec_id").to_numpy(), matrix(c.column("vector")))
                asked_for = c.column("buckets")
                who, which = np.repeat(np.arange(c.num_rows), np.diff(asked_for.offsets.to_numpy())), asked_for.flatten().to_numpy()
                by = np.argsort(which, kind="stable")
                who, which = who[by], which[by]
                cuts = np.flatnonzero(np.diff(which)) + 1
                for a, z in zip([0, *cuts], [*cuts, len(which)], strict=True):
                    nth = np.searchsorted(bucket, which[a])
                    if nth < len(bucket) and bucket[nth] == which[a]:
                        own = slice(at[nth], at[nth + 1])
                        best.compare(who[a:z], row[own], vec_id[own], x[own])
                yield from best.taken()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple[int, pa.RecordBatch]]]:
    """The pieces (kind, rows) of each part, one part after another."""

    def pieces() -> Iterator[tuple[int, int, pa.RecordBatch]]:
        for b in batches:
            part, kind = b.column("part").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero((part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, z in zip([0, *cuts], [*cuts, len(part)], strict=True):
                if z > a:
                    yield int(part[a]), int(kind[a]), b.slice(a, z - a)

    for _, group in groupby(pieces(), itemgetter(0)):
        yield ((kind, b) for _, kind, b in group)


def nearest_neighbours(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding", target: float = TARGET, block_rows: int = BLOCK_ROWS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per vector whose id is divisible by ``every``, its k nearest others that were found: query_id, rank (from 1), vec_id, score.

    Nearness is the inner product of the original vectors in double precision, ties go to the smaller vec_id. ``target``
    is the share of true neighbours that the lists to be read are chosen for; a task holds ``part_bytes``
    of vectors, and lists are cut into blocks of ``block_rows``. Vectors that are null, zero or hold a null
    or non-finite component take no part, nor do rows without id, nor those of another length than most
    have. Rows that repeat an id are vectors each, and each a query; an empty table gives an empty result. Other columns play
    no part.
    """
    spark = vectors.sparkSession
    rows = vectors.where(taking_part(F.col(vec_id), F.col(vector))).select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    lengths = rows.select(F.size("vector").alias("length"), square.alias("square")).groupBy("length").agg(F.count("*").alias("n"), F.max("square").alias("square"))
    common = lengths.orderBy(F.desc("n"), "length").first()
    if not common:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == common["length"])
    sample = matrix(_sampled(rows, SAMPLE, common["n"]).select("vector").toArrow().column("vector"))
    lists = Lists.fit(sample, common["n"], float(np.sqrt(common["square"])))
    known = spark.sparkContext.broadcast(lists)
    indexed = checkpointed(rows.mapInArrow(partial(_index, known), StructType([*rows.schema.fields, spark.createDataFrame([], "lists array<int>").schema[0]])))
    ratio = measured_ratio(indexed, lists, k, target)
    size = np.zeros(len(lists.centroids), np.int64)
    for r in indexed.select(F.explode("lists").alias("node")).groupBy("node").count().collect():
        size[r["node"]] = r["count"]
    parts = max(1, -(-int(size.sum()) * 8 * common["length"] // part_bytes))
    routes = Routes(np.maximum(1, -(-size // block_rows)), np.cumsum(size) - size, size, parts)
    schema = StructType([*spark.createDataFrame([], "part int, kind int, buckets array<long>").schema, *indexed.schema[:3]])
    routed = indexed.mapInArrow(partial(_routed, known, routes, ratio, every), schema)
    dealt = routed.repartition(parts, "part").sortWithinPartitions("part", "kind")
    return _ranked(dealt.mapInArrow(partial(_compared, k), _FOUND), k).select("query_id", "rank", "vec_id", "score")
