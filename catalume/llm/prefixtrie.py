"""The trie of conversation prefixes, with counts over members and subtrees.

Conversations are sorted by their paths (a digest of 16 bytes for each turn) and conv_id, and cut into shards by
Spark's range partitioner. Only prefixes that the paths on both sides of a cut share lie in more than one shard: the
trie of these splitter paths, the skeleton, is broadcast. Each shard finishes all its other nodes in one sweep with
a stack; of skeleton nodes it gives partial aggregates, which are reduced and then summed up the skeleton. Copies of
one conversation are cut apart as well, by conv_id, so no path is a hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cluster import checkpointed

#: Bytes of a turn's digest; two turns out of n share one with a chance of about n ** 2 / 2 ** 129.
WIDTH = 16
#: Nodes of the skeleton, which is broadcast, at most; with more of them there are fewer shards.
MOST_SKELETON = 200_000
#: Bytes of conv_ids that go to the reduction as one row.
CHUNK = 1 << 16
#: Rows that a sweep hands on together.
BATCH = 10_000

_NUMBERS = ("sid", "parent_sid", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_chars")
_SWEPT = ", ".join(f"{c} long" for c in _NUMBERS) + ", ends_sha256 string, ids string"
_SCHEMA = pa.schema([*[(c, pa.int64()) for c in _NUMBERS], ("ends_sha256", pa.string()), ("ids", pa.string())])
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, each a struct of turn, digest and n_chars.

    Null turns come first, turns alike in number go by digest; null role or text is empty; rows without conv_id belong to
    no conversation. Texts aren't shuffled; memory follows the longest conversation, with some 60 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("n_chars")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(whole: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """``paths`` with each conversation's first turns taken from the first of its family: conv_id c takes h = crc32(c) mod
    ``heads`` turns of conversation c - c mod ``family`` (all if it has fewer, none if there is none), then its own after its
    first h. A conversation can be left without turns."""
    first = whole.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("__first"), F.slice("turns", 1, heads - 1).alias("__given"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    given = F.slice(F.coalesce("__given", F.slice("turns", 1, 0)), F.lit(1), h)
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return whole.join(first, F.col("conv_id") - F.col("conv_id") % family == F.col("__first"), "left").select("conv_id", F.concat(given, own).alias("turns"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that both paths begin with."""
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    low = 0
    while n - low > 1:
        mid = (low + n) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            n = mid
    return low


def skeleton(cuts: list[tuple[bytes, bytes]]) -> tuple[list[dict[bytes, int]], list[int]]:
    """The trie of what the last path before and the first after each cut share: children by digest for each node, and
    each node's parent. Node 0 is the root; parents come before children."""
    children: list[dict[bytes, int]] = [{}]
    parents = [-1]
    for a, b in cuts:
        at = 0
        for k in range(_common(a, b)):
            turn = a[k * WIDTH : (k + 1) * WIDTH]
            if turn not in children[at]:
                children[at][turn] = len(children)
                children.append({})
                parents.append(at)
            at = children[at][turn]
    return children, parents


class _Open:
    """A node on the path at hand; ``sid`` is its number in the skeleton, ``row`` its place among the rows held back."""

    __slots__ = ("sid", "row", "n_chars", "n_convs", "conv_id", "children", "leaves", "saved", "ends")

    def __init__(self, sid: int | None, row: int, n_chars: int) -> None:
        self.sid, self.row, self.n_chars = sid, row, n_chars
        self.n_convs = self.children = self.leaves = self.saved = 0
        self.conv_id: int | None = None
        self.ends = None


def sweep(rows: Iterator[tuple[bytes, list[int], int]], children: list[dict[bytes, int]], chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of _SWEPT from the sorted (path, n_chars, conv_id) of a shard: finished nodes (sid null), partial aggregates of
    skeleton nodes, and their members' conv_ids in pieces. Holds one path and the nodes of one subtree below the skeleton."""
    stack = [_Open(0, -1, 0)]
    held: list[list] = []  # of the open subtree: conv_id, depth, row of the parent, counts and digest
    piece: list[str] = []
    length, first, before = 0, 0, b""

    def close() -> Iterator[tuple]:
        node, depth = stack.pop(), len(stack)
        above = stack[-1] if stack else None
        if above:
            above.n_convs += node.n_convs
            above.conv_id = node.conv_id if above.conv_id is None else min(above.conv_id, node.conv_id)
        if node.sid is not None:
            yield (node.sid, None, node.conv_id, depth, None, node.n_convs, node.children, node.leaves, node.saved, node.n_chars, None, None)
            return
        leaves = node.leaves or 1
        saved = node.saved + (node.n_convs - 1) * node.n_chars
        held[node.row] = [node.conv_id, depth, above.row, node.n_convs, node.children, leaves, saved, node.ends.hexdigest() if node.ends else NO_ENDS]
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        if above.sid is not None:
            for conv, at, up, n, kids, ends_in, worth, sha in held:
                yield (None, above.sid if up < 0 else None, conv, at, None if up < 0 else held[up][0], n, kids, ends_in, worth, None, sha, None)
            held.clear()

    def cut() -> tuple:
        row = (stack[-1].sid, None, first, None, None, None, None, None, None, None, None, ",".join(piece))
        piece.clear()
        return row

    seen = False
    for path, sizes, conv in rows:
        seen = True
        common = _common(before, path)
        if piece and (length >= chunk or path != before):
            yield cut()
        while len(stack) - 1 > common:
            yield from close()
        for k in range(common, len(path) // WIDTH):
            up = stack[-1]
            sid = None if up.sid is None else children[up.sid].get(path[k * WIDTH : (k + 1) * WIDTH])
            stack.append(_Open(sid, -1 if sid is not None else len(held), sizes[k]))
            if sid is None:
                held.append([])
        top = stack[-1]
        top.n_convs += 1
        top.conv_id = conv if top.conv_id is None else min(top.conv_id, conv)
        if top.sid is None:
            if top.ends is None:
                top.ends = hashlib.sha256(str(conv).encode())
            else:
                top.ends.update(f",{conv}".encode())
        else:
            if not piece:
                first, length = conv, 0
            piece.append(str(conv))
            length += len(piece[-1]) + 1
        before = path
    if piece:
        yield cut()
    while seen and stack:
        yield from close()


def _sweep(known: Broadcast, chunk: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (r for b in batches for r in zip(b.column("path").to_pylist(), b.column("sizes").to_pylist(), b.column("conv_id").to_pylist(), strict=True))
    out = []
    for row in sweep(rows, known.value, chunk):
        out.append(row)
        if len(out) == BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, ends_sha256) from sorted pieces of conv_ids, without holding more than one piece."""
    at, sha = None, None
    for b in batches:
        for sid, ids in zip(b.column("sid").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if sid != at:
                if sha:
                    yield pa.RecordBatch.from_pydict({"sid": [at], "ends_sha256": [sha.hexdigest()]})
                at, sha = sid, hashlib.sha256(ids.encode())
            else:
                sha.update(f",{ids}".encode())
    if sha:
        yield pa.RecordBatch.from_pydict({"sid": [at], "ends_sha256": [sha.hexdigest()]})


def _shards(routes: DataFrame, n: int | None) -> tuple[DataFrame, list[dict[bytes, int]], list[int]]:
    """routes sorted into shards, with their skeleton; the driver gets the first and last path of each shard."""
    shards = checkpointed(routes.repartitionByRange(*[n] * bool(n), "path", "conv_id").sortWithinPartitions("path", "conv_id"))
    while True:
        ends = sorted(shards.select("path", F.spark_partition_id().alias("part")).groupBy("part").agg(F.min("path"), F.max("path")).collect())
        children, parents = skeleton([(bytes(a[2]), bytes(b[1])) for a, b in zip(ends, ends[1:])])
        if len(children) <= MOST_SKELETON or len(ends) == 1:
            return shards, children, parents
        shards = checkpointed(shards.repartitionByRange(len(ends) // 2, "path", "conv_id").sortWithinPartitions("path", "conv_id"))


def prefix_trie(whole: DataFrame, n_shards: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Per node of the trie of conversations (``paths``: conv_id, turns): conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens (characters of its subtree's last turns that members after a first repeat)
    and ends_sha256 (of the conv_ids that end there).

    There are as many shards as Spark's shuffle has partitions, or ``n_shards``. The root has depth 0 and no parent. Conversations without turns are members of the root alone. No conversations give no nodes.
    """
    spark = whole.sparkSession
    sizes: Column = F.transform("turns", lambda t: t["n_chars"])
    routes = whole.select(F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"), sizes.alias("sizes"), "conv_id")
    shards, children, parents = _shards(routes, n_shards)
    known = spark.sparkContext.broadcast(children)
    swept = checkpointed(shards.mapInArrow(partial(_sweep, known, chunk), _SWEPT))
    total = {r["sid"]: r for r in swept.where("sid is not null and ids is null").groupBy("sid").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("n_chars").alias("n_chars"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]).collect()}
    # Children have larger numbers than their parents.
    kids, leaves, saved, done = [0] * len(parents), [0] * len(parents), [0] * len(parents), []
    for sid in range(len(parents) - 1, -1, -1) if total else ():
        r, up = total[sid], parents[sid]
        kids[sid] += r["n_children"]
        leaves[sid] = leaves[sid] + r["n_leaves"] if kids[sid] else 1
        saved[sid] += r["saved_tokens"] + (r["n_convs"] - 1) * r["n_chars"]
        done.append((sid, r["conv_id"], r["depth"], total[up]["conv_id"] if sid else None, r["n_convs"], kids[sid], leaves[sid], saved[sid]))
        if sid:
            kids[up], leaves[up], saved[up] = kids[up] + 1, leaves[up] + leaves[sid], saved[up] + saved[sid]
    joints = spark.createDataFrame(done, "sid long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    pieces = swept.where("ids is not null").select("sid", F.col("conv_id").alias("first"), "ids")
    ends = pieces.repartition("sid").sortWithinPartitions("sid", "first").select("sid", "ids").mapInArrow(_digests, "sid long, ends_sha256 string")
    joints_ended = joints.join(ends, "sid", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    # Both have a row for each skeleton node at most, which MOST_SKELETON bounds.
    tops = F.broadcast(joints.select(F.col("sid").alias("parent_sid"), F.col("conv_id").alias("__parent")))
    local = swept.where("sid is null").join(tops, "parent_sid", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "__parent"))
    return local.select(NODE).unionByName(joints_ended.select(NODE))
