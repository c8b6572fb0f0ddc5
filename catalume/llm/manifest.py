"""Merkle manifest of a dataset: a digest for each row, trees of them for each language, and a proof for each row.

Trees are walked by time-forward processing. Nodes are labelled by the place of the last leaf below them and their
level, so that children come before parents; a priority queue ordered by label hands each digest forward in time to
its parent, and in a second sweep, against the labels, each parent hands its children the rest of their proofs.
Between tasks the queue is a sort by label in the shuffle: a task has a block of ``2 ** levels`` neighbouring nodes
under one node, whose digest is a leaf of the next round's tree. Within a block the forward queue holds one or two
messages a level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..cluster import checkpointed
from .ordered import numbered, runs

#: Levels of the tree that one task climbs at a time: blocks are of 4,096 nodes, and three rounds do for 6.8e10 rows.
LEVELS = 12
#: The fields of a row that its digest covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step of a proof: what stands before and after the digest that is folded. Both are empty for a node without sibling.
STEPS = "array<struct<left:string,right:string>>"

Step = tuple[str, str]
#: End of the node, its level, and the ends and digests of its children.
Node = tuple[int, int, list[int], list[str]]


def leaf_digest(**changed: Column) -> Column:
    """SHA-256 over the fields of a row, each ``-`` if null, else its UTF-8 length, a colon and its value."""
    value = lambda c: changed.get(c, F.col(c)).cast("string")
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("-")) for c in FIELDS]).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(proof, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof's siblings, one after another."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def _height(nodes: int, levels: int) -> int:
    """Levels above so many nodes that stand alone, or those of a block."""
    return min((nodes - 1).bit_length(), levels)


def forward(digests: list[str], levels: int) -> tuple[str, list[Node]]:
    """The digest of the one node so many levels above the nodes, and the nodes between in the order of their labels."""
    if not levels:
        return digests[0], []
    queue: list[tuple[int, int, int, str]] = []
    done: list[Node] = []
    last = len(digests) - 1
    for at, digest in enumerate(digests):
        heappush(queue, (min(at | 1, last), 1, at, digest))
        # The sweep has come to the last leaf below these nodes, so all their children have sent.
        while queue and queue[0][0] == at:
            end, level = queue[0][:2]
            ends, below = [], []
            while queue and queue[0][:2] == (end, level):
                _, _, child, d = heappop(queue)
                ends.append(child)
                below.append(d)
            digest = hashlib.sha256("".join(below).encode()).hexdigest()
            done.append((end, level, ends, below))
            if level == levels:
                return digest, done
            heappush(queue, (min(end | (1 << (level + 1)) - 1, last), level + 1, end, digest))
    raise AssertionError("a block ends with its top")


def backward(nodes: list[Node], n: int, rest: tuple) -> list[tuple]:
    """The proofs of n leaves as nested pairs (step, rest), from that of the top, which comes last in ``nodes``."""
    if not nodes:
        return [rest]
    proofs: list[tuple] = [()] * n
    queue: list[tuple[int, int, tuple]] = [(-nodes[-1][0], -nodes[-1][1], rest)]
    for _, level, ends, digests in reversed(nodes):
        rest = heappop(queue)[2]
        for k, end in enumerate(ends):
            own = (("".join(digests[:k]), "".join(digests[k + 1 :])), rest)
            if level == 1:
                proofs[end] = own
            else:
                heappush(queue, (-end, 1 - level, own))
    return proofs


def _climb(levels: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in runs(batches, ["tree", "block"]):
        size = block.column("size")[0].as_py()
        digest, _ = forward(block.column("digest").to_pylist(), _height(size, levels))
        yield pa.RecordBatch.from_arrays([block.column("tree").slice(0, 1).combine_chunks(), block.column("block").slice(0, 1).combine_chunks(), pa.array([-(-size >> levels)], pa.int64()), pa.array([digest])], ["tree", "pos", "size", "digest"])


def _flat(proof: tuple) -> Iterator[Step]:
    while proof:
        step, proof = proof
        yield step


def _descend(levels: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in runs(batches, ["tree", "block"]):
        # The message from above sorts before the nodes.
        rest: tuple = ()
        for s in reversed(block.column("proof")[0].as_py()):
            rest = ((s["left"], s["right"]), rest)
        n = block.num_rows - 1
        nodes = block.slice(1).combine_chunks()
        digests = nodes.column("digest").to_pylist()
        proofs = backward(forward(digests, _height(nodes.column("size")[0].as_py(), levels))[1], n, rest)
        steps, offsets = [], np.zeros(n + 1, np.int32)
        for i, p in enumerate(proofs):
            steps.extend(_flat(p))
            offsets[i + 1] = len(steps)
        pairs = pa.StructArray.from_arrays([pa.array([s[0] for s in steps], pa.string()), pa.array([s[1] for s in steps], pa.string())], ["left", "right"])
        subroot = pa.array(block.column("subroot").slice(0, 1).to_pylist() * n, pa.string())
        rows = pa.Table.from_arrays([*[nodes.column(c) for c in ("tree", "pos", "digest", "payload")], pa.ListArray.from_arrays(pa.array(offsets), pairs), subroot], ["tree", "pos", "digest", "payload", "proof", "subroot"])
        yield from rows.to_batches()


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """nodes (tree, pos, size, digest, ...), the tops of their blocks, and so on until each tree is one node."""
    out = [nodes]
    most = nodes.agg(F.max("size")).first()[0] or 1
    while True:
        below = out[-1].select("tree", F.shiftright("pos", levels).alias("block"), "pos", "size", "digest")
        out.append(checkpointed(_blocks(below).mapInArrow(partial(_climb, levels), "tree string, pos long, size long, digest string")))
        if most <= 1 << levels:
            return out
        most = -(-most >> levels)


def _proofs(rounds: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The nodes of the first round with their proofs. above: tree, proof and subroot of each tree's top."""
    sent = above.withColumn("pos", F.lit(0).cast("long"))
    for k in range(len(rounds) - 2, -1, -1):
        nodes = rounds[k] if "payload" in rounds[k].columns else rounds[k].withColumn("payload", F.lit(None).cast("string"))
        payload = nodes.schema["payload"].dataType
        ask = sent.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("size"), F.lit("").alias("digest"), F.lit(None).cast(payload).alias("payload"), F.col("proof"), F.col("subroot"))
        own = nodes.select("tree", F.shiftright("pos", levels).alias("block"), "pos", "size", "digest", "payload", F.lit(None).cast(STEPS).alias("proof"), F.lit(None).cast("string").alias("subroot"))
        schema = StructType([own.schema["tree"], own.schema["pos"], StructField("digest", StringType()), StructField("payload", payload), ask.schema["proof"], StructField("subroot", StringType())])
        sent = _blocks(own.unionByName(ask)).mapInArrow(partial(_descend, levels), schema)
    return sent


def merkle_manifest(docs: DataFrame, levels: int = LEVELS, **also: Column) -> DataFrame:
    """Per row of ``docs``: doc_id, lang, leaf, place (among the leaves of its language, from 0), subroot (of its language),
    root, proof (from the leaf to the root) and the columns ``also``, made of the row.

    Leaves of a language ascend by doc_id, null first, then by digest; languages ascend by their bytes, null first.
    docs: doc_id, source, lang, n_chars, text; other columns play no part, whatever their names. Null and
    empty fields differ in the digest. Rows that repeat are leaves each, with one digest; which of them has which of
    their places is arbitrary. An empty table gives an empty result.
    """
    # Null sorts first as the empty string, before all that begin with the mark.
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf_digest().alias("digest"), F.struct(F.lit(0).alias("none"), *[c.alias(n) for n, c in also.items()]).alias("also"))
    ranked = numbered(rows, ["tree", "doc_id", "digest"])
    trees = checkpointed(ranked.groupBy("tree").agg(F.min("rank").alias("first"), F.count("*").alias("size")))
    leaves = ranked.join(trees, "tree").select("tree", (F.col("rank") - F.col("first")).alias("pos"), "size", "digest", F.struct("doc_id", "also").alias("payload"))
    leaves = checkpointed(leaves)
    rounds = _rounds(leaves, levels)
    # The subroots are the leaves of one more tree.
    subroots = numbered(rounds[-1].select("tree", "digest"), ["tree"], "pos")
    n = subroots.count()
    upper = _rounds(checkpointed(subroots.select(F.lit("").alias("tree"), "pos", F.lit(n).cast("long").alias("size"), "digest", F.struct("tree").alias("payload"))), levels)
    root = upper[-1].first()
    root = root["digest"] if root else None
    top = docs.sparkSession.range(1 if n else 0).select(F.lit("").alias("tree"), F.array().cast(STEPS).alias("proof"), F.lit(None).cast("string").alias("subroot"))
    above = _proofs(upper, top, levels).select(F.col("payload.tree").alias("tree"), "proof", F.col("digest").alias("subroot"))
    out = _proofs(rounds, checkpointed(above), levels)
    lang = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30))
    return out.select(F.col("payload.doc_id").alias("doc_id"), lang.alias("lang"), F.col("digest").alias("leaf"), F.col("pos").alias("place"), "subroot", F.lit(root).cast("string").alias("root"), "proof", *[F.col("payload.also")[n].alias(n) for n in also])


def tampered() -> Column:
    """The digest that a row has with 1 added to n_chars, where 7 divides the checksum of its doc_id; else null."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return F.when(hit, leaf_digest(n_chars=F.col("n_chars").cast("long") + 1))


def digest(manifest: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the column tampered, if it is not null) and verified."""
    out = manifest.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
