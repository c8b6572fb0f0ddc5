"""N-gram Jaccard join by a MinHash LSH forest.

A tree of the forest is the sorted prefix trie of one run of MinHash values: the keys of
all texts in order, in which texts below one inner node of the trie are neighbours. Two
texts are candidates if they share a prefix in some tree. Matching starts at whole keys and
prefixes are shortened, value by value, until a sample of links finds the target recall.
All candidates are verified on their whole sets of word shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import checkpointed
from ..operators.graph import connected_components
from . import textkit as K

#: Words of a shingle, and the least similarity of a link.
SHINGLE, SIMILARITY = 5, 0.8
#: Trees of the forest, and the values of a whole key; each value is two bytes of the key.
TREES, DEPTH = 32, 8
#: Share of the sampled links that a prefix must find.
RECALL = 0.999
#: Texts of the sample that recall is measured on, the most shingles of one, and the copies at the threshold planted for each.
SAMPLE, SAMPLE_SHINGLES, PLANTED = 256, 2_000, 8
#: Shingles that one task compares with each other: an eighth of a group's, between these.
LEAST_BLOCK, BLOCK_SHINGLES = 10_000, 100_000
#: Shingles that a text counts for at least when blocks are cut, so that short texts don't fill one by their number.
LEAST_WEIGHT = 100
#: Candidates up to which their list is broadcast; a longer list is joined by a shuffle.
BROADCAST_ROWS = 500_000

_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, (TREES * DEPTH,), dtype=np.uint64) | np.uint64(1)
_KEY = 2 * DEPTH
_LINKS = "node long, label long, links long"


def shingles(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all shingles, text after text, and where each text's begin; a text of fewer words is one shingle."""
    data, offsets = K.utf8(batch.column("text"))
    starts, ends, first = K.spans(data, offsets, K.SPACE)
    hashes = K.word_hashes(data, starts, ends)
    found, at = K.windows(hashes, first, SHINGLE)
    doc = K.text_of_words(first)
    parts, docs = [found], [doc[at]]
    for n in range(1, SHINGLE):
        whole, at = K.windows(hashes, first, n)
        short = np.diff(first)[doc[at]] == n
        parts.append(whole[short])
        docs.append(doc[at][short])
    found, doc = np.concatenate(parts), np.concatenate(docs)
    order = np.argsort(doc, kind="stable")
    return found[order], np.searchsorted(doc[order], np.arange(batch.num_rows + 1))


def signatures(found: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The values of each non-empty set, (sets, trees, depth): of each seed's least shingle 16 bits."""
    out = np.zeros((len(first), len(_SEEDS)), np.uint16)
    for k, seed in enumerate(_SEEDS if len(first) else ()):
        x = found * seed
        x ^= x >> np.uint64(32)
        out[:, k] = K.mix(np.minimum.reduceat(x * np.uint64(0x94D049BB133111EB), first)).astype(np.uint16)
    return out.reshape(len(first), TREES, DEPTH)


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each two signatures the values of the longest prefix that they share in any tree."""
    return np.cumprod(a == b, axis=-1).sum(-1).max(-1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.slices(batches, "text", 1 << 20):
        found, first = shingles(batch)
        some = np.flatnonzero(np.diff(first) > 0)
        keys = np.zeros((batch.num_rows, TREES * _KEY), np.uint8)
        keys[some] = signatures(found, first[some]).astype(">u2").view(np.uint8).reshape(len(some), TREES * _KEY)
        column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(TREES * _KEY), batch.num_rows, [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(np.diff(first)), column], names=["doc_id", "digest", "n_shingles", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.slices(batches, "text"):
        found, first = shingles(batch)
        own = [np.unique(found[first[i] : first[i + 1]]) for i in range(batch.num_rows)]
        at = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "shingles"])


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text's SHA-256, null for a null text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def _texts_of(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of one row, or of rows that repeat, for each of the nodes (node, digest, rep)."""
    wanted = nodes.select(F.col("digest").alias("__digest"), F.col("rep").alias("__rep"), "node")
    if nodes.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    return texts.join(wanted, (F.col("digest") == F.col("__digest")) & F.col("doc_id").eqNullSafe(F.col("__rep"))).select("node", "text")


# The trie of each tree


def _runs(depth: int):
    """Sorted keys as runs that share a prefix: node, tree, run and the run's first node here. A run of one
    goes unless it is at an end of its partition, where ``opens`` and ``closes`` tell its prefix."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, run, head, opened = None, -1, 0, False
        for batch in _and_end(batches):
            if batch is None:
                if held is None:
                    return
                tree, prefix, node = (x[:0] for x in held[:3])
            else:
                if not batch.num_rows:
                    continue
                tree, node = batch.column("tree").to_numpy(), batch.column("node").to_numpy()
                keys = batch.column("key").cast(pa.binary(_KEY))
                prefix = np.frombuffer(keys.buffers()[1], np.uint8)[keys.offset * _KEY : (keys.offset + len(keys)) * _KEY].reshape(-1, _KEY)[:, : 2 * depth]
            if held is not None:
                tree, prefix, node = np.concatenate([held[0], tree]), np.concatenate([held[1], prefix]), np.concatenate([held[2], node])
            new = np.ones(len(tree), bool)
            new[1:] = (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1]).any(1)
            if held is not None:
                new[0] = held[3]
            upto = len(tree) - (batch is not None)
            runs = run + np.cumsum(new)
            heads = np.where(new, node, 0)
            first = np.maximum.accumulate(np.where(new, np.arange(len(tree)), -1))
            heads = np.where(first >= 0, node[np.maximum(first, 0)], head)
            alone = new & np.append(new[1:], True)
            keep = ~alone[:upto]
            edge = lambda i: bytes([tree[i]]) + prefix[i].tobytes()
            opens, closes = [None] * upto, [None] * upto
            if not opened and upto:
                opens[0], opened, keep[0] = edge(0), True, True
            if batch is None:
                closes[-1], keep[-1] = edge(-1), True
            if upto:
                at = np.flatnonzero(keep)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[:upto][at]), pa.array(tree[:upto][at]), pa.array((part << 33) + runs[:upto][at]), pa.array(heads[:upto][at]), pa.array([opens[i] for i in at], pa.binary()), pa.array([closes[i] for i in at], pa.binary())],
                    names=["node", "tree", "run", "head", "opens", "closes"],
                )
                run, head = int(runs[upto - 1]), int(heads[upto - 1])
            if batch is not None:
                held = (tree[-1:], prefix[-1:], node[-1:], bool(new[-1]))

    return find


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def prefix_runs(nodes: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(node, tree, run) for texts that share a prefix of so many values in a tree with others, and edges (a, b)
    that connect each run. nodes: node, keys.

    Keys are sorted over all partitions, so no prefix, however common, comes together in one task; where a run goes
    on in the next partition is told from two rows of each partition.
    """
    tree = F.sequence(F.lit(0), F.lit(TREES - 1))
    each = nodes.select("node", F.explode(F.transform(tree, lambda t: F.struct(t.cast("int").alias("tree"), F.substr("keys", t * _KEY + 1, F.lit(_KEY)).alias("key")))).alias("k")).select("node", "k.tree", "k.key")
    order = ["tree", "key", "node"]
    found = each.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs(depth), "node long, tree int, run long, head long, opens binary, closes binary")
    found = checkpointed(found)
    ends = found.where("opens is not null or closes is not null").select("run", "head", "opens", "closes").collect()
    parts: dict[int, dict] = {}
    for r in ends:
        part = parts.setdefault(r.run >> 33, {})
        if r.opens is not None:
            part["first"] = r
        if r.closes is not None:
            part["last"] = r
    same, edges, before = {}, [], None
    for p in sorted(parts):
        first, last = parts[p]["first"], parts[p]["last"]
        if before is not None and bytes(before.closes) == bytes(first.opens):
            same[first.run] = same.get(before.run, before.run)
            edges.append((first.head, before.head))
        before = last
    spark = nodes.sparkSession
    joined = spark.createDataFrame(list(same.items()), "__run long, __same long")
    # Two rows of a partition at most.
    members = found.join(F.broadcast(joined), F.col("run") == F.col("__run"), "left").select("node", "tree", F.coalesce("__same", "run").alias("run"))
    links = _by_least(found.where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b")))
    return members, links.unionByName(spark.createDataFrame(edges, "a long, b long"))


def _by_least(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same nodes as those given: each a, and each b of it, with the least b of that a.

    For texts that share their b's, as near copies share the heads of their runs, this is about one edge for each text
    and not one for each tree. An a has one b for each tree or block at most.
    """
    own = edges.groupBy("a").agg(F.collect_set("b").alias("bs"))
    return own.select(F.explode(F.array_append("bs", F.col("a"))).alias("a"), F.array_min("bs").alias("b")).where("a != b").distinct()


# Recall


def _planted(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Longest common prefixes of each set and copies of it that are as unlike as a link may be."""
    out = []
    for i, own in enumerate(sets):
        keep = int(np.ceil(2 * len(own) * similarity / (1 + similarity) - 1e-9))
        if keep == len(own):
            continue
        draw = np.random.default_rng(i)
        copies = [np.concatenate([draw.permutation(own)[:keep], draw.integers(0, 1 << 63, len(own) - keep, np.int64).view(np.uint64)]) for _ in range(PLANTED)]
        signed = signatures(np.concatenate([own, *copies]), np.arange(PLANTED + 1) * len(own))
        out.append(common_prefix(signed[:1], signed[1:]))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _sampled_links(sample: list[tuple[bytes, np.ndarray]], similarity: float):
    """For each slice of texts the links with texts of the sample, found by comparing all sets, counted by longest common prefix."""
    digests, sets = [d for d, _ in sample], [s for _, s in sample]
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    known, begin = np.unique(flat[order], return_index=True)
    owner, begin = owner[order], np.append(begin, len(flat))
    signed = signatures(flat, np.cumsum(np.append(0, sizes))[:-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(DEPTH + 1, np.int64)
        for batch in K.slices(batches, "text"):
            found, first = shingles(batch)
            k = np.minimum(np.searchsorted(known, found), len(known) - 1)
            hit = np.flatnonzero(known[k] == found)
            doc = np.searchsorted(first, hit, "right") - 1
            for d in np.unique(doc):
                own = np.unique(found[first[d] : first[d + 1]])
                j = np.unique(k[hit[doc == d]])
                shared = np.zeros(len(sets), np.int64)
                for a, b in zip(begin[j], begin[j + 1], strict=True):
                    shared[owner[a:b]] += 1
                near = shared >= (similarity - 1e-9) * (len(own) + sizes - shared)
                if near.any():
                    digest, mine = batch.column("digest")[int(d)].as_py(), signatures(own, np.zeros(1, np.int64))
                    linked = [s for s in np.flatnonzero(near) if digests[s] != digest]
                    counts += np.bincount(common_prefix(mine, signed[linked]), minlength=DEPTH + 1) if linked else 0
        yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(counts), DEPTH + 1).cast(pa.list_(pa.int64()))], names=["n"])

    return count


def measured_recall(texts: DataFrame, firsts: DataFrame, similarity: float) -> dict[int, float]:
    """The recall of each prefix length from the longest to 1: the lesser of its shares of two kinds of links of
    a bounded sample of texts (by a hash): those with all rows, found by brute force, and those with
    planted copies that are as unlike as a link may be."""
    chosen = firsts.where(F.col("n_shingles").between(1, SAMPLE_SHINGLES)).orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE).select("node", "digest", "rep")
    sets = {r.node: np.array(r.shingles, np.int64).view(np.uint64) for r in _texts_of(texts, chosen).mapInArrow(_sets, "node long, shingles array<long>").collect()}
    if not sets:
        return {d: 1.0 for d in range(DEPTH, 0, -1)}
    digests = {r.node: bytes(r.digest) for r in chosen.collect()}
    sample = sorted(((digests[n], s) for n, s in sets.items()), key=lambda x: x[0])
    totals = texts.where("digest is not null").select("text", "digest").mapInArrow(_sampled_links(sample, similarity), "n array<long>").agg(*[F.sum(F.col("n")[d]).alias(f"n{d}") for d in range(DEPTH + 1)]).first()
    linked = np.array([x or 0 for x in totals])
    planted = np.bincount(_planted([s for _, s in sample], similarity), minlength=DEPTH + 1)
    share = lambda n, d: n[d:].sum() / n.sum() if n.sum() else 1.0
    return {d: float(min(share(linked, d), share(planted, d))) for d in range(DEPTH, 0, -1)}


def shortened(recalls: dict[int, float], recall: float) -> int:
    """Prefixes shortened from the whole key on until one has the recall."""
    for depth in sorted(recalls, reverse=True):
        if recalls[depth] >= recall:
            return depth
    raise ValueError(f"no prefix of {TREES} trees finds {recall} of the sampled links; the most is {max(recalls.values()):.4f}")


# Verification


def _shared(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Size of the intersection of each two of n sets, given as (set number, value) pairs."""
    order = np.lexsort((doc, values))
    doc, values = doc[order], values[order]
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(values)))
    out = np.zeros((n, n), np.float32)
    rare, common = np.flatnonzero((size > 1) & (size <= 12)), np.flatnonzero(size > 12)
    for c in np.unique(size[rare]):
        rows = doc[begin[rare[size[rare] == c]][:, None] + np.arange(c)]
        for i in range(c):
            for j in range(i + 1, c):
                np.add.at(out, (rows[:, i], rows[:, j]), 1)
    out += out.T
    for part in np.array_split(common, -(-len(common) // 4096)) if len(common) else ():
        columns = np.repeat(np.arange(len(part)), size[part])
        rows = np.concatenate([doc[begin[k] : begin[k] + size[k]] for k in part])
        m = np.zeros((n, len(part)), np.float32)
        m[rows, columns] = 1
        out += m @ m.T
    return out


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())


def verify(rows: pa.Table, similarity: float) -> pa.Table:
    """Links within a block, or between two blocks, of a group of texts: per text their number, and the least text it is connected with here.

    Compared are texts that share a run; pairs inside one block where low = high alone; and in the group of a
    tree's run (tree 0 or more) those that share no run of an earlier tree, so that each pair is compared once.
    """
    ids = rows["node"].to_numpy()
    keep = np.sort(np.unique(ids, return_index=True)[1])  # repeated rows of one text once
    one = rows.take(pa.array(keep)).combine_chunks() if len(keep) < len(ids) else rows.combine_chunks()
    ids, block, copies = (one[c].to_numpy() for c in ("node", "block", "copies"))
    n, tree = len(ids), one["tree"][0].as_py()
    runs, _ = _lists(one["runs"])
    runs = runs.reshape(n, TREES)
    asked, earlier = np.zeros((n, n), bool), np.zeros((n, n), bool)
    for t in range(TREES):
        same = (runs[:, t, None] == runs[None, :, t]) & (runs[:, t, None] >= 0)
        if t == tree:
            asked = same & ~earlier
            break
        if tree < 0:
            asked |= same
        else:
            earlier |= same
    np.fill_diagonal(asked, False)
    if one["low"][0].as_py() != one["high"][0].as_py():
        asked &= block[:, None] != block[None, :]
    values, lens = _lists(one["shingles"])
    both = _shared(np.repeat(np.arange(n), lens), values, n)
    linked = asked & (both >= (similarity - 1e-6) * np.maximum(lens[:, None] + lens[None, :] - both, 1))
    links = linked @ copies
    label = np.argsort(np.argsort(ids))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], n).min(1, initial=n))
        if (least == label).all():
            break
        label = least
    some = np.flatnonzero(linked.any(1))
    return pa.table({"node": ids[some], "label": np.sort(ids)[label[some]], "links": links[some].astype(np.int64)})


def _with_component(rows: DataFrame, per_component: DataFrame) -> DataFrame:
    """rows with the columns of their component (component, n = its rows, ...). The few components that hold more
    than a thousandth of all rows are broadcast, so that no task gets all rows of one."""
    total = per_component.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * 1000 > total
    if per_component.where(hot).isEmpty():
        return rows.join(per_component, "component")
    large = per_component.where(hot).withColumnRenamed("component", "__large")
    marked = rows.join(F.broadcast(large), F.col("component") == F.col("__large"), "left")
    others = marked.where("__large is null").select(*rows.columns).join(per_component.where(~hot), "component")
    return marked.where("__large is not null").drop("__large").unionByName(others)


def _units(members: DataFrame, edges: DataFrame, firsts: DataFrame) -> DataFrame:
    """node, runs (by tree, -1 for none) and the groups it is verified in: tree, unit, blocks.

    Texts that runs connect are verified as one group while that is no more work than its runs one by one, as
    among near copies. A group that chains of unlike texts have made large is verified run by run.
    """
    weight = F.greatest("n_shingles", F.lit(LEAST_WEIGHT))
    w = firsts.select("node", weight.alias("w"))
    component = connected_components(edges)
    block = F.least(F.greatest(F.sum("w") / F.lit(8), F.lit(LEAST_BLOCK)), F.lit(BLOCK_SHINGLES))
    blocks = F.ceil(F.sum("w") / block).cast("int").alias("blocks")
    whole = component.join(w, "node").groupBy("component").agg(F.count("*").alias("n"), blocks)
    by_run = members.join(w, "node").groupBy("tree", "run").agg(F.count("*").alias("n"), F.min("node").alias("node"), blocks).where("n > 1")
    work = by_run.join(component, "node").groupBy("component").agg(F.sum(F.col("n") * F.col("n")).alias("by_runs"))
    split = whole.join(work, "component").withColumn("split", (F.col("blocks") > 1) & (F.col("by_runs") < F.col("n") * F.col("n")))
    placed = checkpointed(_with_component(component, checkpointed(split.select("component", "n", "blocks", "split"))))
    own = placed.where("not split").select("node", F.lit(-1).alias("tree"), F.col("component").alias("unit"), "blocks")
    parted = members.join(placed.where("split").select("node"), "node").join(by_run.select("run", "blocks"), "run").select("node", "tree", F.col("run").alias("unit"), "blocks")
    lists = members.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("tree", "run"))).alias("m"))
    runs = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.coalesce(F.try_element_at("m", t), F.lit(-1)))
    return own.unionByName(parted).join(lists.select("node", runs.alias("runs")), "node")


def _links(texts: DataFrame, firsts: DataFrame, similarity: float, recall: float) -> DataFrame:
    """node, label, links of all texts that are linked with others."""
    depth = shortened(measured_recall(texts, firsts, similarity), recall)
    members, edges = prefix_runs(firsts.where("n_shingles > 0").select("node", "keys"), depth)
    units = checkpointed(_units(members, edges, firsts))
    wanted = firsts.join(units.select("node").distinct(), "node", "left_semi").select("node", "digest", "rep", "copies")
    wanted = checkpointed(wanted)
    sets = _texts_of(texts, wanted).mapInArrow(_sets, "node long, shingles array<long>")
    block = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    cells = units.join(wanted.select("node", "copies"), "node").withColumn("block", block).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("node", "copies", "runs", "tree", "unit", "block", F.least("block", "__other").alias("low"), F.greatest("block", "__other").alias("high"))
    pairs = sets.join(cells, "node")

    def check(rows: pa.Table) -> pa.Table:
        return verify(rows, similarity)

    return checkpointed(pairs.groupBy("tree", "unit", "low", "high").applyInArrow(check, _LINKS))


def _known(docs: DataFrame, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, digest of each row; and for each distinct text digest, rep (its least doc_id), copies, links and class: the class's least doc_id and that text's digest."""
    texts = _texts(docs)
    signed = checkpointed(texts.mapInArrow(_sign, "doc_id long, digest binary, n_shingles long, keys binary"))
    firsts = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    # Kept, so that the numbers stay.
    firsts = checkpointed(firsts.withColumn("node", F.monotonically_increasing_id()))
    links = _links(texts, firsts, similarity, recall)
    per_text = links.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = connected_components(_by_least(links.where("label != node").select(F.col("node").alias("a"), F.col("label").alias("b"))))
    known = firsts.select("node", "digest", "rep", "copies").join(per_text, "node", "left").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    leader = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "digest"))
    known = checkpointed(known)
    known = _with_component(known, checkpointed(known.groupBy("component").agg(F.count("*").alias("n"), leader.alias("leader"))))
    return signed.select("doc_id", "digest"), known.select("digest", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.col("leader.rep").alias("class_id"), (F.col("leader.digest") == F.col("digest")).alias("leads"))


def jaccard_classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Per row of ``docs``: doc_id, class_id (the least doc_id of its class), n_links, n_copies.

    Two documents are linked if their sets of five-word shingles (words are parted by space and 9
    to 13; a shorter text is one shingle) have a Jaccard similarity of ``similarity`` or more, or if
    their texts are equal; a class is what links connect. n_links counts the other rows a row is
    linked with, n_copies those with an equal text. docs: doc_id, text; other columns are ignored.
    Texts without a word are linked with equal ones only; a null text with none, its class is its own
    doc_id. Rows that repeat are copies of each other; an empty table gives an empty result.

    Equal texts are compared once, by SHA-256. Candidates are verified in blocks of bounded size inside
    tasks, which return a row for each text and not for each pair. A similarity so low that the forest
    can't find ``recall`` of the links is an error.
    """
    rows, known = _known(docs, similarity, recall)
    known = known.withColumnRenamed("digest", "__digest")
    out = rows.join(known, F.col("digest") == F.col("__digest"), "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), (F.coalesce("copies", F.lit(1)) - 1).alias("n_copies"))


def one_of_each_class(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row of each class, that with the least doc_id (a null one only where there is no other), all columns kept.

    Rows are told apart by doc_id and text, so a doc_id that stands at several texts loses only the rows whose
    class has another leader; of rows that repeat one stays, and all rows with a null text. An empty table stays empty.
    """
    rows, known = _known(docs, similarity, recall)
    copied = checkpointed(known.where("not leads or copies > 1").select(F.col("digest").alias("__digest"), F.when(F.col("leads"), F.struct("rep")).alias("__keep")))
    again = checkpointed(rows.where("digest is not null").groupBy("digest", "doc_id").count().where("count > 1").select(F.col("digest").alias("__again")))
    few = copied.count() <= BROADCAST_ROWS
    # The row as one struct, so that no column of docs can clash with those used here.
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.unhex(F.sha2(F.col("text").cast("string"), 256)).alias("digest"))
    left = packed.join(F.broadcast(copied) if few else copied, F.col("digest") == F.col("__digest"), "left")
    left = left.where(F.col("__digest").isNull() | (F.col("__keep").isNotNull() & F.col("id").eqNullSafe(F.col("__keep.rep"))))
    if not again.isEmpty():
        rare = left.join(again, F.col("digest") == F.col("__again"), "left_semi").dropDuplicates(["digest"])
        left = left.join(again, F.col("digest") == F.col("__again"), "left_anti").unionByName(rare)
    return left.select("row.*")
