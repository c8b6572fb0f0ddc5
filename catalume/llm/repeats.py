"""Removal of long repeated passages by a logarithmic family of sparse suffix arrays.

Of each text, only the suffixes at sampled places are indexed: those whose first 32
bytes have the least hash among all that a 100-byte string holds, so equal strings
are sampled at equal places. A batch's suffixes are sorted: those that begin with the same
sampled bytes are neighbours, and among them those whose whole surroundings are equal. One scan of
neighbours tells which surroundings came before; those of one sampled place that are not all alike
are told apart string by string. An index keeps the sorted suffixes of its batches as
levels in Parquet; a new batch is scanned together with what the levels hold of its suffixes, becomes a level, and
levels of about equal size merge.

Strings are compared by two independent fingerprints: whole surroundings by 128 bits, single strings
by 96. Among n different ones two are taken for equal with a chance of n * n / 2 ** 129, or 2 ** 97: 1e-14
and 0.03 for the 3e12 sampled suffixes and 7e13 strings in question of 100 TB.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import written
from . import textkit as K

#: Bytes of a repeated string, and of the part of it that is sampled.
LENGTH, SAMPLED = 100, 32
#: Sampled suffixes of one partition, about.
PARTITION = 1_000_000
#: Bytes of text that are hashed together; a dozen arrays of eight times as many bytes exist meanwhile.
SLICE = 1 << 19
#: Bits of the filter that keeps texts without repeats out of shuffles; its size is fixed.
FILTER_BITS = 1 << 24
#: Of one document in so many, frequent strings are looked up beforehand, to be spread over partitions.
FREQUENT_IN, FREQUENT_MOST = 64, 4096

_ROWS = "kind int, route long, class long, check long, doc long, at int, n int"
_FOUND = "kind int, route long, parts long, doc long, at int, n int"
_ENTRIES = "head long, key long, class long, check long, doc long, at int, n int"
_SPAN, _SUFFIX, _SPREAD, _DETAIL = 1, 2, 3, 4


class Levels:
    """Sorted arrays of distinct values, of any type that sorts, whose sizes grow geometrically."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def add(self, values: np.ndarray) -> np.ndarray:
        """Which of a batch's values are new, to the levels and within the batch; the first of equals is."""
        batch, first = np.unique(values, return_index=True)
        new = np.ones(len(batch), bool)
        for level in self.levels:
            at = np.minimum(np.searchsorted(level, batch), len(level) - 1)
            new &= level[at] != batch
        run = batch[new]
        while self.levels and len(self.levels[-1]) <= 2 * len(run):
            run = np.concatenate([self.levels.pop(), run])
            run.sort(kind="stable")
        if len(run):
            self.levels.append(run)
        out = np.zeros(len(values), bool)
        out[first[new]] = True
        return out


def suffixes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of 100-byte strings with the same sampled place: text number, first start, number of strings, the
    sampled place, fingerprint of the sampled bytes, and two fingerprints of all bytes of the run."""
    none = np.zeros(0, np.int64)
    span = LENGTH - SAMPLED + 1
    if len(data) < LENGTH:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    sums = K.prefix_sums(data)
    at = np.arange(len(data) - SAMPLED + 1)
    hashes = K.range_hash(sums, at, at + SAMPLED)
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | at.view(np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: width - span], least[span - width :])
    place = (least & np.uint64(0xFFFFFFFF)).view(np.int64)
    start = np.arange(len(place))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    inside = start + LENGTH <= offsets[doc + 1]
    edge = np.ones(len(place), bool)
    edge[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
    first = np.flatnonzero(edge & inside)
    last = np.flatnonzero(inside & np.append(edge[1:] | ~inside[1:], True))
    key, whole = hashes[place[first]], K.range_hash(sums, first, last + LENGTH)
    check = K.range_hash(K.prefix_sums(data, K.CHECK_BASE), first, last + LENGTH, K.CHECK_BASE)
    return doc[first], first, last - first + 1, place[first], key, K.mix(key * np.uint64(3) + whole), check


def _batch(schema: str, *columns) -> pa.RecordBatch:
    """A batch of a schema given as ``name type, ...`` of longs and ints; single values are repeated."""
    named = [c.split() for c in schema.split(", ")]
    size = max(len(c) for c in columns if isinstance(c, np.ndarray))
    full = lambda x, t: pa.array(np.ascontiguousarray(np.broadcast_to(x, size)).astype(np.uint64 if getattr(x, "dtype", None) == np.uint64 else np.int64).view(np.int64).astype(np.int32 if t == "int" else np.int64))
    return pa.RecordBatch.from_arrays([full(c, t) for c, (_, t) in zip(columns, named, strict=True)], names=[n for n, _ in named])


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each text joined where they touch."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    text = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    far = int(end.max()) + 1
    upto = np.maximum.accumulate(end + text * far) - text * far
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > upto[:-1])])
    begin = np.flatnonzero(new)
    return doc[begin], start[begin], np.maximum.reduceat(upto, begin)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.slices(batches, "text", SLICE):
        data, offsets = K.utf8(batch.column("text"))
        yield _batch("key long", np.unique(suffixes(data, offsets)[4]))


def _scan(spread: np.ndarray):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "text", SLICE):
            data, offsets = K.utf8(batch.column("text"))
            text, at, n, _, key, cls, check = suffixes(data, offsets)
            doc = batch.column("doc").to_numpy()[text]
            at = at - offsets[text]
            order = np.lexsort((at, doc, check, cls))
            own = np.ones(len(order), bool)
            own[order[1:]] = (cls[order][1:] != cls[order][:-1]) | (check[order][1:] != check[order][:-1])
            # Of equal runs in one slice, all but the first are repeats already.
            d, s, e = _merged(doc[~own], at[~own], (at + n + LENGTH - 1)[~own])
            yield _batch(_ROWS, _SPAN, K.mix(d.astype(np.uint64)), 0, 0, d, s, e - s)
            many = np.isin(key, spread)
            yield _batch(_ROWS, np.where(many, _SPREAD, _SUFFIX)[own], np.where(many, cls, key)[own], cls[own], check[own], doc[own], at[own], n[own])

    return scan


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All sampled suffixes: their first eight bytes as a number that sorts as they do, and what tells them apart."""
    for batch in K.slices(batches, "text", SLICE):
        data, offsets = K.utf8(batch.column("text"))
        text, at, n, place, key, cls, check = suffixes(data, offsets)
        head = np.zeros(len(place), np.uint64)
        for j in range(8):
            head = (head << np.uint64(8)) | data[place + j]
        doc = batch.column("doc").to_numpy()[text]
        yield _batch(_ENTRIES, head ^ np.uint64(1 << 63), key, cls, check, doc, at - offsets[text], n)


def _index(since: int):
    """Scan of neighbours among sorted suffixes: runs that came before are repeats. Of the others, those of one
    sampled place with several kinds of surroundings go on to be told apart string by string. Suffixes of documents below ``since`` are known from before."""

    def detail(kind, route, doc, at, n) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]])) if len(route) else np.zeros(0, np.int64)
        count = np.diff(np.append(begin, len(route)))
        count = np.repeat(count, count)
        parts = np.where(kind == _SPREAD, 256, np.maximum(1, count // 500))
        go = np.flatnonzero((count > 1) | (kind == _SPREAD))
        for i in range(0, len(go), 100_000):
            k = go[i : i + 100_000]
            yield _batch(_FOUND, _DETAIL, np.where(kind == _SPREAD, 0, route)[k], parts[k], doc[k], at[k], n[k])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, [np.zeros(0, np.int64)] * 5
        for batch in batches:
            kind, route, cls, check, doc, at, n = (batch.column(i).to_numpy() for i in range(7))
            span = kind == _SPAN
            if span.any():
                yield _batch(_FOUND, _SPAN, 0, 0, doc[span], at[span], n[span])
            kind, route, cls, check, doc, at, n = (x[~span] for x in (kind, route, cls, check, doc, at, n))
            if not len(kind):
                continue
            new = np.ones(len(kind), bool)
            new[1:] = (route[1:] != route[:-1]) | (cls[1:] != cls[:-1]) | (check[1:] != check[:-1])
            new[0] = last != (route[0], cls[0], check[0])
            last = (route[-1], cls[-1], check[-1])
            again = ~new & (doc >= since)
            if again.any():
                d, s, e = _merged(doc[again], at[again].astype(np.int64), (at + n)[again].astype(np.int64) + LENGTH - 1)
                yield _batch(_FOUND, _SPAN, 0, 0, d, s, e - s)
            # The runs of the last sampled place wait for those that may follow.
            kind, route, doc, at, n = (np.concatenate([h, x[new]]) for h, x in zip(held, (kind, route, doc, at, n), strict=True))
            upto = int(np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1]]))[-1]) if len(route) else 0
            yield from detail(kind[:upto], route[:upto], doc[:upto], at[:upto], n[:upto])
            held = [x[upto:] for x in (kind, route, doc, at, n)]
        yield from detail(*held)

    return scan


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fingerprints of all 100-byte strings of the runs that are asked for."""
    for batch in K.slices(batches, "text", SLICE):
        data, offsets = K.utf8(batch.column("text"))
        runs = batch.column("runs")
        text = np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy()))
        flat = runs.flatten()
        at, n, route, parts = (flat.field(c).to_numpy() for c in ("at", "n", "route", "parts"))
        total = int(n.sum())
        run = np.repeat(np.arange(len(n)), n)
        start = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + at[run]
        where = start + offsets[text[run]]
        hashes = K.range_hash(K.prefix_sums(data), where, where + LENGTH)
        check = (K.range_hash(K.prefix_sums(data, K.CHECK_BASE), where, where + LENGTH, K.CHECK_BASE) >> np.uint64(32)).astype(np.uint32)
        part = hashes % parts[run].astype(np.uint64)
        order = np.lexsort((start, part, run))
        run, part, start, hashes, check = run[order], part[order], start[order], hashes[order], check[order]
        begin = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (part[1:] != part[:-1])])) if total else np.zeros(0, np.int64)
        cut = pa.array(np.append(begin, total).astype(np.int32))
        to = K.mix(route[run[begin]].view(np.uint64) + part[begin] * np.uint64(0x9E3779B97F4A7C15))
        lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (start.astype(np.int32), hashes.view(np.int64), check.view(np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array(to.view(np.int64)), pa.array(batch.column("doc").to_numpy()[text[run[begin]]]), pa.array(start[begin].astype(np.int32)), *lists], names=["route", "doc", "first", "starts", "hashes", "checks"])


def _pairs(hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Both fingerprints of each string as one value that sorts."""
    out = np.empty(len(hashes), np.dtype([("hash", ">u8"), ("check", ">u4")]))
    out["hash"], out["check"] = hashes.view(np.uint64), checks.view(np.uint32)
    return out.view("S12")


def _later(since: int):
    """Merge-scan of strings in document order; those found before are repeats."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels()
        for batch in batches:
            lens = np.diff(batch.column("hashes").offsets.to_numpy())
            start, hashes, checks = (batch.column(c).flatten().to_numpy() for c in ("starts", "hashes", "checks"))
            doc = np.repeat(batch.column("doc").to_numpy(), lens)
            again = ~levels.add(_pairs(hashes, checks)) & (doc >= since)
            if again.any():
                d, s, e = _merged(doc[again], start[again].astype(np.int64), start[again].astype(np.int64) + LENGTH)
                yield _batch(_FOUND, _SPAN, 0, 0, d, s, e - s)

    return scan


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.slices(batches, "text"):
        data, offsets = K.utf8(batch.column("text"))
        spans = batch.column("spans")
        lens = np.diff(spans.offsets.to_numpy())
        flat = spans.flatten()
        at, n = flat.field("at").to_numpy().astype(np.int64), flat.field("n").to_numpy().astype(np.int64)
        row, start, end = _merged(np.repeat(np.arange(batch.num_rows), lens), at, at + n)
        removed = np.zeros(batch.num_rows, np.int64)
        np.add.at(removed, row, end - start)
        cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
        digest, runs = [], []
        for i in range(batch.num_rows):
            own, left, h = data[offsets[i] : offsets[i + 1]], 0, hashlib.sha256()
            for k in range(cut[i], cut[i + 1]):
                h.update(own[left : start[k]])
                left = end[k]
            h.update(own[left:])
            digest.append(h.hexdigest())
            runs.append([(int(start[k]), int(end[k])) for k in range(cut[i], cut[i + 1])])
        spans_out = pa.array([[{"start": a, "end": b} for a, b in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed), pa.array(np.diff(cut)), pa.array(digest, pa.string()), spans_out], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:bigint,end:bigint>>"


def _filter(docs: DataFrame, column: str) -> F.Column:
    """Whether ``doc`` may be among those values: no if not. The filter has a fixed size; where it is full, all may be."""
    slot = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    words = docs.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def may_be(s):
        v = s.to_numpy()
        import pandas as pd

        return pd.Series((sent.value[v // 64] >> (v % 64)) & 1 == 1)

    return may_be(F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS)))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _in_order(texts: DataFrame) -> DataFrame:
    """Numbers for the rows in the order of doc_id and, where it is shared, of the text's MD5."""
    order = ["doc_id", F.md5("text")]
    return texts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("doc", F.monotonically_increasing_id())


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte ranges.

    A byte goes if a 100-byte string over it also starts earlier: in a smaller doc_id, or in the
    same text. docs: doc_id, text; other columns are ignored. Null texts are empty; texts under 100
    bytes keep all. A null doc_id comes before all others; rows that share a doc_id follow each
    other by the MD5 of their text, each a text of its own. An empty table gives an empty result.
    """
    texts = _rows(docs)
    if texts.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        texts = texts.withColumn("doc", F.col("doc_id"))
    else:
        texts = written(_in_order(texts))
    return _passages(texts)


class SuffixIndex:
    """A family of levels under a shared path: sorted suffixes of all batches so far, and their texts.

    A level is a sparse suffix array: Parquet sorted by the first bytes of each sampled suffix and its
    fingerprints. ``add`` gives what ``repeated_passages`` does for a batch, all earlier batches coming before it. The list
    of levels is written anew after each batch, so a batch that failed can be added again.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.version, self.levels = spark, path, 0, []
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/family")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            kept = spark.read.parquet(f"{path}/family")
            self.version = kept.agg(F.max("version")).first()[0]
            self.levels = [(r.folder, r.size) for r in kept.where(F.col("version") == self.version).orderBy("nth").collect() if r.folder]

    def _read(self, folder: str) -> DataFrame:
        return self.spark.read.schema(_ENTRIES).parquet(f"{self.path}/{folder}")

    def _write(self, entries: DataFrame) -> tuple[str, int]:
        folder, order = f"level-{uuid.uuid4().hex}", ["head", "key", "class", "check", "doc", "at"]
        entries.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{self.path}/{folder}")
        return folder, self._read(folder).count()

    def add(self, docs: DataFrame) -> DataFrame:
        since = self.version << 48
        folder = f"{self.path}/texts/{self.version:06}-{uuid.uuid4().hex}"
        _in_order(_rows(docs)).withColumn("doc", F.col("doc") + F.lit(since)).write.parquet(folder)
        texts = self.spark.read.schema("doc_id long, text string, doc long").parquet(folder)
        before = [self._read(f) for f, _ in self.levels]
        out = written(_passages(texts, since, before, self._texts() if before else None))
        level = self._write(texts.select("doc", "text").mapInArrow(_entries, _ENTRIES))
        levels = [*self.levels, level] if level[1] else list(self.levels)
        while len(levels) > 1 and levels[-2][1] <= 2 * levels[-1][1]:
            (a, _), (b, _) = levels[-2:]
            levels[-2:] = [self._write(self._read(a).unionByName(self._read(b)))]
        self._keep(levels, folder)
        return out

    def _texts(self) -> DataFrame:
        folders = [r.texts for r in self.spark.read.parquet(f"{self.path}/family").select("texts").distinct().collect()]
        return self.spark.read.schema("doc_id long, text string, doc long").parquet(*folders)

    def _keep(self, levels: list[tuple[str, int]], texts: str) -> None:
        self.version += 1
        rows = [(self.version, i, f, n, texts) for i, (f, n) in enumerate(levels or [("", 0)])]
        self.spark.createDataFrame(rows, "version long, nth int, folder string, size long, texts string").coalesce(1).write.mode("append").parquet(f"{self.path}/family")
        gone = {f for f, _ in self.levels} - {f for f, _ in levels}
        self.levels = levels
        for f in gone:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{f}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def _passages(texts: DataFrame, since: int | None = None, levels: list[DataFrame] | None = None, known: DataFrame | None = None) -> DataFrame:
    """The result for texts (doc_id, text, doc), after the suffixes in ``levels`` and their texts ``known``, if there are any, whose docs lie below ``since``."""
    spark = texts.sparkSession
    since = -(1 << 63) if since is None else since
    some = texts.where(F.pmod(F.xxhash64("doc"), F.lit(FREQUENT_IN)) == 0).select("text").mapInArrow(_sample, "key long")
    often = some.groupBy("key").count().where("count >= 20").orderBy(F.desc("count"), "key").limit(FREQUENT_MOST).collect()
    spread = [r.key for r in often]
    found = texts.select("doc", "text").mapInArrow(_scan(np.array(spread, np.int64).view(np.uint64)), _ROWS)
    if levels:
        keys = texts.select("doc", "text").mapInArrow(_entries, _ENTRIES).select("key").distinct()
        hot = F.broadcast(spark.createDataFrame([(k, True) for k in spread], "key long, many boolean"))
        for level in levels:
            old = level.join(keys, "key", "left_semi").join(hot, "key", "left")
            found = found.unionByName(old.select(F.when(F.col("many"), _SPREAD).otherwise(_SUFFIX).alias("kind"), F.when(F.col("many"), F.col("class")).otherwise(F.col("key")).alias("route"), "class", "check", "doc", "at", "n"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * size // (LENGTH - SAMPLED + 2) // PARTITION))
    indexed = written(found.repartition(parts, "route").sortWithinPartitions("route", "class", "check", "doc", "at").mapInArrow(_index(since), _FOUND))
    detail = indexed.where(F.col("kind") == _DETAIL)
    runs = detail.groupBy("doc").agg(F.collect_list(F.struct("at", "n", "route", "parts")).alias("runs"))
    all_ = texts.select("doc", "text") if known is None else texts.select("doc", "text").unionByName(known.select("doc", "text"))
    wanted = all_.where(_filter(detail, "doc"))
    strings = wanted.join(runs, "doc").select("doc", "text", "runs").mapInArrow(_strings, "route long, doc long, first int, starts array<int>, hashes array<long>, checks array<int>")
    later = written(strings.repartition(parts, "route").sortWithinPartitions("doc", "first").mapInArrow(_later(since), _FOUND))
    spans = indexed.where(F.col("kind") == _SPAN).unionByName(later).select("doc", F.col("at").cast("long").alias("at"), "n")
    per_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    may_have = _filter(spans, "doc")
    with_spans = texts.where(may_have).join(per_doc, "doc", "left")
    none = F.array().cast("array<struct<at:bigint,n:int>>")
    rest = texts.where(~may_have).withColumn("spans", none)
    both = with_spans.select("doc_id", "text", F.coalesce("spans", none).alias("spans")).unionByName(rest.select("doc_id", "text", "spans"))
    return both.mapInArrow(_report, _RESULT)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
