"""Media files: listings, hashes, probe summaries."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Extensions of video files.
EXTENSIONS = ("mp4", "m4v", "mkv", "webm", "mov", "avi", "wmv", "flv", "mpg", "mpeg", "ts", "m2ts", "ogv", "3gp", "rm", "vob")
#: Bytes at either end that the OpenSubtitles hash sums.
ENDS = 65_536


def list_media(spark: SparkSession, roots: list[str], extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, size, mtime of the files below the roots that are there, by extension whatever its case; contents aren't read."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    out = None
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            continue
        one = listing.load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], "path string, size long, mtime timestamp")
    return out.where(F.lower(F.regexp_extract("path", r"\.([^.\\/]+)$", 1)).isin(*extensions))


def file_contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, length, content of files under 2 GB each."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length", "content")


def file_md5(contents: DataFrame) -> DataFrame:
    return contents.select("path", F.md5("content").alias("md5"))


def oshash_of(size: int, ends: list[bytes]) -> str:
    """Size plus the sums of the little-endian 64-bit words of the ends: the first and last 64 KiB, or all of a smaller file."""
    total = size
    for part in ends:
        whole = np.frombuffer(part[: len(part) // 8 * 8], "<u8")
        total += int(whole.sum(dtype=np.uint64))
    return f"{total % (1 << 64):016x}"


@F.pandas_udf(T.StringType())
def _oshash(size: pd.Series, head: pd.Series, tail: pd.Series) -> pd.Series:
    whole = lambda n, a, b: [bytes(a), bytes(b)] if n >= ENDS else [bytes(a)]
    return pd.Series([None if a is None else oshash_of(int(n), whole(n, a, b)) for n, a, b in zip(size, head, tail, strict=True)])


def file_oshash(contents: DataFrame) -> DataFrame:
    """path, oshash; contents: path, length, content. Only the two ends go to Python."""
    head, tail = F.substring("content", 1, ENDS), F.substring("content", -ENDS, ENDS)
    return contents.select("path", _oshash("length", head, tail).alias("oshash"))


#: Bytes of a file that are hashed together.
PIECE = 1 << 22


def _opened(path: str) -> pa.NativeFile:
    """A file of a listing, through Arrow's file systems (local, HDFS, object stores)."""
    where = re.sub("^file:/+", "/", path)
    if where.startswith("/"):
        return fs.LocalFileSystem().open_input_file(unquote(where) if where != path else where)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _ends_hash(path: str) -> str:
    with _opened(path) as f:
        size = f.size()
        if size < ENDS:
            return oshash_of(size, [f.read_at(size, 0)])
        return oshash_of(size, [f.read_at(ENDS, 0), f.read_at(ENDS, size - ENDS)])


def _whole_hash(path: str) -> str:
    digest = hashlib.md5(usedforsecurity=False)
    with _opened(path) as f:
        while piece := f.read(PIECE):
            digest.update(piece)
    return digest.hexdigest()


def _hashed(kinds: tuple[str, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each file; one that can't be opened, as it is gone by now, has null hashes."""
    of = {"oshash": _ends_hash, "md5": _whole_hash}
    for b in batches:
        rows = []
        for path in b.column("path").to_pylist():
            try:
                rows.append((path, *[of[k](path) for k in kinds]))
            except FileNotFoundError:
                rows.append((path, *[None] * len(kinds)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["path", *kinds])


def file_hashes(listing: DataFrame, kinds: tuple[str, ...] = ("oshash",), tasks: int | None = None) -> DataFrame:
    """path and its hashes (oshash, md5) for the files of a listing, whatever their size.

    An oshash reads the two ends of a file, an MD5 all of it, a few megabytes at a time; memory does not follow the size.
    Files are dealt over the tasks by path. Workers open them by Arrow's file systems; for a store that only Spark can read,
    take ``file_oshash`` and ``file_md5`` of ``file_contents``, for files under 2 GB.
    """
    if unknown := set(kinds) - {"oshash", "md5"}:
        raise ValueError(f"no such hash: {sorted(unknown)}")
    dealt = listing.select("path").repartition(*[tasks] * bool(tasks), "path")
    return dealt.mapInArrow(partial(_hashed, kinds), "path string, " + ", ".join(f"{k} string" for k in kinds))


_PROBE = "format struct<format_name:string,duration:string,bit_rate:string,tags:map<string,string>>, streams array<struct<codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string>>"


def _tag(entries: Column, keys: tuple[str, ...]) -> Column:
    """The first of the keys, whatever its case, whose trimmed value isn't empty. entries: (key in lower case, trimmed value)."""
    first = lambda key: F.try_element_at(F.filter(entries, lambda e: e["key"] == key), F.lit(1))["value"]
    return F.coalesce(*[first(k) for k in keys])


def _rate(text: Column) -> Column:
    """A fraction ``a/b`` as a number; null if it is none or its denominator is 0."""
    a, b = (F.regexp_extract(text, "^([^/]*)/(.*)$", i).try_cast("double") for i in (1, 2))
    return F.when(b != 0, a / b)


def parse_probe_json(df: DataFrame, column: str) -> DataFrame:
    """The rows with a struct ``probe``: format, duration, the first video stream's size, codec and rate, bit rate, embedded title, artist and comment; text that is no JSON gives nulls."""
    # Each step is a column of its own, so that the text is parsed once; an expression used in several places, some of them
    # lambdas, would parse it for each.
    parsed = df.withColumn("__p", F.from_json(F.col(column), _PROBE))
    entries = F.transform(F.map_entries(F.col("__p")["format"]["tags"]), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.trim(e["value"]).alias("value")))
    stepped = parsed.withColumns({"__video": F.try_element_at(F.filter(F.col("__p")["streams"], lambda s: s["codec_type"] == "video"), F.lit(1)), "__tags": F.filter(entries, lambda e: e["value"] != "")})
    p, video, tags = F.col("__p"), F.col("__video"), F.col("__tags")
    return stepped.withColumn("probe", F.struct(p["format"]["format_name"].alias("format_name"), p["format"]["duration"].try_cast("double").alias("duration"), video["width"].alias("width"), video["height"].alias("height"), video["codec_name"].alias("codec"), _rate(video["avg_frame_rate"]).alias("fps"), p["format"]["bit_rate"].try_cast("long").alias("bitrate"), _tag(tags, ("title",)).alias("title"), _tag(tags, ("artist", "author", "performer")).alias("artist"), _tag(tags, ("comment", "description", "synopsis")).alias("comment"))).drop("__p", "__video", "__tags")
