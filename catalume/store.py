"""A catalog kept in the shared folder, in versions that a commit log names.

A commit writes the tables it changes to new folders and then its log entry, by rename; what stays is named again, not
copied. A job that stops between the two leaves folders that nothing names, so it can simply run again. An
entry also carries how far each stream has come, so that a batch counts once, however often it is
retried or the session restarted. Only the last entry is ever read.

``files`` is bucketed and sorted by its normalised path: a listing meets it without a shuffle of the stored side, and a
lookup of paths reads their buckets alone.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .functions.paths import PATH_KEY, normalize_path


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was about to."""


@dataclass(frozen=True)
class Entry:
    """A version: the folder and buckets (0 for none) of each table, the last batch of each stream, the snapshot at hand."""

    version: int = -1
    tables: dict[str, tuple[str, int]] = field(default_factory=dict)
    streams: dict[str, int] = field(default_factory=dict)
    snapshot: dict | None = None


class CatalogStore:
    """Versions of a catalog under ``path``, a folder that the driver and all executors share. One writer at a time can
    commit a version; the other gets Conflict and reads again. ``buckets`` should be no fewer than the shuffle partitions of
    the sessions that read, or Spark would rather shuffle both sides of a join."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)

    def entry(self) -> Entry:
        """The last version's entry; before the first commit an empty one."""
        log = self._hadoop.Path(f"{self.path}/log")
        if not self._fs.exists(log):
            return Entry()
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        last = max((n for n in names if re.fullmatch(r"\d{12}\.json", n)), default=None)
        if last is None:
            return Entry()
        stream = self._fs.open(self._hadoop.Path(f"{self.path}/log/{last}"))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Entry(found["version"], {t: tuple(at) for t, at in found["tables"].items()}, found["streams"], found["snapshot"])

    def seen(self, stream: str, batch: int) -> bool:
        """Whether a commit has taken in this batch of the stream, or a later one."""
        return batch <= self.entry().streams.get(stream, -1)

    def read(self, entry: Entry | None = None) -> Catalog:
        """The catalog of a version, the last one if none is given."""
        return Catalog(**{t: self._table(*at) for t, at in (entry or self.entry()).tables.items()})

    def commit(self, tables: dict[str, DataFrame], stream: str | None = None, batch: int | None = None, snapshot: dict | None = None, on: Entry | None = None) -> Entry:
        """Write the tables and make them, with all that ``on`` (the last version) has, the next version."""
        on = on or self.entry()
        known = {f.name for f in fields(Catalog)}
        if unknown := set(tables) - known:
            raise ValueError(f"not tables of a catalog: {sorted(unknown)}")
        written = {t: self._write(t, df) for t, df in tables.items()}
        streams = on.streams | ({stream: batch} if stream is not None else {})
        new = Entry(on.version + 1, on.tables | written, streams, snapshot if snapshot is not None else on.snapshot)
        self._log(new)
        return new

    def stage(self, df: DataFrame) -> str:
        """Write rows that a snapshot in an entry will name."""
        path = self._folder("staged")
        df.write.parquet(path)
        return path

    def vacuum(self) -> int:
        """Remove the folders and log entries that the last version does not need; how many folders went. Only for when no
        one reads an older version or is about to commit."""
        entry = self.entry()
        keep = {at for at, _ in entry.tables.values()} | set((entry.snapshot or {}).get("parts", []))
        gone = 0
        for kind in ("tables", "staged"):
            top = self._hadoop.Path(f"{self.path}/{kind}")
            for s in self._fs.listStatus(top) if self._fs.exists(top) else []:
                if f"{self.path}/{kind}/{s.getPath().getName()}" not in keep:
                    self.spark.sql(f"drop table if exists `{self._name(s.getPath().getName())}`")
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        for s in self._fs.listStatus(self._hadoop.Path(f"{self.path}/log")):
            if s.getPath().getName() != f"{entry.version:012d}.json":
                self._fs.delete(s.getPath(), False)
        return gone

    def _folder(self, kind: str, name: str = "") -> str:
        return f"{self.path}/{kind}/{name}{uuid.uuid4().hex}"

    @staticmethod
    def _name(folder: str) -> str:
        return f"catalog_{folder.rsplit('/', 1)[-1]}"

    def _write(self, name: str, df: DataFrame) -> tuple[str, int]:
        folder = self._folder("tables", f"{name}_")
        if name != "files":
            df.write.parquet(folder)
            return folder, 0
        keyed = df.withColumn(PATH_KEY, normalize_path(F.col("path"))).repartition(self.buckets, PATH_KEY)
        keyed.write.bucketBy(self.buckets, PATH_KEY).sortBy(PATH_KEY).option("path", folder).format("parquet").saveAsTable(self._name(folder))
        return folder, self.buckets

    def _table(self, folder: str, buckets: int) -> DataFrame:
        if not buckets:
            return self.spark.read.parquet(folder)
        name = self._name(folder)
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(folder).schema)
            self.spark.sql(f"create table `{name}` ({columns}) using parquet clustered by ({PATH_KEY}) sorted by ({PATH_KEY}) into {buckets} buckets location '{folder}'")
        return self.spark.table(name)

    def _log(self, entry: Entry) -> None:
        text = json.dumps({"version": entry.version, "tables": entry.tables, "streams": entry.streams, "snapshot": entry.snapshot})
        made = self._hadoop.Path(f"{self.path}/log/.{uuid.uuid4().hex}")
        named = self._hadoop.Path(f"{self.path}/log/{entry.version:012d}.json")
        out = self._fs.create(made, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self.spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            # Fails, unlike FileSystem.rename on some systems, if the name is taken.
            self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._fs.makeQualified(made), self._fs.makeQualified(named), options)
        except Exception as e:
            self._fs.delete(made, False)
            if self._fs.exists(named):
                raise Conflict(f"version {entry.version} is there already") from e
            raise
