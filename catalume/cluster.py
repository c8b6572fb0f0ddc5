"""The few session facts that several operators need."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it.

    Only a session on one machine may leave it unset; it then gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with files in the shared folder, which outlive the executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def new_folder(spark: SparkSession) -> str:
    """The name of a new folder in the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows from Parquet files in the shared folder."""
    path = path or new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
