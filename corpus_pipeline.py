"""A corpus pipeline of stages that each apply one operator of catalume.llm to what the one before kept.

Every stage takes and, but for the last, returns the columns of ``documents``. Extra columns stay, whatever their
names; an empty table gives an empty result; rows are judged one by one, by their own text, so null and repeated
doc_ids harm nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalume.cluster import discard, new_folder, table, written
from catalume.llm import decontaminate, mix, neardup, shards, toxicity


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds toxic go. Null and empty texts have the score of no words at all."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each near-duplicate group stays; of rows that repeat, one; null texts all stay."""
    return neardup.one_of_each_class(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go; null and empty texts have none."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it; a null source is a source of its own, one without words gives nothing."""
    return mix.mixture(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row; null texts, languages and sources have their place as any other."""
    return shards.hilbert_shards(docs)


STAGES = [("toxicity", toxic_documents), ("near duplicates", near_duplicates), ("decontamination", benchmark_passages), ("mixing", mixing), ("sharding", sharding)]

#: A fitted model and a random draw can't be said in SQL; tests hold the stages against brute-force twins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again; what the next has read is removed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = new_folder(spark)
        docs = written(stage(spark, docs, sf_dir), path)
        if before:
            discard(spark, before)
        before = path
    return docs


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL}
