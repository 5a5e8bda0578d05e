"""A training corpus from ``documents`` in five stages, each written as Parquet and read again by the next.

Every stage works on all rows that the one before kept: the classifier's rejects go, one document of each group of
near copies stays, documents that overlap the benchmark go, sources are mixed to their target weights (documents of
sources that run short repeat, as rows), and the rows get their shards.

Cases: null and empty texts are judged by their metadata, are near copies of nothing and hold no benchmark item; very long
texts are read whole; rows without an id are never compared for near copies and stay as they were; repeated rows of an
id are one document (the near-copy stage keeps one row of it); every stage but the last returns the columns it was given,
whatever their names, and the last adds ``shard`` (replacing a column of that name); an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabletwin.llm import decontam, jaccard, mixing, quality, sharding
from tabletwin.llm.store import shared_path, source_table

SHARDS = 24


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, source_table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, source_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.with_shard(docs, [1.0] * SHARDS)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The classifier is fitted, which SQL cannot express; tests hold the pipeline against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
