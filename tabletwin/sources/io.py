"""Readers and writers (SRC1-SRC4, SNK1-SNK7). Paths are shared storage (HDFS/S3/...); formats are
Spark's own. Every write can skip a finished stage with ``mode='ignore'`` (SNK6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE_FORMAT = "json"


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, header: bool = True) -> DataFrame:
    """SRC1: CSV (header; schema given or inferred), JSON lines or Parquet. A missing path raises."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", header).option("inferSchema", schema is None).option("mode", "FAILFAST")
        return r.csv(path)
    if fmt == "json":
        return r.json(path)
    return r.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", header: bool = True,
                files: int | None = None) -> None:
    """SNK4/SNK5: rows as CSV (header, no index) or JSON lines, or Parquet. ``files`` caps output files
    only when asked (small exports); big tables keep their partitioning."""
    out = df.coalesce(files) if files else df
    w = out.write.mode(mode)
    if fmt == "csv":
        w.option("header", header).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def save_artifact(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SNK1/SNK2/SNK3: a profile, FD list or contract table as JSON lines (small: one row per column / FD)."""
    df.coalesce(1).write.mode(mode).json(path)


def load_artifact(spark: SparkSession, path: str, schema) -> DataFrame:
    """SRC4: read an artifact back with its schema."""
    return spark.read.schema(schema).json(path)


def run_metadata(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """SNK7: rows, columns, label rate (4 dp), distinct keys, seed: one aggregate."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"),
                  F.round(F.avg(F.col(label).cast("double")), 4).alias("label_rate"),
                  F.count_distinct(key).alias("distinct_keys")).withColumn("seed", F.lit(int(seed)))
