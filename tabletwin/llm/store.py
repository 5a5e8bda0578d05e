"""Written tables in the shared checkpoint folder: lineage is cut, executors can be lost."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabletwin.session import ensure_checkpoint_dir, map_arrow

__all__ = ["broadcast_if", "in_fewer_files", "map_arrow", "shared_path", "source_table", "utf8_bytes", "word_count", "words_of", "written"]

#: Words: runs of characters other than space and U+0009..U+000D.
WORD_SPLIT = r"[ \x09-\x0D]+"
WORD = r"[^ \x09-\x0D]+"
#: Rows of a few numbers that one task writes as a file, where there are more files than cores need.
ROWS_A_FILE = 100_000


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_fewer_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows of a few numbers, in as many partitions as these need (at least four a core, never more
    than it has): a task that writes a file also makes folders and sets their rights, which costs more than few rows."""
    return df.coalesce(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_FILE)))


def named(column: str):
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(columns, name: str) -> str:
    """``name``, with underscores before it until no column has it (upper and lower case are one)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def words_of(text):
    """Array of the words of a text column (null or empty: empty array), built-in functions only."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_SPLIT)
    return F.filter(parts, lambda w: w != "")


def word_count(text):
    """Number of words (long; null: 0), built-in functions only: each word shrinks to one mark."""
    marks = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), WORD_SPLIT, "")
    return F.length(marks).cast("long")


def utf8_bytes(text):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def source_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def broadcast_if(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (it should be a written table); else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
