"""Stages that are skipped when they are already done (SNK6), and the tables they leave behind (SRC4).

A stage has a key: a hash of its name, its parameters and the fingerprint of its inputs. Its tables are written
into a folder of their own for every attempt; the marker that names the attempt is created last, in one step that fails
if it exists. So a reader sees a whole stage or none, an attempt that died halfway is not seen and the stage runs
again, and of two writers at the same time the first to finish counts.

Results for odd cases: inputs that change (a file more, longer, newer) give another key and the stage runs; the same
inputs and parameters in any order of paths give the same key; a marker without its tables, or one that cannot be
read, is an error that names it; a missing input path is an error.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_VERSION = 1
MARKER = "done.json"


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """Hash of the files under ``paths``: their names, lengths and times, listed and added up by Spark (contents are not
    read, and the sum does not depend on the order in which files are listed)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    one = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    r = files.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("size"), F.sum(one.cast("decimal(38,0)")).alias("a"),
                  F.bit_xor(one).alias("b")).first()
    return f"{r.n}:{r['size']}:{r.a}:{r.b}"


def stage_key(name: str, inputs: str, params: dict) -> str:
    spec = json.dumps([FORMAT_VERSION, name, inputs, params], sort_keys=True, default=str)
    return hashlib.sha256(spec.encode()).hexdigest()[:32]


class Saved:
    """A finished stage: its settings and tables. ``reused`` tells whether this call found it done."""

    def __init__(self, spark: SparkSession, folder: str, marker: dict, reused: bool):
        self.spark = spark
        self.folder = folder
        self.meta = marker["meta"]
        self.reused = reused
        self._schemas = marker["tables"]
        self._attempt = marker["attempt"]

    def table(self, name: str) -> DataFrame:
        """A table of the stage, with the schema it was written with."""
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(self._schemas[name])
        return self.spark.read.schema(schema).parquet(os.path.join(self.folder, self._attempt, name))


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _read_marker(spark: SparkSession, folder: str) -> dict | None:
    p, fs = _fs(spark, os.path.join(folder, MARKER))
    if not fs.exists(p):
        return None
    text = "".join(r.value for r in spark.read.text(str(p.toString()), wholetext=True).collect())  # one small file
    try:
        return json.loads(text)
    except ValueError as e:
        raise ValueError(f"unreadable marker {p.toString()}") from e


def _write_marker(spark: SparkSession, folder: str, marker: dict) -> bool:
    """Create the marker; False if another writer was first. The text goes to a file of the attempt and gets its name by
    a rename, which does not replace a file that is there."""
    draft, fs = _fs(spark, os.path.join(folder, marker["attempt"], MARKER))
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(marker).encode()))
    out.close()
    final, _ = _fs(spark, os.path.join(folder, MARKER))
    return not fs.exists(final) and fs.rename(draft, final)


def run_stage(spark: SparkSession, root: str, name: str, inputs: Sequence[str], params: dict,
              build: Callable[[], tuple[dict[str, DataFrame], dict]]) -> Saved:
    """The stage's tables, from ``build() -> (tables, settings)`` if they are not there yet. ``root`` is a shared folder,
    ``inputs`` the paths that the tables are made from, ``params`` all else that they depend on."""
    folder = os.path.join(root, f"{name}-{stage_key(name, fingerprint(spark, inputs), params)}")
    marker = _read_marker(spark, folder)
    if marker is not None:
        return Saved(spark, folder, marker, True)
    attempt = uuid.uuid4().hex
    tables, meta = build()
    for t, df in tables.items():
        df.write.parquet(os.path.join(folder, attempt, t))
    marker = {"version": FORMAT_VERSION, "attempt": attempt, "meta": meta,
              "tables": {t: df.schema.jsonValue() for t, df in tables.items()}}
    _write_marker(spark, folder, marker)
    return Saved(spark, folder, _read_marker(spark, folder), False)
