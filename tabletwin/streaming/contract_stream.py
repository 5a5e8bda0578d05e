"""The contract check (CT13) on a Structured Streaming source.

The check is a narrow per-row projection (no state), so it runs unchanged on a streaming DataFrame:
new files are checked as they arrive and violations are appended to a sink. The contract itself is a
small batch table learned beforehand. Checkpoints go to the session's shared checkpoint folder.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabletwin.operators import contract as CT
from tabletwin.session import ensure_checkpoint_dir


def violations_stream(stream: DataFrame, contract: DataFrame, row_key: str,
                      prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Streaming DataFrame of violations of ``stream`` (optionally transformed by ``prepare``)."""
    s = prepare(stream) if prepare else stream
    return CT.check(s, contract, row_key, include_missing=False)


def schema_violations(stream: DataFrame, contract: DataFrame,
                      prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Contract columns missing from the stream's schema: known before any data arrives (batch rows)."""
    s = prepare(stream) if prepare else stream
    return CT.missing_columns(s, contract)


def run_available(spark: SparkSession, violations: DataFrame, name: str | None = None) -> DataFrame:
    """Process every file available now into a Parquet folder of the session's shared checkpoint folder and return
    it as a table; a continuous run writes to the same kind of sink with another trigger."""
    name = name or f"violations_{uuid.uuid4().hex[:8]}"
    base = os.path.join(ensure_checkpoint_dir(spark), f"stream-{name}")
    q = (violations.writeStream.format("parquet").outputMode("append").option("path", f"{base}/rows")
         .option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(violations.schema).parquet(f"{base}/rows")
