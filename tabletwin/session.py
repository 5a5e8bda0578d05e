"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tabletwin") -> SparkSession:
    """A local session with the settings the tests and the bench use (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is; without it that is an
    error, since executors do not see a folder of the driver's. Only a local master without one (tests) gets a
    scratch folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path and not (spark.sparkContext.master or "").split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not path:
        path = tempfile.mkdtemp(prefix="tabletwin-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut_lineage(df):
    """Materialise ``df`` into the shared checkpoint folder (reliable, survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df):
    """Give CPU-heavy narrow work enough tasks: if the input arrives in fewer partitions than the cluster
    runs in parallel (e.g. one large Parquet row group), deal its rows round-robin over that many
    partitions. Inputs that already have enough partitions are returned untouched (no shuffle)."""
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def dealt(df, per_core: int = 8):
    """Rows dealt round-robin to ``per_core`` tasks a core, for work that costs far more than moving its rows: a file may
    come as many partitions of which few hold its row groups, so their number says nothing."""
    return df.repartition(per_core * df.sparkSession.sparkContext.defaultParallelism)


def map_arrow(df, work, schema):
    """``df.mapInArrow`` whose Python workers also look for this package where the driver found it (local mode,
    or nodes that share the path; elsewhere ship the package with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = df.sparkSession.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    return df.mapInArrow(work, schema)
