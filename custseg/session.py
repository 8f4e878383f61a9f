"""Session helpers: a local session for tests/bench and lineage cutting via reliable checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "custseg") -> SparkSession:
    """A local session with the settings the analyses assume (AQE on, UTC, UI off).

    The lookup of a Python call site for every column expression is off, too: it takes longer than
    building and planning the expressions themselves. Errors then don't name the Python line."""
    parts = shuffle_partitions or (int(cpus) * 2 if str(cpus).isdigit() else 16)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CUSTSEG_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local session (tests, bench) gets a private folder when none is configured; on a
    cluster a machine-local folder would not survive executor loss, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: configure a shared checkpoint folder")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="custseg-ckpt-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str = "stage", written: list | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Used for tables that several passes read: the upstream shuffles run once, later scans are
    vectorized and column-pruned, and a lost executor re-reads files instead of recomputing
    lineage. (An RDD checkpoint would cut the lineage too, but its row-serialized files are
    several times slower to scan.) The folder written is added to ``written``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/custseg-{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    if written is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_observed(df: DataFrame, name: str = "stage", written: list | None = None,
                         **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialize`` plus aggregate ``metrics`` observed while writing (no extra job).

    Example: ``materialize_observed(df, "hub", n=F.count(F.lit(1)))`` returns the re-read
    stage and ``{"n": <rows written>}``.
    """
    observation = Observation(f"custseg-{name}")
    observed = df.observe(observation, *[c.alias(k) for k, c in metrics.items()])
    return materialize(observed, name, written), observation.get


def delete_path(spark: SparkSession, path: str) -> bool:
    """Recursively delete one folder through the cluster's Hadoop filesystem."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
