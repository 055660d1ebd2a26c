"""Session helpers.

The library never creates a session implicitly; tests and bench use
``get_spark``.  Shared scratch space always comes from the session's
``spark.checkpoint.dir`` (a shared folder on a cluster).  Where there is none, a local
master gets a private temp folder; any other master is refused.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins/partition counts at runtime,
# splits skewed shuffle partitions, and the broadcast threshold is left at the
# Spark default so only plans with a size estimate below it are broadcast.
_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # rows here are CPU-heavy (whole texts): let AQE keep parallelism for small shuffles
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # checkpoints cut lineage inside a query; remove their files once unreachable
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, **conf) -> SparkSession:
    """A session with the library's settings.  Partition count and driver memory are set for a local master only;
    on a cluster they are the operator's."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    b = SparkSession.builder.master(master).appName("citegraph")
    merged = dict(_DEFAULT_CONF)
    if master.startswith("local"):
        merged |= {"spark.sql.shuffle.partitions": str(shuffle_partitions or 8), "spark.driver.memory": "16g"}
    elif shuffle_partitions:
        merged["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    merged.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for k, v in merged.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            d = tempfile.mkdtemp(prefix="citegraph-ckpt-")  # one machine: tests; gone with the process
            atexit.register(shutil.rmtree, d, ignore_errors=True)
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir()
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for a written table."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/citegraph-{name}-{uuid.uuid4().hex[:12]}"


def balance(df: DataFrame, key: str) -> DataFrame:
    """Spread CPU-heavy per-row work: when the input has fewer partitions than the
    cluster can run at once (e.g. one large unsplittable file), hash-repartition
    it by ``key`` to the default parallelism.  On a large input this is a no-op,
    so no extra shuffle is added at scale."""
    n = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < n:
        return df.repartition(n, key)
    return df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss; never localCheckpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: with it, Spark removes a query's shuffle files when the query ends, and not some time after the driver has forgotten it
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """What runs inside leaves no shuffle files behind; the session's own choice holds again afterwards."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
