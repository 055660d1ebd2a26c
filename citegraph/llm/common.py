"""Shared helpers: tables, stored intermediate tables, Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citegraph.session import scratch_path, shuffles_removed

#: rows handed to a Python worker at once, and rows a scan decodes at once: texts may be long, so batches are kept short
BATCH_ROWS, SCAN_ROWS = 500, 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Lower the session's batch sizes for Arrow and for scans (never raise them)."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)):
        if not 0 < int(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a table once to the cluster's shared scratch folder and read it back:
    later stages neither recompute it nor depend on the executors that made it, and the files of its shuffles go."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_removed(spark):
        df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of stored tables behind their last reader."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(conf).delete(path, True)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct: what an operator adds beside it cannot clash with their names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def text_runs(sizes: list[int], most: int) -> Iterator[range]:
    """Index ranges over a batch whose texts' sizes add up to at most `most` (or one text each)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield range(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield range(start, len(sizes))


def give_back() -> None:
    """Return freed memory to the system at the end of a task: the worker lives on, and what its allocators keep counts
    against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A ``mapInArrow`` function that gives its memory back at the end."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def map_batches(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """`f` over each Arrow batch of `df`; results that are None are skipped."""

    def each(batches):
        for b in batches:
            if b.num_rows and (out := f(b)) is not None:
                yield out

    return df.mapInArrow(tidy(each), schema)
