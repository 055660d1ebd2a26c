"""Table scans, globs, sinks and build-or-load caches.

All paths are ordinary Spark paths (a shared file system or object store on a
cluster).  Writes go through Spark's commit protocol, so a lost executor only
re-runs its task; nothing is written to a machine-local folder.
"""

from __future__ import annotations

import hashlib
import json
from typing import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from citegraph import schemas
from citegraph.functions import constants as K
from citegraph.session import cut_lineage, shuffles_removed


#: how large intermediate tables are written: on the tables measured, 0.5 to 0.8 of what Spark's defaults take on disk
PACKED = {"compression": "zstd", "parquet.writer.version": "v2"}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """The DOCUMENT table with an explicit schema (no inference)."""
    return spark.read.schema(schemas.DOCUMENT).parquet(path)


def load_epochs(spark: SparkSession, glob: str, fmt: str = "parquet") -> DataFrame:
    """Several crawl epochs by path glob (e.g. ``.../epoch-*/xml``); adds
    ``epoch`` parsed from the file path.  Prefer ``partitionBy("epoch")`` layouts,
    where Spark prunes epochs from filters without listing them."""
    df = spark.read.format(fmt).option("mergeSchema", "true").load(glob)
    return df.withColumn("epoch", F.regexp_extract(F.input_file_name(), r"epoch-([^/]+)", 1))


def load_wanted_epochs(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """S6 for a table written by ``epoch`` (``partitionBy``): the rows of the epochs in ``wanted``.  Spark discovers the
    epochs from the folders and, once ``wanted`` is computed, reads the files of these alone (dynamic partition pruning)."""
    return spark.read.parquet(root).join(F.broadcast(wanted.select("epoch").distinct()), "epoch")  # at most a row an epoch


def union_inputs(*frames: DataFrame) -> DataFrame:
    """Several inputs, each already mapped by its own select, as one table."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_xml_dir(spark: SparkSession, root: str) -> DataFrame:
    """Every ``*.xml`` file below ``root`` (recursively) as ``(path, xml)``."""
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml")
        .text(root, wholetext=True)
        .select(F.input_file_name().alias("path"), F.col("value").alias("xml"))
    )


def sample_partitions(df: DataFrame, key: str, k: int, of: int = K.SHARDS) -> DataFrame:
    """The deterministic share ``k/of`` of the table (hash-partition buckets
    ``< k``), standing for "the first k of ``of`` part files".  For partial
    loads only; never used to shrink a registered query."""
    return df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(of)) < k)


def write_table(df: DataFrame, path: str, key: str | None = None, partitions: int | None = None,
                compression: str = "gzip", partition_by: str | None = None) -> None:
    """Overwrite ``path``; optionally hash-partitioned by ``key`` into
    ``partitions`` files (by default AQE chooses the count)."""
    out = df
    if key is not None:
        out = out.repartition(partitions, key) if partitions else out.repartition(key)
    w = out.write.mode("overwrite").option("compression", compression)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS"))


def committed(spark: SparkSession, path: str, glob: str, marked: bool = True) -> list[str]:
    """The folders ``path/glob``; with ``marked``, those whose write Spark's committer has marked as complete."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/{glob}/_SUCCESS" if marked else f"{path}/{glob}")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted((f.getPath().getParent() if marked else f.getPath()).toString() for f in found or [])


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _has_folders(spark: SparkSession, path: str, column: str) -> bool:
    """Whether a table partitioned by ``column`` has a committed folder (they appear when a write is committed)."""
    return bool(committed(spark, path, f"{column}=*", marked=False))


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Build-or-load cache.  If a committed table exists at ``path`` it is read,
    otherwise ``build()`` is written there first.  Also cuts the lineage.  (``Stages`` notices changed inputs, too.)"""
    if not _exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def files_mark(spark: SparkSession, path: str) -> dict:
    """What the files below ``path`` are: their number, bytes, and a hash of every path, length and time of change.  Spark lists
    them; no content is read and no list goes through the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    one = F.xxhash64("path", "length", F.col("modificationTime").cast("double"))
    r = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.coalesce(F.bit_xor(one), F.lit(0)).alias("mark")).first()
    return {"path": path, "files": r.files, "bytes": r.bytes, "mark": r.mark}


class Stages:
    """S12 for a chain of stages below ``root``: each is rebuilt when its inputs or parameters have changed, and loaded otherwise.

    A stage's manifest holds what its input files are (``files_mark``) and its parameters; its table lies in a folder
    named by a hash of the manifest, and counts only when Spark has committed it.  So a half-written stage is never
    loaded, a changed input leads to new folders for the stages below it alone, and going back to old inputs finds the old
    tables.  ``built`` and ``loaded`` name the stages of this run."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.paths: dict[str, str] = {}
        self.built: list[str] = []
        self.loaded: list[str] = []

    def stage(self, name: str, build: Callable[[], DataFrame], inputs=(), params=None, counters: dict | None = None) -> DataFrame:
        """The stage's table.  ``inputs`` are paths of files, or names of earlier stages; with ``counters`` (see
        ``write_counted``) they are kept beside the table."""
        marks = [{"stage": x, "path": self.paths[x]} if x in self.paths else files_mark(self.spark, x) for x in inputs]
        manifest = json.dumps({"inputs": marks, "params": params}, sort_keys=True)
        path = f"{self.root}/{name}/{hashlib.md5(manifest.encode()).hexdigest()}"
        self.paths[name] = path
        if _exists(self.spark, f"{path}/table") and (not counters or _exists(self.spark, f"{path}/counters")):
            self.loaded.append(name)
        else:
            self.spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
            with shuffles_removed(self.spark):
                if counters:
                    write_counted(build(), f"{path}/table", counters, f"{path}/counters")
                else:
                    build().write.mode("overwrite").options(**PACKED).parquet(f"{path}/table")
            self.built.append(name)
        return self.spark.read.parquet(f"{path}/table")

    def counters(self, name: str) -> DataFrame:
        """``(counter, n)`` of a stage."""
        return self.spark.read.schema("counter string, n long").parquet(f"{self.paths[name]}/counters")


# ------------------------------------------------------------------ A1 counters during a write
def observed(df: DataFrame, counters: dict) -> tuple[DataFrame, Observation]:
    """``df`` with counters (name -> a condition, or a number to sum) that are filled while it is written.

    They are collected in the stage that writes, whose tasks report once however often they are tried, so that lost
    tasks do not count twice; there must be no shuffle between this and the write."""
    seen = Observation()

    def value(c):
        return F.coalesce(F.sum(F.when(c, 1).otherwise(0) if dict(df.select(c.alias("c")).dtypes)["c"] == "boolean" else c), F.lit(0)).cast("long")

    return df.observe(seen, *[value(c).alias(name) for name, c in counters.items()]), seen


def write_counted(df: DataFrame, path: str, counters: dict, counters_path: str | None = None) -> dict[str, int]:
    """A1: write a table and return its counters, without a second scan; with ``counters_path`` they are written, too."""
    marked, seen = observed(df, counters)
    marked.write.mode("overwrite").options(**PACKED).parquet(path)
    out = seen.get
    if counters_path:
        df.sparkSession.createDataFrame(list(out.items()), "counter string, n long").coalesce(1).write.mode("overwrite").parquet(counters_path)
    return out


def refresh_index(spark: SparkSession, index_path: str, docs: DataFrame,
                  build: Callable[[DataFrame], DataFrame], version: str | None = None) -> DataFrame:
    """Rebuild only what is new.  ``docs`` carries ``epoch``; epochs the index does not have are built.

    With ``version``, a column that grows when an epoch is delivered again and that ``build`` keeps, an epoch
    whose newest version is above the index's is built anew and replaces its folder; other folders are not touched."""
    todo = docs
    if _has_folders(spark, index_path, "epoch"):
        have = spark.read.parquet(index_path)
        if version is None:
            todo = docs.join(have.select("epoch").distinct(), "epoch", "left_anti")
        else:
            # one row per epoch, written before its folders are replaced
            old = cut_lineage(have.groupBy("epoch").agg(F.max(version).alias("_old")))
            new = docs.groupBy("epoch").agg(F.max(version).alias("_new"))
            stale = new.join(old, "epoch", "left").where("_old is null or _new > _old").select("epoch")
            todo = docs.join(stale, "epoch", "left_semi")
    (build(todo).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(index_path))
    return spark.read.parquet(index_path)


def xml_dump(docs: DataFrame, key: str = "id") -> DataFrame:
    """``(id, xml)``."""
    return docs.select(key, "xml")


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per record."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
