"""S1 for archives of many gzip members (one record each, as crawlers write them): a Spark data source whose input
partitions are runs of members, so that several tasks read one file.

``index_members`` finds the members: byte ranges of the files are searched side by side for places where a gzip header stands and
inflates to a record's first line.  The index (a table of runs with their members' offsets) gives the partitions of
the data source ``member_archive``; a damaged member is noted in its run's state, and reading goes on at the next one.
The source also writes such archives: a file a task, which gets its name when the job commits.

Files are opened by their URIs through Arrow's file systems (local, HDFS, object stores).
"""

from __future__ import annotations

import gzip
import sys
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from citegraph.session import scratch_path

CAPTURES = "path string, start bigint, record int, url string, length bigint, payload binary"
STATES = "path string, start bigint, members int, records int, error string"
#: compressed bytes of a run of members, and bytes of a file that a task searches for members
RUN_BYTES, RANGE_BYTES = 8 << 20, 32 << 20
#: what a gzip member starts with (fixed value): magic number and the deflate method
MAGIC = b"\x1f\x8b\x08"
#: compressed bytes that are enough to inflate a record's first line
PEEK = 512


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _read(path: str, start: int, size: int) -> bytes:
    filesystem, inner = _file_system(path)
    with filesystem.open_input_file(inner) as f:
        f.seek(start)
        return f.read(size)


def starts_member(data: bytes, at: int) -> bool:
    """Whether a member with a record starts at this place (known from its first bytes)."""
    if data[at : at + 3] != MAGIC or at + 3 >= len(data) or data[at + 3] & 0xE0:
        return False
    try:
        return zlib.decompressobj(31).decompress(data[at : at + PEEK], 16).startswith(b"WARC/")
    except zlib.error:
        return False


def record_of(data: bytes) -> tuple[str | None, int, bytes]:
    """(url, length, payload) of an inflated member."""
    head, _, rest = data.partition(b"\r\n\r\n")
    names = dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    names = {k.lower(): v for k, v in names.items()}
    length = names.get("content-length", "")
    if not data.startswith(b"WARC/") or not length.isdecimal():
        raise ValueError("no record")
    if len(rest) < int(length):
        raise ValueError("cut off")
    return names.get("warc-target-uri") or None, int(length), rest[: int(length)]


def members_of(path: str, offsets: list[int], end: int):
    """(offset, record or what is wrong) of each member of a run."""
    data = _read(path, offsets[0], end - offsets[0])
    for at, to in zip(offsets, [*offsets[1:], end]):
        part = data[at - offsets[0] : to - offsets[0]]
        try:
            inflate = zlib.decompressobj(31)
            whole = inflate.decompress(part)
            if not inflate.eof:
                raise ValueError("cut off")
            if inflate.unused_data:
                yield at, record_of(whole)
                raise ValueError(f"{len(inflate.unused_data)} bytes behind it are no member")
            yield at, record_of(whole)
        except (zlib.error, ValueError) as e:
            yield at, f"member at {at}: {e}"


class _Run(InputPartition):
    def __init__(self, path: str, offsets: list[int], end: int):
        self.path, self.offsets, self.end = path, offsets, end


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.index, self.states = options["index"], options.get("states") == "true"

    def partitions(self):
        import pyarrow.parquet as pq

        filesystem, inner = _file_system(self.index)
        rows = pq.read_table(inner, filesystem=filesystem, columns=["path", "offsets", "end"]).to_pylist()
        return [_Run(r["path"], r["offsets"], r["end"]) for r in rows]

    def read(self, run):
        records, wrong = 0, []
        for at, found in members_of(run.path, run.offsets, run.end):
            if isinstance(found, str):
                wrong.append(found)
                continue
            if not self.states:
                yield (run.path, run.offsets[0], records, *found)
            records += 1
        if self.states:
            yield run.path, run.offsets[0], len(run.offsets), records, "; ".join(wrong) or None


class _Writer(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")

    def write(self, rows):
        filesystem, inner = _file_system(self.path)
        filesystem.create_dir(f"{inner}/_temporary", recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        with filesystem.open_output_stream(f"{inner}/_temporary/{name}", compression=None) as f:
            for url, payload in rows:
                head = "WARC/1.0\r\nWARC-Type: response\r\n" + (f"WARC-Target-URI: {url}\r\n" if url is not None else "")
                f.write(gzip.compress(f"{head}Content-Length: {len(payload)}\r\n\r\n".encode() + bytes(payload) + b"\r\n\r\n", mtime=0))
        out = WriterCommitMessage()
        out.name = name
        return out

    def commit(self, messages):
        filesystem, inner = _file_system(self.path)
        for m in messages:
            if m is not None:
                filesystem.move(f"{inner}/_temporary/{m.name}", f"{inner}/{m.name}")
        filesystem.delete_dir(f"{inner}/_temporary")

    def abort(self, messages):
        filesystem, inner = _file_system(self.path)
        filesystem.delete_dir(f"{inner}/_temporary")


class MemberArchive(DataSource):
    """``member_archive``: options ``index`` (and ``states``) to read, ``path`` to write."""

    @classmethod
    def name(cls):
        return "member_archive"

    def schema(self):
        return STATES if self.options.get("states") == "true" else CAPTURES

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session; its code travels with the tasks."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(MemberArchive)


def index_members(spark: SparkSession, glob: str, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES) -> str:
    """Find the members of all archives and write the index: ``(path, start, end, offsets)``, a row per run of about
    ``run_bytes`` (one member at least).  Returns its path."""
    files = spark.read.format("binaryFile").load(glob).where("length > 0").select("path", "length")  # lists, reads nothing
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))).alias("at"))

    def search(batches):
        import pyarrow as pa

        for b in batches:
            for path, length, at in zip(*(c.to_pylist() for c in b.columns)):
                data = _read(path, at, range_bytes + PEEK)
                found, i = [], data.find(MAGIC)
                while 0 <= i < range_bytes:
                    if starts_member(data, i):
                        found.append(at + i)
                    i = data.find(MAGIC, i + 1)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(found)), pa.array([length] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["path", "length", "offset"])

    found = ranges.repartition("path", "at").mapInArrow(search, "path string, length long, offset long")
    runs = found.groupBy("path", "length", F.expr(f"offset div {run_bytes}").alias("run")).agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    following = F.lead(F.col("offsets")[0]).over(Window.partitionBy("path").orderBy("run"))  # a row per run of a file
    runs = runs.select("path", F.col("offsets")[0].alias("start"), F.coalesce(following, F.col("length")).alias("end"), "offsets")
    index = scratch_path(spark, "members")
    runs.write.parquet(index)
    return index


def read_archives(spark: SparkSession, glob: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """CAPTURE rows ``(path, start, record, url, length, payload)``; ``start`` is the run's place in its file, ``record`` counts
    the run's good records.  One input partition a run."""
    register(spark)
    return spark.read.format("member_archive").option("index", index_members(spark, glob, run_bytes)).load()


def run_states(spark: SparkSession, glob: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """``(path, start, members, records, error)`` of every run: whether ``read_archives`` gets all of it."""
    register(spark)
    return spark.read.format("member_archive").option("index", index_members(spark, glob, run_bytes)).option("states", "true").load()


def write_archives(df: DataFrame, path: str) -> None:
    """Write rows ``(url, payload)`` as archives with a gzip member a record, a file a task."""
    register(df.sparkSession)
    df.select("url", "payload").write.format("member_archive").mode("append").save(path)
