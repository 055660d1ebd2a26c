"""Web-archive captures.

S1 reads gzip web-archive files.  A gzip stream is not splittable, so (as in
the original input format) one task handles one file; ``binaryFile`` lists the
files and a small Arrow-batched ``mapInPandas`` helper splits each file into
records.  This record splitter is the only Python in the data path; admission
(S2, S3) and payload splitting (S4) are SQL expressions.
"""

from __future__ import annotations

import gzip
import io
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.functions import constants as K

CAPTURE_SCHEMA = "path string, record int, url string, length bigint, payload binary"


def _iter_records(stream, errors: list | None = None):
    """Yield (url, length, payload) for each record of one decompressed archive stream.

    Records start with a ``WARC/`` version line, then ``Name: value`` header lines,
    an empty line and ``Content-Length`` bytes of payload.  A record without a usable length is left out and
    reading goes on at the next ``WARC/`` line; a damaged or cut file ends after its last good
    record.  Either is noted in ``errors``.
    """
    errors = [] if errors is None else errors
    n_records = 0
    try:
        while True:
            line = stream.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                continue
            headers = {}
            while True:
                h = stream.readline()
                if not h or h in (b"\r\n", b"\n"):
                    break
                k, _, v = h.decode("utf-8", "replace").partition(":")
                headers[k.strip().lower()] = v.strip()
            length = headers.get("content-length", "0")
            n_records += 1
            if not length.isdecimal():
                errors.append(f"record {n_records}: bad length")
                continue
            payload = stream.read(int(length))
            if len(payload) < int(length):
                errors.append(f"record {n_records}: cut off")
                return
            yield headers.get("warc-target-uri") or None, int(length), payload
    except (OSError, EOFError, zlib.error) as e:
        errors.append(f"damaged after record {n_records}: {type(e).__name__}")


def _open(path: str):
    """Open a (gzip) archive as a stream through the Arrow file systems, so local,
    HDFS and object-store paths all work and the file is never held whole."""
    from pyarrow import fs

    filesystem, inner = fs.FileSystem.from_uri(path)
    raw = filesystem.open_input_stream(inner, compression=None)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw)


def _records(batches, batch_rows: int = 256, batch_bytes: int = 8 << 20):
    """mapInPandas body: stream every listed file record by record; a batch ends at so many rows or bytes."""
    import pandas as pd

    cols = ["path", "record", "url", "length", "payload"]
    for pdf in batches:
        out, size = [], 0
        for path in pdf["path"]:
            with _open(path) as stream:
                for k, (url, n, payload) in enumerate(_iter_records(stream)):
                    out.append((path, k, url, n, payload))
                    size += n
                    if len(out) >= batch_rows or size >= batch_bytes:
                        yield pd.DataFrame(out, columns=cols)
                        out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=cols)


def _states(batches):
    """mapInPandas body: one row per file with its good records and what was wrong."""
    import pandas as pd

    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            errors: list = []
            with _open(path) as stream:
                n = sum(1 for _ in _iter_records(stream, errors))
            rows.append((path, n, "; ".join(errors) or None))
        yield pd.DataFrame(rows, columns=["path", "records", "error"])


def archive_states(spark: SparkSession, glob: str) -> DataFrame:
    """``(path, records, error)`` of every archive file: whether `read_captures` gets all of it."""
    _ship_with_tasks()
    files = spark.read.format("binaryFile").load(glob).select("path")
    return files.mapInPandas(_states, "path string, records bigint, error string")


def read_captures(spark: SparkSession, glob: str) -> DataFrame:
    """CAPTURE rows ``(path, record, url, length, payload)`` from gzip archives.

    ``binaryFile`` only lists the files here (its ``content`` column is never read);
    each task streams its files, so an archive is never materialised as one value."""
    _ship_with_tasks()
    files = spark.read.format("binaryFile").load(glob).select("path")
    return files.mapInPandas(_records, CAPTURE_SCHEMA)


def _ship_with_tasks() -> None:
    """Pickle this module's record splitter by value, so executors run it without
    having the package installed (it only needs the standard library and Arrow)."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_captures(df: DataFrame, path: str) -> None:
    """Write CAPTURE rows ``(url, payload)`` as gzip web-archive records (one
    record per row, text payloads).  Used to build archives from tables."""
    body = F.decode(F.col("payload"), "UTF-8")
    rec = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\n"),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.col("url"), F.lit("\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Length: "), F.octet_length(F.col("payload")).cast("string"), F.lit("\r\n\r\n"),
        body, F.lit("\r\n"),
    )
    df.select(rec.alias("value")).write.mode("overwrite").option("compression", "gzip").text(path)


# ------------------------------------------------------------------ S2/S3 admission
def admit_captures(df: DataFrame, min_len: int = K.MIN_CAPTURE_LENGTH) -> DataFrame:
    """Adds lower-cased ``url``, ``status`` (MissingUrl / TooSmall / Admitted) and
    ``filetype`` (PDF / PostScript / Unknown-PS, admitted rows only)."""
    low = F.lower(F.col("url"))
    status = (
        F.when(F.col("url").isNull() | (F.col("url") == ""), F.lit("MissingUrl"))
        .when(F.col("length") < min_len, F.lit("TooSmall"))
        .otherwise(F.lit("Admitted"))
    )
    ftype = F.when(F.instr(low, ".pdf") > 0, F.lit("PDF")).when(F.instr(low, ".ps") > 0, F.lit("PostScript")).otherwise(
        F.lit("Unknown-PS")
    )
    return (
        df.withColumn("url", F.when(F.col("url") == "", F.lit(None)).otherwise(low))
        .withColumn("status", status)
        .withColumn("filetype", F.when(status == "Admitted", ftype))
    )


# ------------------------------------------------------------------ S4 payload split
def split_payload(df: DataFrame, min_bytes: int = K.MIN_CAPTURE_LENGTH,
                  min_out: int = K.MIN_CONVERTED_BYTES) -> DataFrame:
    """Adds ``body`` (bytes after the first CRLFCRLF), ``body_len`` and ``outcome``
    ``<filetype>.success|failure``: failure without a separator, with a payload
    under ``min_bytes``, or with a body of at most ``min_out`` bytes (the body
    stands for the converter output; the converter itself is not part of this
    library)."""
    latin = F.decode(F.col("payload"), "ISO-8859-1")  # one char per byte: positions are byte offsets
    pos = F.instr(latin, "\r\n\r\n")
    body = F.when(pos > 0, F.encode(F.substr(latin, pos + 4), "ISO-8859-1"))
    blen = F.octet_length(body)
    ok = (pos > 0) & (F.octet_length(F.col("payload")) >= min_bytes) & (blen > min_out)
    return (
        df.withColumn("body", body)
        .withColumn("body_len", blen)
        .withColumn(
            "outcome",
            F.when(F.col("filetype").isNotNull(),
                   F.concat(F.col("filetype"), F.when(ok, F.lit(".success")).otherwise(F.lit(".failure")))),
        )
    )


def ingest(captures: DataFrame) -> DataFrame:
    """Admitted, successfully split captures as documents ``(url, xml)``."""
    d = split_payload(admit_captures(captures))
    return d.where(F.col("outcome").endswith(".success")).select(
        "url", F.decode(F.col("body"), "UTF-8").alias("xml")
    )
