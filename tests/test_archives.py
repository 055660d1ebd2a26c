"""Archives of many gzip members: several tasks a file, damaged members, odd records."""

import glob
import gzip

import pytest

from citegraph.sources import archives as A

ROWS = [(f"http://x.example/{i}" if i % 7 else None, bytes([i % 251]) * (i * 37 % 5000) + b"\x1f\x8b\x08\x00 no member \r\n\r\n") for i in range(300)] + [("http://x.example/é", b"")]


@pytest.fixture()
def one_file(spark, tmp_path):
    A.write_archives(spark.createDataFrame(ROWS, "url string, payload binary").coalesce(1), f"file://{tmp_path}/in")
    (path,) = glob.glob(f"{tmp_path}/in/*.warc.gz")
    return path


def got(df):
    return sorted(((r.url, r.length, bytes(r.payload)) for r in df.collect()), key=str)


def want(rows):
    return sorted(((u, len(p), p) for u, p in rows), key=str)


@pytest.mark.parametrize("run_bytes", [1, 2000, 1 << 20])
def test_several_tasks_read_one_file(spark, one_file, run_bytes):
    df = A.read_archives(spark, one_file, run_bytes)
    parts = df.rdd.getNumPartitions()
    assert parts == (len(ROWS) if run_bytes == 1 else 1 if run_bytes > 100_000 else parts) and (run_bytes != 2000 or 3 < parts < 60)
    assert got(df) == want(ROWS)


def test_members_are_found_across_ranges(spark, one_file):
    whole = spark.read.parquet(A.index_members(spark, one_file, 1))
    cut = spark.read.parquet(A.index_members(spark, one_file, 1, range_bytes=97))
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect())) and whole.count() == len(ROWS)


def test_damaged_members_are_reported(spark, one_file, tmp_path):
    offsets = sorted(o for r in spark.read.parquet(A.index_members(spark, one_file, 1 << 20)).collect() for o in r.offsets)
    data = bytearray(open(one_file, "rb").read())
    for i in (5, 100):  # in the middle of these members
        at = offsets[i] + (offsets[i + 1] - offsets[i]) * 3 // 4
        data[at : at + 8] = b"\xff" * 8
    bad = tmp_path / "bad.warc.gz"
    bad.write_bytes(bytes(data[:-10]) )  # and the last one is cut off
    rows = [r for i, r in enumerate(ROWS) if i not in (5, 100, len(ROWS) - 1)]
    assert got(A.read_archives(spark, str(bad), 3000)) == want(rows)
    states = A.run_states(spark, str(bad), 3000).collect()
    assert sum(r.members for r in states) == len(ROWS) and sum(r.records for r in states) == len(rows)
    errors = "; ".join(r.error for r in states if r.error)
    assert all(f"member at {offsets[i]}" in errors for i in (5, 100, len(ROWS) - 1)) and errors.count("member at") == 3


def test_odd_members(spark, tmp_path):
    good = gzip.compress(b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    bad_length = gzip.compress(b"WARC/1.0\r\nContent-Length: x\r\n\r\nabc")
    short = gzip.compress(b"WARC/1.0\r\nContent-Length: 30\r\n\r\nabc")
    (tmp_path / "a.warc.gz").write_bytes(good + b"garbage" + good + bad_length + short + gzip.compress(b"no record") + good)
    (tmp_path / "b.warc.gz").write_bytes(b"")
    df = A.read_archives(spark, f"{tmp_path}/*.gz", 1 << 20)
    assert got(df) == [(None, 3, b"abc")] * 3
    (state,) = A.run_states(spark, f"{tmp_path}/*.gz", 1 << 20).collect()
    assert state.records == 3 and state.error.count("member at") == 3  # what is no record belongs to the member before it
