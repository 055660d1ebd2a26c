"""Table sources and sinks: epoch globs, XML folders, partial loads, sinks,
build-or-load cache and incremental refresh."""

import os
import tempfile

from pyspark.sql import functions as F

from citegraph.sources import files as S


def test_epochs_union_and_xml_dir(spark):
    root = tempfile.mkdtemp(prefix="citegraph-files-")
    a = spark.createDataFrame([(1, "a")], "id long, v string")
    b = spark.createDataFrame([(2, "b", 1.5)], "id long, v string, extra double")
    a.write.parquet(os.path.join(root, "epoch-1", "xml"))
    b.write.parquet(os.path.join(root, "epoch-2", "xml"))
    got = {(r.id, r.epoch, r.extra) for r in S.load_epochs(spark, os.path.join(root, "epoch-*", "xml")).collect()}
    assert got == {(1, "1", None), (2, "2", 1.5)}
    assert S.union_inputs(a, b).count() == 2
    xml_dir = os.path.join(root, "x", "deep")
    os.makedirs(xml_dir)
    for name, body in (("one.xml", "<pdf2xml>1</pdf2xml>"), ("two.txt", "no")):
        with open(os.path.join(xml_dir, name), "w") as f:
            f.write(body)
    rows = S.read_xml_dir(spark, os.path.join(root, "x")).collect()
    assert len(rows) == 1 and rows[0].xml == "<pdf2xml>1</pdf2xml>"


def test_sample_partitions_is_deterministic(spark):
    df = spark.range(0, 2000)
    a = {r.id for r in S.sample_partitions(df, "id", 10).collect()}
    b = {r.id for r in S.sample_partitions(df, "id", 10).collect()}
    assert a == b and 100 < len(a) < 300


def test_materialize_and_refresh(spark):
    root = tempfile.mkdtemp(prefix="citegraph-cache-")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)

    assert S.materialize(spark, root + "/t", build).count() == 5
    assert S.materialize(spark, root + "/t", build).count() == 5 and len(calls) == 1

    docs = spark.createDataFrame([(1, "e1"), (2, "e1")], "id long, epoch string")
    idx = S.refresh_index(spark, root + "/idx", docs, lambda d: d.withColumn("x", F.col("id") * 10))
    assert idx.count() == 2
    more = docs.unionByName(spark.createDataFrame([(3, "e2")], "id long, epoch string"))
    idx = S.refresh_index(spark, root + "/idx", more, lambda d: d.withColumn("x", F.col("id") * 10))
    assert sorted(r.id for r in idx.collect()) == [1, 2, 3]  # e1 was not rebuilt


def test_redelivered_epoch_replaces_the_old_one(spark):
    path = tempfile.mkdtemp(prefix="citegraph-cache-") + "/idx"

    def refresh(rows, mark):
        docs = spark.createDataFrame(rows, "id long, epoch string, v int")
        out = S.refresh_index(spark, path, docs, lambda d: d.withColumn("built", F.lit(mark)), version="v")
        return sorted((r.id, r.epoch, r.v, r.built) for r in out.collect())

    assert refresh([(1, "e1", 1), (2, "e2", 1)], "first") == [(1, "e1", 1, "first"), (2, "e2", 1, "first")]
    assert refresh([(1, "e1", 1), (2, "e2", 1)], "same") == [(1, "e1", 1, "first"), (2, "e2", 1, "first")]
    # e2 comes again with other rows, e3 is new
    assert refresh([(1, "e1", 1), (5, "e2", 2), (6, "e3", 1)], "later") == [(1, "e1", 1, "first"), (5, "e2", 2, "later"), (6, "e3", 1, "later")]


def test_write_table_partitions(spark):
    root = tempfile.mkdtemp(prefix="citegraph-sink-")
    S.write_table(spark.range(100).withColumn("k", F.col("id") % 7), root + "/t", key="k", partitions=4)
    assert spark.read.parquet(root + "/t").count() == 100
    assert S.to_json_lines(spark.range(1)).first().json == '{"id":0}'


def test_stages_are_stored_packed(spark, tmp_path):
    """Stage tables take half the disk of Spark's default: compressed with zstd, in the second Parquet format."""
    import pyarrow.parquet as pq

    from pyspark.sql import functions as F

    from citegraph.sources.files import Stages

    rows = spark.range(20_000).selectExpr("id", "concat('some words of ', id % 50, ' and more') text").repartition(2, "text")
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stages = Stages(spark, str(tmp_path / "out"))
    plain = stages.stage("plain", lambda: rows, [str(tmp_path / "in")])
    counted = stages.stage("counted", lambda: rows, ["plain"], None, {"n": F.lit(1)})
    for df in (plain, counted):
        assert df.exceptAll(rows).isEmpty() and df.count() == 20_000
        for f in df.inputFiles():
            meta = pq.ParquetFile(f.removeprefix("file://").removeprefix("file:")).metadata
            assert all(meta.row_group(g).column(c).compression == "ZSTD" for g in range(meta.num_row_groups) for c in range(meta.num_columns))
            assert all("DELTA_BINARY_PACKED" in meta.row_group(g).column(0).encodings or meta.row_group(g).column(0).has_dictionary_page for g in range(meta.num_row_groups))
    assert [(r.counter, r.n) for r in stages.counters("counted").collect()] == [("n", 20_000)]
