"""Incremental extract: two epochs arrive, each run processes only new files."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from citegraph.plans import fixtures as X
from citegraph.operators.incremental import Inversion
from citegraph.streaming import ingest_stream, invert_stream


def test_incremental_epochs(spark):
    root = tempfile.mkdtemp(prefix="citegraph-stream-")
    src, out = os.path.join(root, "in"), os.path.join(root, "out")
    docs = X.layout_documents(spark, "/root/testdata/sf0.001")
    docs.where("doc_id < 100").write.parquet(os.path.join(src, "epoch-1"))
    ingest_stream(spark, src + "/*", out).awaitTermination()
    first = spark.read.parquet(out).count()
    docs.where("doc_id >= 100").write.parquet(os.path.join(src, "epoch-2"))
    ingest_stream(spark, src + "/*", out).awaitTermination()
    total = spark.read.parquet(out)
    assert first == 100 and total.count() == docs.count()
    ingest_stream(spark, src + "/*", out).awaitTermination()  # a restart with nothing new adds nothing
    assert spark.read.parquet(out).count() == docs.count()
    assert total.select("doc_id").distinct().count() == docs.count()


def test_a_batch_lost_between_write_and_commit_changes_nothing(spark, tmp_path):
    """The stream is stopped after a batch has taken effect and before it is committed; the restarted stream runs it again."""
    docs = X.layout_documents(spark, "/root/testdata/sf0.001").where("doc_id < 40")
    for part in (0, 1):
        docs.where(F.col("doc_id") % 2 == part).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    ran = []

    def stop(batch_id):
        ran.append(batch_id)
        if ran == [0, 1]:
            raise RuntimeError("driver lost")

    with pytest.raises(Exception, match="driver lost"):
        invert_stream(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", max_files_per_trigger=1, after_batch=stop).awaitTermination()
    lost = Inversion(spark, f"{tmp_path}/out")
    rows, tables = sorted(map(tuple, lost.inverted().collect())), lost.state["tables"]
    assert len(rows) > 20 and set(lost.state["epochs"]) == {"batch-0", "batch-1"}
    invert_stream(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", max_files_per_trigger=1, after_batch=stop).awaitTermination()
    again = Inversion(spark, f"{tmp_path}/out")
    assert ran == [0, 1, 1]  # the same batch id, once more
    assert again.state["tables"] == tables and sorted(map(tuple, again.inverted().collect())) == rows
    invert_stream(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", after_batch=stop).awaitTermination()
    assert ran == [0, 1, 1]
