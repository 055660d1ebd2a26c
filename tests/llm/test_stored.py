"""Stored tables: the shuffles that made them leave no files, and the session's own setting stays."""

import time

from pyspark.sql import functions as F

from citegraph.llm.common import shuffles_removed, stored
from citegraph.llm.components import connected_components

KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in found.split("\n") if "/shuffle_" in f}


def left_over(spark, before):
    for _ in range(50):  # removal is not waited for
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    return left


def test_shuffles_of_a_stored_table_are_removed(spark):
    before = shuffle_files(spark)
    t = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    assert sorted(map(tuple, t.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]
    assert not left_over(spark, before)


def test_components_leave_no_shuffles(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30) if i != 15] + [(7, 7), (3, None)], "a long, b long")
    before = shuffle_files(spark)
    comps = stored(connected_components(links), "components")
    assert dict(map(tuple, comps.collect())) == {i: 0 if i <= 15 else 16 for i in range(31)}
    assert len(left_over(spark, before)) <= 64  # of the checks of a round's end, one row each


def test_the_sessions_own_choice_stays(spark):
    assert spark.conf.get(KEY, None) in (None, "false")
    spark.conf.set(KEY, "false")
    with shuffles_removed(spark):
        assert spark.conf.get(KEY) == "true"
    assert spark.conf.get(KEY) == "false"
    spark.conf.unset(KEY)
