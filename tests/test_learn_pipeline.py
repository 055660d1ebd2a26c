"""Learner on hand-made rows and the batch pipeline end to end."""

import math
import os

import pytest
from pyspark.sql import functions as F

from citegraph.operators import learn as L
from citegraph.plans import fixtures as X
from citegraph.plans.pipeline import run_pipeline
from citegraph.sources.files import Stages, observed


def test_nb_model_counts_and_total(spark):
    docs = spark.createDataFrame([(1, "Alpha beta", "Alpha beta alpha"), (2, "Gamma", "beta beta")],
                                 "id long, title string, text string")
    mults = spark.createDataFrame([("good-cite", 1, 2), ("bad-cite", 2, 1)], "label string, doc long, mult long")
    counts = {(r.label, r.ngram): r.cnt for r in L.nb_counts(mults, docs).collect()}
    assert counts[("good-cite", "Alpha")] == 2 and counts[("good-cite", "alpha")] == 2
    assert counts[("good-cite", "Alpha beta")] == 2 and counts[("bad-cite", "beta beta")] == 1
    model = L.nb_model(L.nb_counts(mults, docs)).collect()
    # 2 * (3 + 2) good updates + 1 * (2 + 1) bad updates
    assert {r.total for r in model} == {13.0}
    assert all(r.cnt > 1 for r in model)


def test_total_without_the_ngram_table(spark):
    docs = spark.createDataFrame([(1, "Alpha beta alpha"), (2, "beta"), (3, ""), (4, None)], "id long, text string")
    mults = spark.createDataFrame([("good-cite", i, i) for i in (1, 2, 3, 4)] + [("bad-cite", 1, 4)], "label string, doc long, mult long")
    counted = L.nb_counts(mults, docs).agg(F.sum("cnt")).first()[0]
    assert spark.range(1).select(L.ngram_total(mults, docs)).first()[0] == counted == 5 * 5 + 2


def test_scores_by_hand(spark, tmp_path):
    rows = [("good-cite", "a", 4.0), ("bad-cite", "a", 2.0), ("good-cite", "a b", 3.0), ("bad-cite", "c", 6.0)]
    model = spark.createDataFrame(rows, "label string, ngram string, cnt double")
    L.write_model(model, str(tmp_path / "model"))
    docs = spark.createDataFrame([(1, "a b"), (2, "x a a"), (3, ""), (4, None), (5, "y z")], "id long, text string")
    got = {r.id: (r.n_ngrams, r.n_known, r.log_odds) for r in L.nb_score(spark.read.parquet(str(tmp_path / "model")), docs).collect()}
    p = {"a": (5 / 11, 3 / 12), "a b": (4 / 11, 1 / 12), "c": (1 / 11, 7 / 12)}  # counts and one, over N + V + 1 = 7 + 3 + 1 and 8 + 3 + 1

    def odds(*grams):
        return sum(math.log(p.get(g, (1 / 11, 1 / 12))[0]) - math.log(p.get(g, (1 / 11, 1 / 12))[1]) for g in grams)

    want = {1: (3, 2, odds("a", "b", "a b")), 2: (5, 2, odds("x", "a", "a", "x a", "a a")), 3: (0, 0, 0.0), 4: (0, 0, 0.0), 5: (3, 0, odds("y", "z", "y z"))}
    assert got.keys() == want.keys()
    for i, (n, known, value) in want.items():
        assert got[i][:2] == (n, known) and abs(got[i][2] - value) < 1e-12


def test_positives_by_exact_title(spark):
    docs = spark.createDataFrame([(10, 1, "Paper A"), (20, 2, "Paper B")], "id long, doc_id long, title string")
    edges = spark.createDataFrame([(2, 0, "Paper A", 10), (2, 1, "PAPER A", 10), (1, 0, "Paper B", 20)],
                                  "citing_id long, pos int, cited_title string, cited_id long")
    got = sorted((r.id, r.positive_id, r.mult) for r in L.positives(docs, edges).collect())
    assert got == [(10, 10, 1), (20, 20, 1)]


STAGES = ["document", "edges", "doc-plus-cites", "incoming", "index"]


@pytest.fixture(scope="module")
def layouts(spark, tmp_path_factory):
    """Layouts in two files; the first run over them."""
    root = str(tmp_path_factory.mktemp("pipe"))
    docs = X.layout_documents(spark, "/root/testdata/sf0.001").where("doc_id < 60")
    for part in (0, 1):
        docs.where(F.col("doc_id") % 2 == part).coalesce(1).write.parquet(f"{root}/xml/part={part}")
    st = Stages(spark, f"{root}/run")
    return root, st, run_pipeline(spark, f"{root}/xml", f"{root}/run", stages=st)


def test_run_pipeline_resumes(spark, layouts):
    root, st, res = layouts
    n = res["inverted"].count()
    assert st.built == STAGES and n > 0 and res["postings"].count() > 0
    assert res["documents"].where(F.col("status") == "GoodTitle").count() >= n
    again = Stages(spark, f"{root}/run")
    assert run_pipeline(spark, f"{root}/xml", f"{root}/run", stages=again)["inverted"].count() == n
    assert again.built == [] and again.loaded == STAGES


def test_counters_are_those_of_the_table(spark, layouts):
    _, _, res = layouts
    seen = {r.counter: r.n for r in res["counters"].collect()}
    status = {r.status: r["count"] for r in res["documents"].groupBy("status").count().collect()}
    good = res["documents"].where("status = 'GoodTitle'").select(F.size("outgoing").alias("n"))
    assert {k: v for k, v in seen.items() if k.endswith("Title") and v} == status
    assert (seen["citations"], seen["citing"], seen["TooLong"]) == (*good.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first(), 0)


def test_counters_need_no_second_scan(spark, layouts):
    root, _, _ = layouts
    df, seen = observed(spark.read.parquet(f"{root}/xml").select("doc_id"), {"rows": F.lit(1), "even": F.col("doc_id") % 2 == 0})
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan and "Exchange" not in plan
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 60, "even": 30}


def test_counters_count_a_retried_task_once(spark, tmp_path):
    """A task that fails after some rows is run again: its first try leaves no trace in the counters."""
    import subprocess
    import sys
    import textwrap

    code = textwrap.dedent(f"""
        import os
        from pyspark.sql import SparkSession, functions as F
        from citegraph.sources.files import observed
        spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
        def flaky(batches):
            for b in batches:
                yield b
            if not os.path.exists({str(tmp_path / "failed")!r}):
                open({str(tmp_path / "failed")!r}, "w").close()
                raise RuntimeError("lost once")
        df, seen = observed(spark.range(0, 1000, 1, 1).mapInArrow(flaky, "id long"), {{"rows": F.lit(1)}})
        df.write.format("noop").mode("overwrite").save()
        print("rows", seen.get["rows"])
    """)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=300)
    assert "rows 1000" in out.stdout and os.path.exists(tmp_path / "failed"), out.stderr[-2000:]


def test_a_changed_file_rebuilds_what_lies_below_it(spark, layouts):
    root, _, _ = layouts
    one, two = f"{root}/xml/part=0", f"{root}/xml/part=1"
    st = Stages(spark, f"{root}/two")

    def build(st):
        a = st.stage("a", lambda: spark.read.parquet(one), [one])
        b = st.stage("b", lambda: spark.read.parquet(two), [two], {"x": 1})
        return st.stage("c", lambda: a.select("doc_id").union(b.select("doc_id")), ["a", "b"])

    assert build(st).count() == 60 and st.built == ["a", "b", "c"]
    spark.createDataFrame([(500, "u", "<x/>")], "doc_id long, url string, xml string").coalesce(1).write.mode("append").parquet(two)
    st = Stages(spark, f"{root}/two")
    assert build(st).count() == 61 and (st.loaded, st.built) == (["a"], ["b", "c"])
    # a stage that was lost before its commit is not loaded
    os.remove(f"{st.paths['b']}/table/_SUCCESS")
    st = Stages(spark, f"{root}/two")
    assert build(st).count() == 61 and (st.loaded, st.built) == (["a", "c"], ["b"])
    # another parameter is another table
    st = Stages(spark, f"{root}/two")
    st.stage("b", lambda: spark.read.parquet(two).limit(1), [two], {"x": 2})
    assert st.built == ["b"]


def test_wide_model_is_the_written_model(spark, tmp_path):
    texts = ["red boat red boat", "red sea", "", None, "boat sea boat", "red boat on the sea"]
    docs = spark.createDataFrame([(i, i, f"title {i}", t) for i, t in enumerate(texts)], "id long, doc_id long, title string, text string")
    edges = spark.createDataFrame([(0, 1, "title 2"), (2, 0, "title 4"), (5, 4, "title 1")], "citing_id long, cited_id long, cited_title string")
    for training in (None, docs.where("id > 1")):
        L.write_model(L.train(docs, edges, training=training), str(tmp_path / f"{training is None}"))
        want = sorted(map(tuple, spark.read.parquet(str(tmp_path / f"{training is None}")).collect()))
        wide = L.wide_model(docs, edges, training=training)
        assert sorted(map(tuple, wide.collect())) == want and want
        # one exchange by n-gram: the counts are not dealt out by label and grouped again
        plan = wide._jdf.queryExecution().executedPlan().toString()
        assert "Generate explode(array" not in plan
