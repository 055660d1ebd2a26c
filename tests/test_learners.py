"""The learner interface: merging does not depend on how documents are dealt or when states are sent on."""

import pytest
from pyspark.sql import functions as F

from citegraph.operators import learn as L
from citegraph.operators.learners import Learner, Lengths, NaiveBayes, learn

DOCS = [(1, "Alpha beta alpha. Beta’s end", 2, 0), (2, "beta beta", 1, 3), (3, "", 1, 1), (4, None, 0, 2), (5, "Größe 12 x", 0, 1)]


@pytest.mark.parametrize("parts, most", [(1, 1), (1, 1000), (4, 2)])
def test_naive_bayes_equals_the_columnar_one(spark, parts, most):
    docs = spark.createDataFrame(DOCS, "id long, text string, good long, bad long")
    mults = docs.select(F.lit("good-cite").alias("label"), F.col("id").alias("doc"), F.col("good").alias("mult")).union(docs.select(F.lit("bad-cite"), "id", "bad"))
    want = sorted(map(tuple, L.nb_model(L.nb_counts(mults, docs)).collect()))
    got = sorted(map(tuple, learn(NaiveBayes(), docs.repartition(parts), most).collect()))
    assert got == want and got


def test_lengths(spark):
    docs = spark.createDataFrame([(1, "abcd", 1, 0), (2, "ab", 3, 1), (3, None, 0, 1)], "id long, text string, good long, bad long")
    got = {r.label: (r.n, r.mean, r.variance) for r in learn(Lengths(), docs.repartition(3)).collect()}
    assert got == {"good-cite": (4, 2.5, 0.75), "bad-cite": (2, 1.0, 1.0)}


def test_a_learner_of_ones_own(spark):
    class Longest(Learner):
        columns, key, values = ("id", "text"), "first string", "size long"
        merge = staticmethod(F.max)

        def add(self, state, i, text):
            k = ((text or "?")[:1].lower(),)
            state[k] = [max(len(text or ""), *state.get(k, [0]))]

        def finish(self, merged):
            return merged.where("size > 0")

    docs = spark.createDataFrame(DOCS, "id long, text string, good long, bad long").repartition(3)
    assert {r.first: r.size for r in learn(Longest(), docs, 1).collect()} == {"a": 28, "b": 9, "g": 10}
    assert learn(Longest(), docs.limit(0)).collect() == []
