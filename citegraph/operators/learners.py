"""Learners as plug-ins of one distributed aggregate.

A learner sees the documents of a partition one by one and keeps a state of partial results by key; states are small (they are sent
on when they reach ``MOST`` keys), partial results of one key merge associatively, in any order, and the merged table is
finished into the model.  Spark deals the documents, merges with partial aggregation before and after its shuffle, and runs
lost partitions again; no state or model passes through the driver.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegraph.functions import constants as K
from citegraph.functions.text import WORD
from citegraph.operators.learn import negatives, nb_model, positives, training_multiplicities
from citegraph.session import cut_lineage, scratch_path

#: keys of a partition's state that are sent on at once
MOST = 200_000


class Learner(ABC):
    """What a learner has to say; see ``NaiveBayes`` and ``Lengths``."""

    #: columns of the documents that ``add`` gets, in order
    columns: tuple[str, ...]
    #: key columns and value columns of partial results, as DDL
    key: str
    values: str
    #: how two partial values of a column merge: an associative, commutative aggregate
    merge: Callable[[str], Column] = staticmethod(F.sum)

    @abstractmethod
    def add(self, state: dict, *document) -> None:
        """Take a document into the state, a dict from key tuples to lists of values."""

    @abstractmethod
    def finish(self, merged: DataFrame) -> DataFrame:
        """The model from the merged partial results (one row a key)."""


def learn(learner: Learner, docs: DataFrame, most: int = MOST) -> DataFrame:
    """Run a learner over all documents."""
    schema = f"{learner.key}, {learner.values}"
    names = [c.split()[0] for c in schema.split(", ")]
    n_key = learner.key.count(",") + 1

    def partials(batches) -> Iterable:
        import pyarrow as pa

        def rows(state):
            columns = zip(*((*k, *v) for k, v in state.items()))
            return pa.RecordBatch.from_pydict(dict(zip(names, map(list, columns))), schema=arrow)

        state: dict = {}
        for b in batches:
            for document in zip(*(c.to_pylist() for c in b.columns)):
                learner.add(state, *document)
                if len(state) >= most:
                    yield rows(state)
                    state.clear()
        if state:
            yield rows(state)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    partial = docs.select(*learner.columns).mapInArrow(partials, schema)
    merged = partial.groupBy(*names[:n_key]).agg(*[learner.merge(c).alias(c) for c in names[n_key:]])
    path = scratch_path(docs.sparkSession, "learned")  # a model's steps may read it more than once
    merged.write.parquet(path)
    return learner.finish(docs.sparkSession.read.parquet(path))


class NaiveBayes(Learner):
    """L3: n-gram counts of the documents' texts, as often as each is trained per label; the model of ``learn.nb_model``."""

    columns = ("text", "good", "bad")
    key, values = "ngram string", "good long, bad long"

    def __init__(self):
        self._word = None

    def add(self, state, text, good, bad):
        if self._word is None:
            import regex

            self._word = regex.compile(WORD)
        words = self._word.findall(text or "")
        for gram in [*words, *map(" ".join, zip(words, words[1:]))]:
            counts = state.setdefault((gram,), [0, 0])
            counts[0] += good
            counts[1] += bad

    def finish(self, merged):
        each = F.array(*[F.struct(F.lit(lab).alias("label"), F.col(c).cast("double").alias("cnt")) for lab, c in zip(K.NB_LABELS, ("good", "bad"))])
        counts = merged.select("ngram", F.explode(each).alias("x")).select("x.label", "ngram", "x.cnt").where("cnt > 0")
        return nb_model(counts)


class Lengths(Learner):
    """How long the documents trained per label are: a normal distribution of their characters."""

    columns = ("text", "good", "bad")
    key, values = "label string", "n long, total long, squares long"

    def add(self, state, text, good, bad):
        size = len(text or "")
        for label, times in zip(K.NB_LABELS, (good, bad)):
            if times:
                sums = state.setdefault((label,), [0, 0, 0])
                sums[0] += times
                sums[1] += times * size
                sums[2] += times * size * size

    def finish(self, merged):
        mean = F.col("total") / F.col("n")
        return merged.select("label", "n", mean.alias("mean"), (F.col("squares") / F.col("n") - mean * mean).alias("variance"))


def training_texts(docs: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """``(key, text, good, bad)``: the documents that L1 and L2 choose, with how often each is trained per label."""
    mults = training_multiplicities(positives(docs, edges, key), negatives(docs, key), key)
    times = [F.sum(F.when(F.col("label") == lab, F.col("mult")).otherwise(0)).cast("long").alias(c) for lab, c in zip(K.NB_LABELS, ("good", "bad"))]
    per_doc = cut_lineage(mults.groupBy(F.col("doc").alias(key)).agg(*times))
    return per_doc.join(docs.select(key, "text"), key).select(key, "text", "good", "bad")
