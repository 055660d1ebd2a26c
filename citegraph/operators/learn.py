"""The Naive Bayes citation learner as joins and aggregates.

The original fetched each positive and negative document with one blocking
remote call.  Here:
  * positives (L1) are an equi-join of incoming citations with an exact-title
    index of the documents;
  * negatives (L2) are MD5-seeded draws joined to a dense index (W10);
  * training (L3) first aggregates the multiplicity of each (label, doc), then
    explodes each used document's n-grams once and sums ``mult * count`` per
    (label, n-gram): partial aggregation runs before the shuffle, so frequent
    n-grams do not make a hot reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.functions import constants as K
from citegraph.functions.text import explode_rows, nb_ngrams, term_counts, words
from citegraph.operators.graph import one_per_title
from citegraph.operators.sampling import md5_uniform, random_docs
from citegraph.session import cut_lineage, scratch_path

GOOD, BAD = K.NB_LABELS


def positives(docs: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """L1: ``(id, positive_id, mult)``.  For every document and every citation that
    points at it, the document whose exact title equals the citation's title
    (one per citation, so duplicates count)."""
    cited = edges.join(docs.select(F.col(key).alias("cited_id")), "cited_id", "left_semi")
    idx = one_per_title(docs.select(key, "title", "doc_id"), "title").select(
        F.col("title").alias("cited_title"), F.col(key).alias("positive_id")
    )
    hits = cited.join(idx, "cited_title")
    return hits.groupBy(F.col("cited_id").alias(key), "positive_id").agg(F.count(F.lit(1)).alias("mult"))


def negatives(docs: DataFrame, key: str = "id", k: int = K.NB_NEGATIVES_PER_DOC, seed: int = 0) -> DataFrame:
    """L2: ``(id, draw, sampled_id)``, ``k`` uniform draws with replacement per document."""
    return random_docs(docs, key, docs, key, k, seed)


def training_multiplicities(pos: DataFrame, neg: DataFrame, key: str = "id") -> DataFrame:
    """``(label, doc, mult)``: how often each document's text is trained per label."""
    g = pos.groupBy(F.col("positive_id").alias("doc")).agg(F.sum("mult").alias("mult")).withColumn("label", F.lit(GOOD))
    b = neg.groupBy(F.col("sampled_" + key).alias("doc")).agg(F.count(F.lit(1)).alias("mult")).withColumn(
        "label", F.lit(BAD)
    )
    return g.unionByName(b)


def nb_counts(mults: DataFrame, docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``(label, ngram, cnt)`` with cnt = sum over docs of mult * occurrences."""
    sums = _ngram_sums(mults, docs, key, text)
    long = sums.select(
        "ngram",
        F.explode(F.array(*[F.struct(F.lit(lab).alias("label"), F.col(f"_c{i}").alias("cnt"))
                            for i, lab in enumerate(K.NB_LABELS)])).alias("_x"),
    )
    return long.select("_x.label", "ngram", F.col("_x.cnt").cast("double").alias("cnt")).where(F.col("cnt") > 0)


def _ngram_sums(mults: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(ngram, _c0, _c1)``: a row for each n-gram with its counts by label.  Each used document is tokenised once,
    carrying one multiplicity per label."""
    per_doc = mults.groupBy("doc").agg(
        *[F.sum(F.when(F.col("label") == lab, F.col("mult")).otherwise(0)).alias(f"_m{i}") for i, lab in enumerate(K.NB_LABELS)]
    )
    m = per_doc.join(docs.select(F.col(key).alias("doc"), text), "doc")
    m = m.select("_m0", "_m1", words(F.col(text)).alias("_w"))
    grams = explode_rows(m, ["_m0", "_m1"], nb_ngrams("_w"), "ngram")
    return grams.groupBy("ngram").agg(F.sum("_m0").alias("_c0"), F.sum("_m1").alias("_c1"))


def nb_model(counts: DataFrame, min_count: float = 1.0, total=None) -> DataFrame:
    """Drop counts <= 1, weight = count / total, where the total covers all
    counts of both labels (including the dropped ones)."""
    if total is None:
        total = counts.select(F.sum("cnt")).scalar()
    return counts.where(F.col("cnt") > min_count).select(
        "label", "ngram", "cnt", total.alias("total"), (F.col("cnt") / total).alias("weight")
    )


def ngram_total(mults: DataFrame, docs: DataFrame, key: str = "id", text: str = "text"):
    """The sum of all counts of ``nb_counts``, as a scalar: a document with n words has n + max(n - 1, 0) n-grams, so
    word counts per document give it, without the n-gram table."""
    n = F.size(words(F.col(text))).cast("long")
    per_doc = mults.groupBy("doc").agg(F.sum("mult").alias("_m")).join(docs.select(F.col(key).alias("doc"), text), "doc")
    return per_doc.select(F.sum(F.col("_m") * (n + F.greatest(n - 1, F.lit(0)))).cast("double")).scalar()


def train(docs: DataFrame, edges: DataFrame, key: str = "id", k: int = K.NB_NEGATIVES_PER_DOC,
          seed: int = 0, training: DataFrame | None = None) -> DataFrame:
    """L3+L4 end to end; with ``training`` (keys) the texts of these documents only are learned from."""
    mults = _training(docs, edges, key, k, seed, training)
    return nb_model(nb_counts(mults, docs, key), total=ngram_total(mults, docs, key))


def _training(docs: DataFrame, edges: DataFrame, key: str, k: int, seed: int, training: DataFrame | None) -> DataFrame:
    mults = training_multiplicities(positives(docs, edges, key), negatives(docs, key, k, seed), key)
    if training is not None:
        mults = mults.join(training.select(F.col(key).alias("doc")), "doc", "left_semi")
    # at most two rows per document, read by the counts and by their total
    return cut_lineage(mults)


def wide_model(docs: DataFrame, edges: DataFrame, key: str = "id", k: int = K.NB_NEGATIVES_PER_DOC, seed: int = 0,
               training: DataFrame | None = None, min_count: float = 1.0) -> DataFrame:
    """``train``'s counts with one row per n-gram ``(ngram, good, bad)``, as ``write_model`` stores them: they come so
    from the sum over the documents, and are neither dealt out by label nor grouped a second time."""
    sums = _ngram_sums(_training(docs, edges, key, k, seed, training), docs, key, "text")
    good, bad = (F.when(F.col(c) > min_count, F.col(c).cast("double")).otherwise(0.0) for c in ("_c0", "_c1"))
    return sums.where((F.col("_c0") > min_count) | (F.col("_c1") > min_count)).select("ngram", good.alias("good"), bad.alias("bad"))


# ------------------------------------------------------------------ L4 applied
def write_model(model: DataFrame, path: str) -> None:
    """The model as a table with one row per n-gram ``(ngram, good, bad)``, dealt and sorted by n-gram."""
    good, bad = (F.coalesce(F.sum(F.when(F.col("label") == lab, F.col("cnt"))), F.lit(0.0)) for lab in K.NB_LABELS)
    model.groupBy("ngram").agg(good.alias("good"), bad.alias("bad")).sortWithinPartitions("ngram").write.mode("overwrite").parquet(path)


def nb_score(model: DataFrame, docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``(key, n_ngrams, n_known, log_odds)``: the log odds of the labels for every document, under a written model
    (``write_model``).

    An n-gram has the probability ``(count + 1) / (N + V + 1)`` under a label, where N is the sum of the label's stored
    counts and V the number of stored n-grams: the one more stands for all n-grams that training has not kept, so unseen ones have
    mass.  Every n-gram adds what an unseen one adds, and the known ones their difference to that: only those are
    joined.  A document's n-grams are counted in its row, so that a frequent n-gram is one row a document; they are joined
    to the model by n-gram and summed per document.  Null and empty texts have odds 0."""
    sums = model.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("v"))
    one = F.coalesce(F.col("good"), F.lit(0.0)) + F.col("v") + 1, F.coalesce(F.col("bad"), F.lit(0.0)) + F.col("v") + 1
    unseen = sums.select((F.log(one[1]) - F.log(one[0]))).scalar()
    ratio = F.log(F.col("good") + 1) - F.log(F.col("bad") + 1)  # to an unseen n-gram's odds
    counted = docs.select(key, words(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    # the n-grams are a column of their own: term_counts reads them twice
    found = explode_rows(counted.withColumn("_n", nb_ngrams("_w")), [key], term_counts("_n", "ngram", "n"), "g").select(key, "g.ngram", "g.n")
    found = found.join(model.select("ngram", ratio.alias("ratio")), "ngram")
    found = found.groupBy(F.col(key).alias("_key")).agg(F.sum("n").alias("n_known"), F.sum(F.col("n") * F.col("ratio")).alias("known"))
    size = F.size("_w").cast("long")
    whole = counted.select(key, (size + F.greatest(size - 1, F.lit(0))).alias("n_ngrams"))
    out = whole.join(found, F.col(key) == F.col("_key"), "left")
    odds = F.col("n_ngrams") * unseen + F.coalesce("known", F.lit(0.0))
    return out.select(key, "n_ngrams", F.coalesce("n_known", F.lit(0)).alias("n_known"), odds.alias("log_odds"))


def score_held_out(docs: DataFrame, edges: DataFrame, key: str = "id", folds: int = 5) -> DataFrame:
    """``nb_score`` of the documents of one fold (by a hash of their keys) under the model of the others."""
    fold = F.pmod(md5_uniform(key), F.lit(folds))
    path = scratch_path(docs.sparkSession, "model")
    wide_model(docs, edges, key, training=docs.where(fold != 0)).write.parquet(path)
    return nb_score(docs.sparkSession.read.parquet(path), docs.where(fold == 0), key)
