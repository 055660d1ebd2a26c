"""Citation graph: A1-A3, A10-A13, J1-J5, W1, W8, D4.

Scale notes.  A single title key may hold a large share of all citations
(popular papers, or many documents sharing an empty/boilerplate title).  So:
  * per-key results are computed with aggregates (partial aggregation before the
    shuffle), never by collecting a key's rows into one task;
  * joins are made between aggregated sides (one row per key), so a hot key
    cannot skew them; raw edge joins rely on AQE skew-join splitting;
  * the nested ``incoming`` lists come in chunks of bounded size, so a hot key
    has several rows; none of its citations is cut off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.functions import constants as K
from citegraph.functions.text import histogram_bucket
from citegraph.operators.sampling import md5_uniform


#: columns that hold whole documents
WIDE = ("xml", "text", "outgoing")


# ------------------------------------------------------------------ A1 counters
def count_status(df: DataFrame, col: str = "status") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ A2/A3 histograms
def histogram(df: DataFrame, value: str, name: str, scale: str = "log") -> DataFrame:
    """``(metric, bucket, n)`` counts of ``histogram_bucket(value)``."""
    return df.groupBy(histogram_bucket(F.col(value), scale).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    ).select(F.lit(name).alias("metric"), "bucket", "n")


# ------------------------------------------------------------------ A11/A12 dedup
def dedup_documents(docs: DataFrame, key: str = "id", size: str = "doc_len", tie: str = "doc_id") -> DataFrame:
    """One document per key: the largest ``size``; ties to the larger ``tie``.

    ``max_by`` is an aggregate, so each map task keeps one row per key before the
    shuffle (a hot key costs one row per task, not one task for all its rows).  Where there are whole
    texts (``WIDE``) the winner is chosen on narrow columns and its row joined back.  ``tie`` need not be unique (a page
    crawled twice has one id): rows that agree in key, ``tie`` and all narrow columns are merged by their texts.
    Adds ``n_merged`` = documents under the key.
    """
    cols = [c for c in docs.columns if c != key]
    rank = F.struct(F.col(size), F.col(tie))
    narrow = [c for c in cols if c not in WIDE]
    if len(narrow) == len(cols):
        agg = docs.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(rank, _mark(cols))).alias("_best"), F.count(F.lit(1)).alias("n_merged"))
        return agg.select(key, "_best.*", "n_merged")
    marked = docs.withColumn("_mark", _mark(narrow))
    each = marked.groupBy(key, F.col(tie).alias("_tie"), "_mark").agg(F.max(size).alias("_size"), F.count(F.lit(1)).alias("_n"))
    best = each.groupBy(F.col(key).alias("_key")).agg(
        F.max_by(F.struct("_tie", "_mark", "_n"), F.struct("_size", "_tie", "_mark")).alias("_b"), F.sum("_n").alias("n_merged")
    ).select("_key", "_b.*", "n_merged").withColumnRenamed("_mark", "_best_mark")
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(tie).eqNullSafe(F.col("_tie")) & (F.col("_mark") == F.col("_best_mark"))
    won = marked.join(best, same).select(key, *cols, "n_merged", "_n")
    # several rows with the winner's narrow columns: one of them, by its texts
    texts = _mark([c for c in cols if c in WIDE])
    again = won.where("_n > 1").groupBy(key).agg(F.max_by(F.struct(*cols, "n_merged"), texts).alias("_best")).select(key, "_best.*")
    return won.where("_n = 1").drop("_n").unionByName(again)


def _mark(cols) -> F.Column:
    """A hash of columns, to order what else is equal."""
    return F.xxhash64(*cols) if cols else F.lit(0)


# ------------------------------------------------------------------ J1/A10/A13 inversion
def incoming_counts(edges: DataFrame, cited: str = "cited_id") -> DataFrame:
    return edges.groupBy(cited).agg(F.count(F.lit(1)).alias("citations"))


def invert_citations(docs: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Docs LEFT OUTER citation counts by title key: every document is kept (``citations`` = 0 when uncited), citations to
    keys without a document are dropped.  The citations themselves are ``incoming_chunks``."""
    cnt = incoming_counts(edges).withColumnRenamed("cited_id", key)
    return docs.join(cnt, key, "left").withColumn("citations", F.coalesce(F.col("citations"), F.lit(0)))


def incoming_chunks(docs: DataFrame, edges: DataFrame, key: str = "id", chunk_size: int = K.INVERT_VALUES_PER_KEY) -> DataFrame:
    """``(key, chunk, n_chunks, incoming)``: all citations of every cited document of ``docs`` as
    array<struct<citing_id, pos, title, authors>> ordered by (citing_id, pos).

    A key with more than ``chunk_size`` citations has several rows: its citations are dealt over
    ``n_chunks`` = ceil(count / chunk_size) chunks by a hash of document and place (whatever steps the ids have), so that
    no value and no task holds a hot key's whole list, and nothing is cut off."""
    e = edges.select(F.col("cited_id").alias(key), "citing_id", "pos", F.col("cited_title").alias("title"), "authors")
    n = incoming_counts(edges).select(F.col("cited_id").alias(key), F.ceil(F.col("citations") / chunk_size).alias("n_chunks"))
    n = n.join(docs.select(key), key, "left_semi")
    dealt = e.join(n, key).withColumn("chunk", F.pmod(md5_uniform("citing_id", "pos"), F.col("n_chunks")))
    return dealt.groupBy(key, "chunk", "n_chunks").agg(F.array_sort(F.collect_list(F.struct("citing_id", "pos", "title", "authors"))).alias("incoming"))


# ------------------------------------------------------------------ J2/J3
def matches(edges: DataFrame, docs: DataFrame, key: str = "id", citing: str = "citing_id",
            distinct: bool = True) -> DataFrame:
    """In-corpus references ``(citing, cited_id)``: set form or duplicate-keeping form."""
    e = edges.select(citing, "cited_id").join(
        docs.select(F.col(key).alias("cited_id")), "cited_id", "left_semi"
    )
    return e.dropDuplicates([citing, "cited_id"]) if distinct else e


def dangling_references(edges: DataFrame, docs: DataFrame, key: str = "id") -> DataFrame:
    """Citations whose title key has no document (the "Missing Document" case)."""
    return edges.join(docs.select(F.col(key).alias("cited_id")), "cited_id", "left_anti")


# ------------------------------------------------------------------ W8
def top_matched(match_pairs: DataFrame, citing: str = "citing_id", k: int = K.EVAL_FOCUS_DOCS) -> DataFrame:
    """The ``k`` documents with the most distinct in-corpus references;
    ties by smaller key.  ``orderBy().limit()`` plans a per-partition top-k."""
    cnt = match_pairs.groupBy(citing).agg(F.count(F.lit(1)).alias("n_matches"))
    return cnt.orderBy(F.desc("n_matches"), F.asc(citing)).limit(k)


# ------------------------------------------------------------------ D4
def test_set_status(inverted: DataFrame, lo: int = K.TEST_SET_MIN_INCOMING,
                    hi: int = K.TEST_SET_MAX_INCOMING) -> DataFrame:
    """Adds ``status``: Too Few Citations / Too Many Citations / Selected."""
    r = F.col("citations")
    return inverted.withColumn(
        "status",
        F.when(r < lo, F.lit("Too Few Citations")).when(r > hi, F.lit("Too Many Citations")).otherwise(F.lit("Selected")),
    )


def test_set_counts(inverted: DataFrame, edges: DataFrame, key: str = "id", lo: int = K.TEST_SET_MIN_INCOMING,
                    hi: int = K.TEST_SET_MAX_INCOMING) -> DataFrame:
    """D4's counters ``(status, n)``: the documents by status, and the cited keys without one ("Missing Document")."""
    missing = dangling_references(edges, inverted, key).select("cited_id").distinct()
    labels = test_set_status(inverted, lo, hi).select("status").unionByName(missing.select(F.lit("Missing Document").alias("status")))
    return count_status(labels, "status")


def select_test_set(inverted: DataFrame, lo: int = K.TEST_SET_MIN_INCOMING, hi: int = K.TEST_SET_MAX_INCOMING) -> DataFrame:
    """Documents with lo <= incoming <= hi (one per key: the inverted table is deduplicated)."""
    return test_set_status(inverted, lo, hi).where(F.col("status") == "Selected").drop("status")


# ------------------------------------------------------------------ J4/J5 lookups
def one_per_title(docs: DataFrame, title: str = "title", order: str = "doc_id") -> DataFrame:
    """Exact-title index: for duplicate titles the last loaded (largest ``order``) wins."""
    cols = [c for c in docs.columns if c != title]
    g = docs.groupBy(title).agg(F.max_by(F.struct(*cols), F.col(order)).alias("_d"))
    return g.select(title, "_d.*")


def lookup_titles(keys: DataFrame, key_title: str, docs: DataFrame, title: str = "title") -> DataFrame:
    """Each key row joined to the document with exactly that title (inner)."""
    idx = one_per_title(docs, title)
    return keys.join(idx.withColumnRenamed(title, key_title), key_title)


def shard_of(key, n_shards: int = K.SHARDS):
    c = F.col(key) if isinstance(key, str) else key
    return F.pmod(c, F.lit(n_shards)).cast("int")


def lookup_ids(requests: DataFrame, docs: DataFrame, key: str = "id", n_shards: int = K.SHARDS) -> DataFrame:
    """Look documents up by (shard, key); unknown pairs give no row."""
    d = docs.withColumn("shard", shard_of(key, n_shards))
    return requests.join(d, ["shard", key])
