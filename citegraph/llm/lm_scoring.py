"""Operator 1: stupid-backoff scores against count tables of the whole corpus.

An n-gram's score is ``count(ngram) / count(context)`` if the n-gram is in the count tables, else
`BACKOFF` times the score of the n-gram without its first word; a word's score is its share of all words.
The tables hold all n-grams; a caller may prune those counted fewer than `min_count` times.
A document's score is the sum of the logarithms over its words, each with up to ``order - 1`` words before it.

Rows of (document, n-gram) would be many times the texts, so n-grams travel pre-aggregated:

1. Documents are read once and stored as batches: word numbers within the batch and the words' hashes.
2. Level by level (words, pairs, ...) each batch sends its distinct n-gram hashes with their counts, cut into shards by
   hash.  An n-gram with a part that occurs once in the corpus occurs once itself: its count is known and not
   sent.  (Where tables are pruned, one with a pruned part is not sent either: it cannot reach `min_count`.)
3. A shard adds up the counts of all batches (the count table, partitioned by hash) and answers each batch with the
   totals of what it sent, in the order sent.
4. The answers are joined to the batches, one group a batch; batches are stored bucketed by their number, so they are
   not shuffled.  Words are scored and summed per document.

A frequent n-gram is one entry per batch, whatever its count, so no shard gets a hot key.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import short_batches, stored, tidy
from citegraph.llm.shingles import hash_words, mix, words_of
from citegraph.session import scratch_path

ORDER, BACKOFF, MIN_COUNT = 3, 0.4, 1
#: words of a batch (a document is never cut) and entries of a shard, about
BATCH_WORDS, SHARD_ENTRIES = 2_000_000, 1_500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


# ------------------------------------------------------------------ packed arrays
def pack_sorted(h: np.ndarray) -> bytes:
    """Sorted distinct hashes as steps of 6 bytes, or of 8 where one does not fit."""
    steps = np.diff(h, prepend=np.uint64(0))
    if len(steps) and steps.max() >> np.uint64(48):
        return b"\x08" + steps.astype("<u8").tobytes()
    return b"\x06" + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    size = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, size)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :size] = raw
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def pack_counts(c: np.ndarray) -> bytes:
    """Counts as bytes; 255 stands for a count in the list of 8-byte integers behind."""
    large = c[c >= 255].astype("<i8")
    return np.array([len(large)], "<u4").tobytes() + large.tobytes() + np.minimum(c, 255).astype(np.uint8).tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    out = np.frombuffer(data, np.uint8, offset=4 + 8 * n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", n, 4)
    return out


# ------------------------------------------------------------------ batches
def _batches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(task, seq, docs, sizes, vocabulary, low, high): the words of about `BATCH_WORDS` words of documents."""

    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        hashes: list[np.ndarray] = []
        held = 0

        def row():
            words = np.concatenate(hashes)
            vocabulary, at, n = np.unique(words, return_inverse=True, return_counts=True)
            rank = np.empty(len(n), np.int64)
            rank[np.argsort(-n, kind="stable")] = np.arange(len(n))  # frequent words get small numbers
            number = rank[at]
            ordered = np.empty_like(vocabulary)
            ordered[rank] = vocabulary
            cols = [
                pa.array([task], pa.int32()), pa.array([seq], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(h) for h in hashes]], pa.list_(pa.int64())),
                pa.array([ordered.astype("<u8").tobytes()], pa.binary()), pa.array([(number & 0xFFFF).astype("<u2").tobytes()], pa.binary()), pa.array([(number >> 16).astype("<u2").tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["task", "seq", "docs", "sizes", "vocabulary", "low", "high"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                h = hash_words(words_of(text.as_py()))
                if hashes and held + len(h) > BATCH_WORDS:
                    yield row()
                    ids, hashes, held, seq = [], [], 0, seq + 1
                ids.append(doc)
                hashes.append(h)
                held += len(h)
        if hashes:
            yield row()

    cols = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return cols.mapInArrow(tidy(run), "task int, seq int, docs array<long>, sizes array<long>, vocabulary binary, low binary, high binary")


class Batch:
    """A batch's words with the counts known so far: `counts[1]` per word of the vocabulary, `counts[k]` per position
    of the k-gram that ends there, 0 if there is none or it was pruned."""

    def __init__(self, row: dict, order: int):
        self.docs, self.sizes = row["docs"], np.asarray(row["sizes"], np.int64)
        self.vocabulary = np.frombuffer(row["vocabulary"], "<u8")
        self.number = np.frombuffer(row["low"], "<u2").astype(np.int32) | np.frombuffer(row["high"], "<u2").astype(np.int32) << 16
        self.place = np.arange(len(self.number), dtype=np.int32) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes).astype(np.int32)
        self.order, self.counts = order, {}

    def candidates(self, k: int, min_count: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the k-grams whose two parts were kept and occur more than once; of k = 1, the words of the
        vocabulary."""
        if k == 1:
            return np.arange(len(self.vocabulary)), mix(self.vocabulary)
        kept = (self.counts[1][self.number] if k == 2 else self.counts[k - 1]) >= max(min_count, 2)
        kept[1:] &= kept[:-1].copy()
        at = np.flatnonzero(kept & (self.place >= k - 1))
        h = np.full(len(at), k, np.uint64)
        for j in range(k - 1, -1, -1):
            h *= _STEP
            h += self.vocabulary[self.number[at - j]]
            h = mix(h)
        return at, h

    def distinct(self, k: int, min_count: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct k-gram hashes in order, and their counts."""
        h = self.candidates(k, min_count)[1]
        if k == 1:
            order = h.argsort()
            return h[order], np.bincount(self.number, minlength=len(h))[order]
        h.sort()
        starts = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), h[1:] != h[:-1])))
        return h[starts], np.diff(starts, append=len(h))

    def learn(self, k: int, totals: np.ndarray, min_count: int):
        """Take the totals of the distinct k-grams in order of their hashes; k-grams that were not sent occur once."""
        at, h = self.candidates(k, min_count)
        order = h.argsort()
        h = h[order]
        rank = np.cumsum(np.concatenate((np.zeros(min(len(h), 1), bool), h[1:] != h[:-1])))
        del h
        out = np.zeros(len(self.vocabulary), np.int64) if k == 1 else ((self.place >= k - 1) & (min_count <= 1)).astype(np.int64)
        n = totals[rank]
        out[at[order]] = n if k == 1 else np.where(n >= min_count, n, 0)
        self.counts[k] = out

    def scores(self, words: int, backoff: float) -> np.ndarray:
        """Per document the sum of the words' log scores."""
        if not len(self.number):
            return np.zeros(len(self.sizes))
        top = np.minimum(self.place + 1, self.order)
        out = np.log(self.counts[1] / words)[self.number] + (top - 1) * np.log(backoff)
        for k in range(2, self.order + 1):
            at = np.flatnonzero(self.counts[k])
            context = self.counts[1][self.number[at - 1]] if k == 2 else self.counts[k - 1][at - 1]
            out[at] = np.log(self.counts[k][at] / context) + (top[at] - k) * np.log(backoff)
        ends = np.cumsum(self.sizes)
        return np.array([out[e - n : e].sum() for e, n in zip(ends, self.sizes)])


def _sent(batch: Batch, task: int, seq: int, k: int, shards: int, min_count: int) -> pa.RecordBatch | None:
    """The distinct k-grams of a batch with their counts, a row per shard."""
    h, n = batch.distinct(k, min_count)
    if not len(h):
        return None
    cut = np.append(np.searchsorted(h, np.arange(shards, dtype=np.uint64) * np.uint64((1 << 64) // shards)), len(h))
    rows = [(s, pack_sorted(h[a:b]), pack_counts(n[a:b])) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
    cols = [
        pa.array([s for s, _, _ in rows], pa.int32()), pa.array([k] * len(rows), pa.int32()), pa.array([task] * len(rows), pa.int32()), pa.array([seq] * len(rows), pa.int32()),
        pa.array([x for _, x, _ in rows], pa.binary()), pa.array([x for _, _, x in rows], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["shard", "level", "task", "seq", "hashes", "counts"])


def _table(schema: str) -> pa.Table:
    """An empty table of a Spark schema."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    names, types = zip(*(x.rsplit(" ", 1) for x in schema.split(", ")))
    return pa.schema([(n.strip("`"), kinds[t]) for n, t in zip(names, types)]).empty_table()


_SENT = "shard int, level int, task int, seq int, hashes binary, counts binary"


def _answers(sent: DataFrame) -> DataFrame:
    """(task, seq, level, shard, totals): a shard adds up all batches' counts and answers each batch."""

    def add(t: pa.Table) -> pa.Table:
        hashes = [unpack_sorted(x.as_py()) for x in t.column("hashes")]
        counts = [unpack_counts(x.as_py()) for x in t.column("counts")]
        every = np.concatenate(hashes)
        order = every.argsort()
        every = every[order]
        rank = np.cumsum(np.concatenate((np.zeros(1, bool), every[1:] != every[:-1])))
        back = np.empty_like(rank)
        back[order] = rank
        del every, order, rank
        total = np.zeros(back.max() + 1, np.int64)
        np.add.at(total, back, np.concatenate(counts))
        ends = np.cumsum([len(h) for h in hashes])
        out = [pack_counts(total[back[e - len(h) : e]]) for e, h in zip(ends, hashes)]
        return pa.table({"task": t.column("task"), "seq": t.column("seq"), "level": t.column("level"), "shard": t.column("shard"), "totals": pa.array(out, pa.binary())})

    return sent.groupBy("level", "shard").applyInArrow(add, "task int, seq int, level int, shard int, totals binary")


def _one(batches: pa.Table) -> dict:
    """The row of a batch's group."""
    return batches.to_pylist()[0]


def _with_answers(kept: DataFrame, answers: DataFrame, order: int, min_count: int, known: int, each, schema: str) -> DataFrame:
    """`each(batch, task, seq)` over the batches that know the totals up to level `known`; a batch and its answers are
    brought together by the batch's number."""

    def run(batches: pa.Table, totals: pa.Table) -> pa.Table:
        np.seterr(over="ignore", divide="ignore")
        row = _one(batches)
        batch = Batch(row, order)
        answered = sorted(zip(*(totals.column(c).to_pylist() for c in ("level", "shard", "totals"))), key=lambda r: r[:2])
        for k in range(1, known + 1):
            parts = [unpack_counts(x) for level, _, x in answered if level == k]
            batch.learn(k, np.concatenate([np.empty(0, np.int64), *parts]), min_count)
        result = each(batch, row["task"], row["seq"])
        return _table(schema) if result is None else pa.Table.from_batches([result])

    return kept.groupBy("task", "seq").cogroup(answers.groupBy("task", "seq")).applyInArrow(run, schema)


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """One row per row of `docs`: `id_col`, n_words, score (sum of the log scores of its words) and mean_score (per word).

    Words are parted at ASCII white space, with A-Z lower-cased; counts cover all rows.  Null and empty texts and
    texts without words have score 0 and a null mean.  Repeated rows count and are scored as often as they
    occur; null ids are kept; whole texts are read; further columns are not; an empty table gives no rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    name = f"citegraph_batches_{uuid.uuid4().hex[:12]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _batches(docs, id_col, text_col).write.bucketBy(buckets, "task", "seq").option("compression", "zstd").option("path", scratch_path(spark, "batches")).saveAsTable(name)
    kept = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only its entry: the files are read on
    words = kept.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)"))).first()[0] or 0
    shards = max(buckets, -(-words // SHARD_ENTRIES))

    def first(batches: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        row = _one(batches)
        x = _sent(Batch(row, order), row["task"], row["seq"], 1, shards, min_count)
        return _table(_SENT) if x is None else pa.Table.from_batches([x])

    answers = stored(_answers(kept.groupBy("task", "seq").applyInArrow(first, _SENT)), "answers")
    for k in range(2, order + 1):
        more = _with_answers(kept, answers, order, min_count, k - 1, lambda b, task, seq, k=k: _sent(b, task, seq, k, shards, min_count), _SENT)
        answers = answers.union(stored(_answers(more), "answers"))

    def score(batch: Batch, task: int, seq: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(batch.docs, pa.int64()), pa.array(batch.sizes), pa.array(batch.scores(words, backoff))], names=[id_col, "n_words", "score"])

    out = _with_answers(kept, answers, order, min_count, order, score, f"`{id_col}` long, n_words long, score double")
    return out.withColumn("mean_score", F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")))
