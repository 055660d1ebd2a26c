"""Operator 2: quality by the perplexity of a modified Kneser-Ney character model.

The model is an interpolated modified Kneser-Ney model of character n-grams, trained on trusted texts.  Its tables are built
by Spark: n-gram counts are summed by n-gram, each lower order counts the distinct left neighbours of
its n-grams, and probabilities come from joins of a count table with its contexts' totals and with the next lower
order, all partitioned by n-gram.  Training reads all trusted texts.  The tables hold each different n-gram once, so they grow with
the kinds of n-grams, not with the texts; they are sent to all workers as hash shards, and every whole text is scored in one pass: a
position's longest known n-gram, times the weights of the contexts that did not know theirs.

A document is kept if its rating is at most the `QUANTILE` of the trusted documents' ratings in its language.  The rating
is the mean negative log probability of the text's characters and of `PRIOR` more that have the trusted documents' mean: a few
characters alone do not condemn a short text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import map_batches, short_batches, stored
from citegraph.llm.shingles import mix

ORDER = 5
#: share of a language's trusted documents that its threshold keeps
QUANTILE = 0.995
#: characters of trusted text by which a rating is steadied
PRIOR = 50
#: trusted ids that are broadcast at most (some 40 bytes each), so that texts are not shuffled to find theirs
BROADCAST_IDS = 5_000_000
#: hash shards of a model table; positions scored at once
SHARDS, SLICE = 64, 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str | None) -> str:
    """The text with each run of white space as one blank, without any at its ends."""
    return " ".join(text.split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_hashes(c: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams that end at the positions `ends`."""
    h = np.full(len(ends), k, np.uint64)
    for j in range(k - 1, -1, -1):
        h = h * _STEP + c[ends - j]
    return mix(h)


class Shards:
    """An immutable map from hashes to numbers, cut into `SHARDS` sorted arrays by the hash's first bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self.bits = max(SHARDS.bit_length() - 1, int(len(keys)).bit_length())
        self.first = np.searchsorted(self.keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Values of the hashes, NaN where there is none: each is sought among the few keys with its first bits."""
        out = np.full(len(h), np.nan, np.float32)
        part = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end, who = self.first[part], self.first[part + 1], np.arange(len(h))
        while True:
            open_ = at < end
            at, end, who = at[open_], end[open_], who[open_]
            if not len(at):
                return out
            hit = self.keys[at] == h[who]
            out[who[hit]] = self.values[at[hit]]
            at, end, who = at[~hit] + 1, end[~hit], who[~hit]


class Model:
    """Log probabilities of known n-grams, log weights of contexts, and the log probability of an unknown character."""

    def __init__(self, grams: dict[int, Shards], weights: dict[int, Shards], unknown: float, order: int):
        self.grams, self.weights, self.unknown, self.order = grams, weights, unknown, order

    def log_probs(self, c: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each position of `c`, whose context is limited to the `place` characters before it."""
        out = np.zeros(len(c))
        for s in range(0, len(c), SLICE):
            left = np.arange(s, min(s + SLICE, len(c)))
            for k in range(self.order, 0, -1):
                now = left[place[left] >= k - 1]
                rest = left[place[left] < k - 1]
                p = self.grams[k].find(gram_hashes(c, now, k))
                known = ~np.isnan(p)
                out[now[known]] += p[known]
                miss = now[~known]
                if k == 1:
                    out[miss] += self.unknown
                elif len(miss):
                    w = self.weights[k - 1].find(gram_hashes(c, miss - 1, k - 1))
                    out[miss] += np.nan_to_num(w, nan=0.0)
                left = np.concatenate((rest, miss))
        return out


# ------------------------------------------------------------------ training
def _gram_counts(texts: DataFrame, k: int) -> DataFrame:
    """(gram, n): k-grams of texts, counted per batch and then summed."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch | None:
        np.seterr(over="ignore")
        parts = [t for x in b.column(0) if len(t := plain(x.as_py())) >= k]
        if not parts:
            return None
        whole = "".join(parts)
        c, size = codes(whole), np.array([len(p) for p in parts])
        ends = np.arange(len(c))[np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size) >= k - 1]
        _, first, n = np.unique(gram_hashes(c, ends, k), return_index=True, return_counts=True)
        at = ends[first] - k + 1
        return pa.RecordBatch.from_arrays([pa.array([whole[i : i + k] for i in at.tolist()], pa.string()), pa.array(n, pa.int64())], names=["gram", "n"])

    return map_batches(texts, count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """Discounts of n-grams counted once, twice and more often."""
    n = counts.agg(*[F.coalesce(F.count_if(F.col("n") == i), F.lit(0)).alias(f"n{i}") for i in range(1, 5)]).first()
    if not n.n1 or not n.n2:
        return [0.5, 0.75, 0.9]
    y = n.n1 / (n.n1 + 2 * n.n2)
    raw = [1 - 2 * y * n.n2 / n.n1, 2 - 3 * y * n.n3 / n.n2, 3 - 4 * y * n.n4 / n.n3 if n.n3 else 2.0]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def train(texts: DataFrame, order: int = ORDER) -> Model | None:
    """A model of a one-column table of texts (nulls and empty texts are left out); None if there is no character."""
    tables, counts = {}, stored(_gram_counts(texts, order), "grams")
    for k in range(order, 0, -1):
        tables[k] = counts
        if k > 1:
            counts = stored(counts.groupBy(F.substring("gram", 2, k - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
    grams, weights, lower, unknown = {}, {}, None, 0.0
    for k in range(1, order + 1):
        d1, d2, d3 = _discounts(tables[k])
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = tables[k].select("gram", "n", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("suffix"), discount.alias("d"))
        totals = rows.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("weight"))
        if k == 1:
            alone = totals.join(tables[1].agg(F.count(F.lit(1)).alias("kinds")), F.lit(True)).first()
            if alone is None:
                return None
            base = alone.weight / (alone.kinds + 1)
            unknown = float(np.log(base))
            probs = rows.select("gram", ((F.col("n") - F.col("d")) / F.lit(float(alone.total)) + F.lit(base)).alias("p"))
        else:
            probs = rows.join(totals, "context").join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("q")), "suffix")
            probs = probs.select("gram", ((F.col("n") - F.col("d")) / F.col("total") + F.col("weight") * F.col("q")).alias("p"))
            weights[k - 1] = _shards(totals.select(F.col("context").alias("gram"), F.log("weight").alias("v")), k - 1)
        lower = stored(probs, "probabilities")
        grams[k] = _shards(lower.select("gram", F.log("p").alias("v")), k)
    return Model(grams, weights, unknown, order)


def _shards(table: DataFrame, k: int) -> Shards:
    """A model table, one row for each different n-gram, on the driver."""
    t = table.toArrow()
    c = codes("".join(t.column("gram").to_pylist()))
    return Shards(gram_hashes(c, np.arange(k - 1, len(c), k), k), t.column("v").to_numpy())


# ------------------------------------------------------------------ scoring
def perplexities(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns `keep` with log_perplexity, the mean negative log probability of a whole text's n_scored characters; null and 0 for a
    null text or one of white space only, or without a model."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        np.seterr(over="ignore")
        out: list[float | None] = [None] * b.num_rows
        sizes = [0] * b.num_rows
        held, size = [], 0

        def run():
            parts = [t for _, t in held]
            n = np.array([len(t) for t in parts])
            starts = np.cumsum(n) - n
            c = codes("".join(parts))
            logs = shared.value.log_probs(c, np.arange(len(c)) - np.repeat(starts, n))
            for (i, _), s in zip(held, -np.add.reduceat(logs, starts) / n):
                out[i] = float(s)

        for i, x in enumerate(b.column(b.num_columns - 1)):
            if shared.value is not None and (t := plain(x.as_py())):
                held.append((i, t))
                sizes[i] = len(t)
                size += len(t)
                if size > SLICE:
                    run()
                    held, size = [], 0
        if held:
            run()
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.float64()), pa.array(sizes, pa.int64())], names=[*b.schema.names[:-1], "log_perplexity", "n_scored"])

    cols = docs.select(*[F.col(f"`{c}`") for c in keep if c not in ("log_perplexity", "n_scored")], F.col(text_col).cast("string").alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:-1]]
    return map_batches(cols, score, ", ".join([*kinds, "log_perplexity double", "n_scored long"]))


def quality_by_perplexity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    order: int = ORDER, train_chars: int | None = None, quantile: float = QUANTILE,
) -> DataFrame:
    """One row per row of `docs`: `id_col`, `lang_col`, perplexity (of a character), rating, threshold of its language (both
    as perplexities), keep.

    Trusted are documents that `labels` (`id_col`, quality, toxic) calls good and never toxic; repeated labels count
    once, and a document with both good and bad ones is not trusted.  A null language is a language of its own;
    one without trusted documents takes the threshold of all trusted documents.  Texts that are null, empty or white space have no perplexity and
    are not kept.  Without trusted documents nothing is scored and every document with a text is kept.  Repeated rows are
    scored alike, null ids are never trusted; all trusted texts are learned (with `train_chars`, about so many characters of them); whole texts are scored; further columns are not read; an empty table gives no rows.
    """
    trusted = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    trusted = trusted.agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0").select("id")
    trusted = stored(trusted, "trusted")
    if trusted.count() <= BROADCAST_IDS:
        trusted = F.broadcast(trusted)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    learned = rows.join(trusted, "id", "left_semi")
    if train_chars is not None:
        size = learned.agg(F.sum(F.length("text")).alias("n")).first().n or 0
        learned = learned.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit(int(min(1.0, train_chars / max(size, 1)) * (1 << 40))))
    model = train(learned.select("text"), order)
    has_text = F.length(F.btrim("text")) > 0
    scored = stored(perplexities(rows.withColumn("has_text", F.coalesce(has_text, F.lit(False))), model, ["id", "lang", "has_text"]), "perplexities")
    good = stored(scored.join(trusted, "id", "left_semi").where("log_perplexity is not null").select("lang", "log_perplexity", "n_scored"), "trusted")
    means = good.groupBy("lang").agg(F.avg("log_perplexity").alias("mean"))
    overall = good.agg(F.avg("log_perplexity").alias("mean")).first().mean

    def rated(table: DataFrame) -> DataFrame:
        by_lang = table.join(means.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
        prior = PRIOR * F.coalesce("mean", F.lit(overall).cast("double"))
        # rounded to a thousandth, so that an exact quantile needs a short list of values
        return by_lang.withColumn("rating", F.round((F.col("log_perplexity") * F.col("n_scored") + prior) / (F.col("n_scored") + PRIOR), 3))

    ratings = stored(rated(good).select("lang", "rating"), "ratings")
    limits = ratings.groupBy("lang").agg(F.percentile("rating", F.lit(quantile)).alias("v")).select(F.col("lang").alias("at"), "v")
    most = ratings.agg(F.percentile("rating", F.lit(quantile)).alias("v")).first().v
    out = rated(scored).join(limits, F.col("lang").eqNullSafe(F.col("at")), "left")
    limit = F.coalesce("v", F.lit(most).cast("double"))
    return out.select(
        F.col("id").alias(id_col), F.col("lang").alias(lang_col), F.exp("log_perplexity").alias("perplexity"), F.exp("rating").alias("rating"), F.exp(limit).alias("threshold"),
        (F.coalesce(F.col("rating") <= limit, F.lit(False)) if model else F.col("has_text")).alias("keep"),
    )
