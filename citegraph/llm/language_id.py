"""Operator 5: language identification by multinomial naive Bayes.

Features are character 1- to 3-grams of the lower-cased letters (all else is one
blank), hashed into `BUCKETS` counts.  Training counts are summed by Spark per
(language, bucket) and become a matrix of log probabilities, `BUCKETS` x languages,
which is broadcast.  Scoring gathers matrix rows for all n-grams of a batch and sums them per
text in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from citegraph.llm.common import map_batches, short_batches

#: hashed features; with the languages, this bounds what is broadcast
BUCKETS = 1 << 15
#: n-gram lengths
ORDERS = (1, 2, 3)
#: labelled texts of a language that are learned from (about; a hash of the id draws them)
TRAIN_PER_LANG = 5000
#: more languages than this are refused: the model would no longer be small
MAX_LANGS = 512
#: added to every count
ALPHA = 0.5
#: characters scored at once
SLICE = 400_000

_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")
_SALT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def clean(text: str | None) -> str:
    """Blank-padded lower-case words of letters; empty if the text is null or has no letter."""
    if not text:
        return ""
    out = _OTHER.sub(" ", text.lower()).strip()
    return f" {out} " if _LETTER.search(out) else ""


def features(code: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each n-gram of a code point array."""
    m = len(code) - n + 1
    h = np.full(max(m, 0), n, np.uint32)
    for j in range(n):
        h = (h ^ code[j : j + m]) * _SALT[j]
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BUCKETS.bit_length() + 1)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def count_features(text: str) -> np.ndarray:
    c, out = codes(text), np.zeros(BUCKETS, np.int64)
    for n in ORDERS:
        out += np.bincount(features(c, n), minlength=BUCKETS)
    return out


def text_scores(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Log likelihood of each cleaned text under each column of `matrix`."""
    out = np.zeros((len(texts), matrix.shape[1]))
    top = max(ORDERS)
    code, owner, size = [], [], 0

    def add():
        if size:
            c, who = np.concatenate(code), np.repeat([i for i, _ in owner], [n for _, n in owner])
            for n in ORDERS:
                f = features(c, n)
                own = who[: len(f)]
                f, own = f[own == who[n - 1 : n - 1 + len(f)]], own[own == who[n - 1 : n - 1 + len(f)]]
                at = np.nonzero(np.diff(own, prepend=-1))[0]
                if len(f):
                    out[own[at]] += np.add.reduceat(matrix[f], at, axis=0)

    for i, t in enumerate(texts):
        c = codes(t)
        if len(c) > SLICE:  # a very long text: slices that overlap by what the next n-grams need
            for n in ORDERS:
                for at in range(0, len(c) - n + 1, SLICE):
                    out[i] += matrix[features(c[at : at + SLICE + n - 1], n)].sum(axis=0)
            continue
        if size + len(c) > SLICE:
            add()
            code, owner, size = [], [], 0
        if len(c) >= top:
            code.append(c)
            owner.append((i, len(c)))
            size += len(c)
    add()
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_PER_LANG):
    """(languages, matrix of log probabilities with the log prior as last row) from the rows with a non-null
    label.  Of a language with more than `per_lang` rows about that many are drawn by a hash of the id."""
    short_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BUCKETS + 1, 0))
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, per_lang / sizes[lang])])

    def counts(b: pa.RecordBatch) -> pa.RecordBatch:
        total: dict[str, np.ndarray] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            if t := clean(text.as_py()):
                total[lang] = total.get(lang, 0) + count_features(t)
        at = {x: np.nonzero(c)[0] for x, c in total.items()}
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x for x, i in at.items() for _ in i], pa.string()),
                pa.array(np.concatenate([np.empty(0, np.int64), *at.values()])),
                pa.array(np.concatenate([np.empty(0, np.int64), *(total[x][i] for x, i in at.items())])),
            ],
            names=["lang", "bucket", "n"],
        )

    sample = rows.where(draw < share[F.col("lang")]).select("lang", "text")
    summed = map_batches(sample, counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    matrix = np.full((BUCKETS, len(langs)), ALPHA)
    matrix[summed["bucket"].to_numpy(int), summed["lang"].map(langs.index).to_numpy(int)] += summed["n"].to_numpy(float)
    prior = np.array([sizes[x] for x in langs], float)
    return langs, np.vstack((np.log(matrix / matrix.sum(axis=0)), np.log(prior / prior.sum())))


def predict(docs: DataFrame, model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns `keep` of `docs` with lang_pred and score (the predicted language's posterior probability), which
    replace columns of these names (in any case).

    Whole texts are scored, whatever their length.  A null text or one without a letter, or a model without
    languages, gives `und` with score 0; equal scores give the alphabetically first language."""
    short_batches(docs.sparkSession)
    langs, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix)

    def label(b: pa.RecordBatch) -> pa.RecordBatch:
        np.seterr(over="ignore")
        texts = [clean(x.as_py()) for x in b.column(b.num_columns - 1)]
        pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        known = np.array([bool(t) for t in texts])
        if langs and known.any():
            s = text_scores([t for t in texts if t], shared.value[:-1]) + shared.value[-1]
            best = s.argmax(axis=1)
            pred[known] = np.array(langs, object)[best]
            score[known] = 1 / np.exp(s - s[np.arange(len(s)), best][:, None]).sum(axis=1)
        return pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(score)], names=[*b.schema.names[:-1], "lang_pred", "score"])

    cols = docs.select(*[F.col(f"`{c}`") for c in keep if c.lower() not in ("lang_pred", "score")], F.col(text_col).cast("string").alias("_text"))
    return map_batches(cols, label, StructType([*cols.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out(id_col: str = "doc_id"):
    """Rows that training leaves out: crc32 of the id as text, modulo 4, is 2 (a null id is not)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
