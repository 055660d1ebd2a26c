import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegraph.llm import language_id as L


def brute(train, text):
    """Posterior of naive Bayes over the same hashed features, from plain counters."""
    counts, rows = defaultdict(Counter), Counter(lang for lang, _ in train)
    for lang, t in train:
        if t := L.clean(t):
            for n in L.ORDERS:
                counts[lang].update(L.features(L.codes(t), n).tolist())
    t = L.clean(text)
    if not t:
        return "und", 0.0
    score = {}
    for lang in rows:
        total = sum(counts[lang].values()) + L.ALPHA * L.BUCKETS
        score[lang] = math.log(rows[lang] / len(train)) + sum(math.log((counts[lang][f] + L.ALPHA) / total) for n in L.ORDERS for f in L.features(L.codes(t), n).tolist())
    best = max(sorted(score), key=score.get)
    return best, 1 / sum(math.exp(s - score[best]) for s in score.values())


def test_predictions_equal_brute_force(frame, monkeypatch):
    np.seterr(over="ignore")
    train = [("en", "The house is red"), ("fr", "La maison est rouge"), ("de", "Das Haus ist rot"), ("fr", None), (None, "xx"), ("en", "The 12 !!")]
    docs = frame([(i, lang, t) for i, (lang, t) in enumerate(train)], "doc_id long, lang string, text string")
    model = L.train(docs)
    texts = ["the red house", "rouge", "haus haus", "", None, "123 !?", "é", "a", "ab", "THE HOUSE. " * 50]
    for size in (L.SLICE, 7):  # also with texts in slices
        monkeypatch.setattr(L, "SLICE", size)
        asked = frame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        got = {r.doc_id: r for r in L.predict(asked, model, ["doc_id"]).collect()}
        for i, t in enumerate(texts):
            lang, p = brute([(a, b) for a, b in train if a], t)
            assert got[i].lang_pred == lang and got[i].score == pytest.approx(p, rel=1e-6), t


def test_long_texts_score_alike_in_slices(monkeypatch):
    np.seterr(over="ignore")
    matrix = np.random.default_rng(1).normal(size=(L.BUCKETS, 3))
    texts = [L.clean("abc def ghi " * n) for n in (1, 50, 3, 200)]
    whole = L.text_scores(texts, matrix)
    monkeypatch.setattr(L, "SLICE", 100)
    assert np.allclose(whole, L.text_scores(texts, matrix))


def test_held_out_accuracy_and_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", L.held_out())
    got = L.predict(docs, L.train(docs.where("not held_out")), ["doc_id", "held_out"]).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_without_labels_clashing_columns_and_empty_tables(frame):
    docs = frame([(None, "abc", None, 1)], "doc_id long, text string, lang string, score int")
    model = L.train(docs)
    out = L.predict(docs.withColumn("held_out", L.held_out()), model, ["doc_id", "score", "held_out"]).collect()
    assert [(r.doc_id, r.held_out, r.lang_pred, r.score) for r in out] == [(None, False, "und", 0.0)]
    assert L.predict(docs.limit(0), model, ["doc_id"]).collect() == []


def test_sample_of_a_language_is_bounded(frame):
    docs = frame([(i, "a b c", "en") for i in range(400)] + [(1000, "d", "de")], "doc_id long, text string, lang string")
    langs, matrix = L.train(docs, per_lang=40)
    assert langs == ["de", "en"] and matrix.shape == (L.BUCKETS + 1, 2)
    assert matrix[-1].tolist() == pytest.approx([math.log(1 / 401), math.log(400 / 401)])
