import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from citegraph.llm.quality import Shards, plain, quality_by_perplexity, train


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney probabilities from plain dictionaries."""
    counts = {order: Counter(t[i : i + order] for t in map(plain, texts) for i in range(len(t) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discount(k):
        n = Counter(counts[k].values())
        if not n[1] or not n[2]:
            d = [0.5, 0.75, 0.9]
        else:
            y = n[1] / (n[1] + 2 * n[2])
            d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 2.0]
            d = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]
        return lambda c: d[min(c, 3) - 1]

    total, weight, ds = {}, {}, {k: discount(k) for k in counts}
    for k, c in counts.items():
        t, w = defaultdict(float), defaultdict(float)
        for g, n in c.items():
            t[g[:-1]] += n
            w[g[:-1]] += ds[k](n)
        total[k], weight[k] = t, {x: w[x] / t[x] for x in t}

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        own = counts[k].get(g, 0)
        if g[:-1] not in total[k]:
            return p(g[1:])
        return (max(own - ds[k](own), 0) / total[k][g[:-1]] if own else 0) + weight[k][g[:-1]] * p(g[1:])

    return p


def perplexity(p, text, order):
    t = plain(text)
    return math.exp(-sum(math.log(p(t[max(0, i - order + 1) : i + 1])) for i in range(len(t))) / len(t)) if t else None


@pytest.mark.parametrize("order", [1, 3, 5])
def test_perplexity_equals_brute_force(frame, texts, order):
    docs = frame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    good = [i for i, t in enumerate(texts) if i % 2]
    labels = frame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_by_perplexity(docs, labels, order=order).collect()}
    p = brute_model([texts[i] for i in good if texts[i]], order)
    for i, t in enumerate(texts):
        want = perplexity(p, t, order)
        if want is None:
            assert got[i].perplexity is None and not got[i].keep
        else:
            assert got[i].perplexity == pytest.approx(want, rel=1e-4)


def test_junk_goes_and_clean_text_stays(frame):
    r = random.Random(3)
    clean = [" ".join(r.choice(["the", "house", "is", "red", "and", "old", "in", "town"]) for _ in range(40)) for _ in range(80)]
    junk = ["".join(r.choice("xqzjkvw#$%&*0123") for _ in range(150)) for _ in range(20)]
    docs = frame([(i, t, "en" if i % 2 else None) for i, t in enumerate(clean + junk)], "doc_id long, text string, lang string")
    labels = frame([(i, 1, 0) for i in range(0, 60)] + [(3, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.keep for x in quality_by_perplexity(docs, labels, quantile=1.0).collect()}
    assert all(got[i] for i in range(80) if i not in (3, 5)) and not any(got[i] for i in range(80, 100))


def test_without_trusted_rows_and_empty_tables(frame):
    docs = frame([(1, "a b", "x", 1.0), (None, "c", None, 2.0), (2, None, "x", 3.0), (3, " ", "x", 4.0)], "doc_id long, text string, lang string, mean double")
    labels = frame([(None, 1, 0)], "doc_id long, quality int, toxic int")
    got = [(r.doc_id, r.perplexity, r.keep) for r in quality_by_perplexity(docs, labels).collect()]
    assert sorted(got, key=str) == sorted([(1, None, True), (None, None, True), (2, None, False), (3, None, False)], key=str)
    assert quality_by_perplexity(docs.limit(0), labels.limit(0)).collect() == []


def test_shards_find():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    s = Shards(keys, np.arange(len(keys)))
    assert (s.find(keys) == np.arange(len(keys))).all() and np.isnan(s.find(keys + np.uint64(1))).all()
    assert np.isnan(Shards(np.empty(0, np.uint64), np.empty(0)).find(keys)).all()


def test_probabilities_sum_to_one(frame):
    m = train(frame([("abcab cab",), ("abba",), (None,)], "text string"), 3)
    chars = "abc "
    for context in ("", "a", "ab", "zz", "ca"):
        c = [ord(x) for x in context]
        total = 0.0
        for x in chars:
            arr = np.array([*c, ord(x)], np.uint64)
            total += math.exp(m.log_probs(arr, np.arange(len(arr)))[-1])
        unknown = np.array([*c, 0x1F600], np.uint64)
        total += math.exp(m.log_probs(unknown, np.arange(len(unknown)))[-1])
        assert total == pytest.approx(1, abs=1e-5)


def test_all_trusted_texts_are_learned(frame):
    """Also with many more characters than the twelve million that a sample once held: no row is drawn by its id."""
    import inspect

    assert inspect.signature(quality_by_perplexity).parameters["train_chars"].default is None
    docs = frame([(i, f"{'ab' * 20} {chr(0x4E00 + i)}{chr(0x5E00 + i)}", "en") for i in range(60)], "doc_id long, text string, lang string")
    labels = frame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    whole = {r.doc_id: r.perplexity for r in quality_by_perplexity(docs, labels).collect()}
    part = {r.doc_id: r.perplexity for r in quality_by_perplexity(docs, labels, train_chars=600).collect()}
    assert max(whole.values()) < max(part.values())


def test_texts_are_not_shuffled_to_find_the_trusted_ones(spark, monkeypatch):
    """The ids of trusted documents go to the texts, whatever size Spark broadcasts by itself."""
    from citegraph.llm import quality as Q

    plans = []

    def trained(texts, order):
        plans.append(texts._jdf.queryExecution().executedPlan().toString())
        return train(texts, order)

    monkeypatch.setattr(Q, "train", trained)
    docs = spark.createDataFrame([(i, "en", f"some words {i}") for i in range(20)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert quality_by_perplexity(docs, labels, order=2).count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
