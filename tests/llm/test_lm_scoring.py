import math
from collections import Counter

import numpy as np

from citegraph.llm.lm_scoring import backoff_scores, pack_counts, pack_sorted, unpack_counts, unpack_sorted
from citegraph.llm.shingles import words_of


def brute(texts, order=3, backoff=0.4, least=1):
    words = [words_of(t) for t in texts]
    n = Counter(g for w in words for k in range(1, order + 1) for g in zip(*[w[j:] for j in range(k)]))
    total, out = sum(map(len, words)), []
    for w in words:
        s = 0.0
        for i in range(len(w)):
            for k in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - k + 1 : i + 1])
                if k == 1:
                    s += math.log(n[g] / total)
                elif n[g] >= least:
                    s += math.log(n[g] / n[g[:-1]])
                    break
                else:
                    s += math.log(backoff)
        out.append((len(w), s))
    return out


def test_scores_equal_brute_force(frame, texts):
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in backoff_scores(frame(rows, "doc_id long, text string, task string, n_words long").repartition(5)).collect()}
    assert len(got) == len(texts)
    for i, (n, s) in enumerate(brute(texts)):
        assert got[i].n_words == n
        assert abs(got[i].score - s) < 1e-6 * max(1, abs(s))
        assert (got[i].mean_score is None) == (n == 0)


def test_pruned_tables(spark, frame, texts):
    rows = list(enumerate(texts))
    got = {r.doc_id: r.score for r in backoff_scores(frame(rows, "doc_id long, text string").repartition(3), min_count=2).collect()}
    for i, (_, s) in enumerate(brute(texts, least=2)):
        assert abs(got[i] - s) < 1e-6 * max(1, abs(s))
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("citegraph_batches")]


def test_orders_repeats_and_null_ids(frame):
    rows = [(1, "a b a b a b c"), (1, "a b a b a b c"), (None, "a b d"), (2, None)]
    for order in (1, 2, 4):
        got = sorted((r.doc_id or 0, r.n_words, round(r.score, 9)) for r in backoff_scores(frame(rows, "doc_id long, text string"), order=order).collect())
        want = sorted((i or 0, n, round(s, 9)) for (i, _), (n, s) in zip(rows, brute([t for _, t in rows], order)))
        assert got == want


def test_empty_table(frame):
    assert backoff_scores(frame([], "doc_id long, text string")).collect() == []


def test_packed_arrays_round_trip():
    h = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64))
    for x in (h, h[:1], np.unique(h >> np.uint64(20)), np.empty(0, np.uint64)):
        assert (unpack_sorted(pack_sorted(x)) == x).all()
    c = np.array([1, 254, 255, 256, 10**12, 3])
    assert (unpack_counts(pack_counts(c)) == c).all()
