import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from citegraph.llm import mixing as M


def words(t):
    return len((t or "").encode().split())


def brute_budgets(tokens, target, most, budget):
    """{source: (weight, epochs)} by plain bisection."""
    t = {s: n for s, n in tokens.items() if n}
    whole = sum(t.values())
    p = {s: n / whole for s, n in t.items()}

    def weights(a):
        w = {s: x**a for s, x in p.items()}
        return {s: x / sum(w.values()) for s, x in w.items()}

    def epochs(a):
        w = weights(a)
        scale = 1 / min(w[s] / p[s] for s in p) if budget is None else budget / whole
        return {s: w[s] / p[s] * scale for s in p}

    def entropy(a):
        return -sum(x * math.log(x) for x in weights(a).values())

    def bisect(good):  # the largest exponent below which `good` holds
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if good(mid) else (lo, mid)
        return lo

    a = 1.0
    if len(p) > 1:
        a = max(bisect(lambda x: entropy(x) >= target * math.log(len(p))), bisect(lambda x: max(epochs(x).values()) > most * (1 if budget is not None else min(epochs(x).values()))))
    out = {s: (w, epochs(a)[s]) for s, w in weights(a).items()}
    return out | {s: (0.0, 1.0) for s, n in tokens.items() if not n}


def brute_mix(rows, target, most, budget, seed=M.SEED):
    """Counter of (doc_id, source, epoch)."""
    def md5(*parts):
        return hashlib.md5("|".join(parts).encode()).hexdigest()

    tokens = Counter()
    for _, s, t in rows:
        tokens[s] += words(t)
    out = Counter()
    for s, (_, e) in brute_budgets(tokens, target, most, budget).items():
        name, own = "" if s is None else "=" + s, [(i, t) for i, x, t in rows if x == s]
        full = math.floor(e + 1e-9)
        left = max(0, math.floor((e - full) * tokens[s] + 1e-6))
        blocks = defaultdict(list)
        for i, t in own:
            name_of = f"text|{hashlib.md5((t or '').encode()).hexdigest()}" if i is None else str(i)
            blocks[md5(seed, name_of)[:3]].append((i, words(t), name_of, hashlib.md5((t or "").encode()).hexdigest()))
            for k in range(full):
                out[i, s, k + 1] += 1
        if not left:
            continue
        for b in sorted(blocks, key=lambda b: md5(seed, name, str(full + 1), b)):
            size = sum(n for _, n, _, _ in blocks[b])
            if size > left:
                for i, n, _, _ in sorted(blocks[b], key=lambda x: (md5(seed, str(full + 1), x[2]), x[1], x[3])):
                    left -= n
                    if left >= 0:
                        out[i, s, full + 1] += 1
                break
            left -= size
            for i, _, _, _ in blocks[b]:
                out[i, s, full + 1] += 1
    return out


ROWS = [(i, "big" if i % 3 else ("mid" if i % 2 else "small"), "w " * (i % 17)) for i in range(300)] + [(i, "tiny", "a b c") for i in range(300, 310)]
ROWS += [(400, None, "x y"), (401, None, None), (402, "empty", ""), (403, "empty", None), (None, "big", "q r s")]
SCHEMA = "doc_id long, source string, text string"


@pytest.mark.parametrize("target, most, budget", [(0.97, 2.0, None), (0.99, 50.0, None), (0.5, 1.5, None), (0.9, 4.0, 1500.0), (0.97, 3.0, 300.0)])
def test_mix_equals_brute_force(frame, target, most, budget):
    df = frame(ROWS, SCHEMA).repartition(4)
    got = Counter((r.doc_id, r.source, r._epoch) for r in M.mix_sources(df, target_entropy=target, max_repeats=most, budget=budget).collect())
    assert got == brute_mix(ROWS, target, most, budget)


def test_default_budget_loses_nothing_and_keeps_the_limits(frame):
    df = frame(ROWS, SCHEMA)
    out = M.mix_sources(df).collect()
    assert {r.doc_id for r in out if r._epoch == 1} == {r[0] for r in ROWS}
    assert max(r._epoch for r in out) <= 2
    budgets = M.source_budgets(df.select("source", M.n_words(F.col("text")).alias("n_tokens")))
    want = brute_budgets({s: sum(words(t) for _, x, t in ROWS if x == s) for s in {r[1] for r in ROWS}}, M.TARGET_ENTROPY, M.MAX_REPEATS, None)
    for r in budgets.collect():
        assert (r.weight, r.epochs) == pytest.approx(want[r.source], abs=1e-8)


def test_clashing_columns_repeats_and_empty_table(frame):
    rows = [(1, "s", "a b", 9, "k", 7), (1, "s", "a b", 9, "k", 7), (2, "t", "c", 8, "l", 6)]
    df = frame(rows, "doc_id long, source string, text string, _epoch int, draw string, full int")
    out = M.mix_sources(df).collect()
    assert Counter(r.doc_id for r in out)[1] == 2 and all(r.draw in "kl" and r.full in (6, 7) and r._epoch >= 1 for r in out)
    assert M.mix_sources(df.limit(0)).collect() == []
    only_empty = M.mix_sources(frame([(1, "s", None), (2, None, " ")], SCHEMA)).collect()
    assert sorted((r.doc_id, r._epoch) for r in only_empty) == [(1, 1), (2, 1)]


def test_words(frame):
    texts = [None, "", " \t\n", "a", " a  b\n", "\x0bc\x0c\r d ", "é f g"]
    got = frame([(t,) for t in texts], "t string").select(M.n_words(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [words(t) for t in texts]
