import numpy as np
import pytest

from citegraph.llm import ngram_join as J
from citegraph.llm.shingles import words_of


def word_sets(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k=3, pct=90):
    s = [word_sets(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            n = len(s[i] & s[j])
            if rows[i][0] == rows[j][0] and s[i] and s[j] or n and 100 * n >= pct * (len(s[i]) + len(s[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(x), None if d is None else least[find(i)]) for i, ((d, _), x) in enumerate(zip(rows, s))), key=str)


def run(frame, rows, **kw):
    df = frame([(d, t, "c") for d, t in rows], "doc_id long, text string, node string").repartition(4)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.ngram_jaccard_components(df, **kw).collect()), key=str)


@pytest.fixture(scope="module")
def near():
    """Chains and groups around the threshold, and a passage that many texts share."""
    import random

    r = random.Random(2)
    rows, at = [], 0
    passage = " ".join(f"p{i}" for i in range(60))
    for g in range(12):
        n = r.choice([8, 9, 10, 11, 12, 13, 30, 31, 70, 200, 500])
        w = [f"{r.choice('abcdefgh')}{r.randint(0, 30)}" for _ in range(n + 2)]
        for _ in range(r.randint(2, 14)):
            w = list(w)
            for _ in range(r.randint(0, max(1, n // 60))):
                w[r.randrange(len(w))] = f"z{r.randint(0, 99)}"
            if r.random() < 0.3:
                w = w[:-1] if len(w) > 5 else w + ["end"]
            rows.append((at, " ".join(w)))
            at += 1
        for _ in range(4):
            rows.append((at, passage + " " + " ".join(f"q{r.randint(0, 10**6)}" for _ in range(r.choice([2, 5, 9, 40])))))
            at += 1
    return rows


@pytest.mark.parametrize("group, small", [(4096, 40), (5, 2)])
def test_equals_brute_force(frame, near, texts, monkeypatch, group, small):
    monkeypatch.setattr(J, "GROUP", group)
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "BLOCK", 3)
    rows = near + [(10_000 + i, t) for i, t in enumerate(texts)]
    want = brute(rows)
    assert run(frame, rows) == want
    assert sum(c != d for d, _, c in want) > 30


@pytest.mark.parametrize("k, pct", [(5, 80), (1, 50), (3, 100)])
def test_other_thresholds(frame, near, k, pct):
    assert run(frame, near[:90], k=k, pct=pct) == brute(near[:90], k, pct)


def test_repeated_ids_nulls_and_empty_table(frame):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, a), (5, b), (3, b), (9, a + " x"), (None, a), (7, None), (7, ""), (8, "  ")]
    assert run(frame, rows) == brute(rows)
    assert run(frame, []) == []


def test_null_id_before_equal_text_loses_no_link(frame):
    a = " ".join(f"a{i}" for i in range(30))
    rows = [(None, a), (1, a), (2, a + " x"), (None, a + " x")]
    df = frame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.ngram_jaccard_components(df).collect()), key=str)
    assert got == brute(rows) and (2, 29, 1) in got
    assert sorted(str(r.doc_id) for r in J.keep_one_per_component(df).collect()) == ["1", "None", "None"]


def test_one_row_of_a_group_stays(frame):
    rows = [(1, "a b c d"), (2, "A b  c d"), (3, "other words here"), (3, "other words here"), (None, "a b c d"), (4, None), (5, None)]
    out = J.keep_one_per_component(frame([(d, t, 1) for d, t in rows], "doc_id long, text string, count int")).collect()
    assert sorted((str(r.doc_id), r.text) for r in out if r.text) == [("1", "a b c d"), ("3", "other words here"), ("None", "a b c d")]
    assert sorted(r.doc_id for r in out if r.text is None) == [4, 5] and out[0].asDict().keys() == {"doc_id", "text", "count"}


def test_every_linked_pair_shares_a_key():
    """The pigeonhole argument, tried at its edge."""
    np.seterr(over="ignore")
    r = np.random.default_rng(1)
    for n in (9, 10, 11, 12, 19, 20, 37, 100, 333):
        for _ in range(30):
            a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            d = J.max_difference(len(a), len(a), 90) // 2
            b = np.unique(np.concatenate((a[d:], r.integers(0, 1 << 63, d, dtype=np.uint64))))
            b = r.permutation(b)
            b.sort()
            keys = [{int(k) for c, f, _ in J.size_classes(len(s), 90) for k in J.segment_keys(s, c, f)} for s in (a, b)]
            n_ab = len(np.intersect1d(a, b))
            if 100 * n_ab >= 90 * (len(a) + len(b) - n_ab):
                assert keys[0] & keys[1]


def test_sets_of_many_texts_are_those_of_each_text(near):
    """Sets, names, keys and parities made for many texts at once are those that each text has by itself."""
    from citegraph.llm.shingles import ngram_hashes, hash_words, mix, shingle_sets

    texts = [t for _, t in near][:60] + ["", None, "  ", "one", "one two", "a b c d e", "a a a a a a a"]
    flat, starts = shingle_sets(texts, 5)
    sets = [flat[a:b] for a, b in zip(starts[:-1], starts[1:])]
    for text, s in zip(texts, sets):
        h = hash_words(words_of(text))
        assert s.tolist() == np.unique(ngram_hashes(h, min(5, len(h)))).tolist() if len(h) else not len(s)
    assert J.set_classes(flat, starts) == [J.set_class(s) for s in sets]
    some = [s for s in sets if len(s)]
    keys, ends, parities = J.keys_and_parities(some, 80)
    for i, s in enumerate(some):
        classes = J.size_classes(len(s), 80)
        assert keys[ends[i] : ends[i + 1]].tolist() == [k for c, f, _ in classes for k in J.segment_keys(s, c, f).tolist()]
        cells = max(x for _, _, x in classes)
        odd = np.bincount((mix(s ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(cells - 1)).astype(int), minlength=cells) & 1
        assert parities[i] == np.packbits(odd.astype(np.uint8)).tobytes()
