import random

import numpy as np
import pytest

from citegraph.llm import decontaminate as D


def sets(text, k=5):
    w = D.plain_words(text)
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def holds(words, item):
    return any(words[i : i + len(item)] == item for i in range(len(words) - len(item) + 1))


def brute(docs, items, k=5, pct=80):
    out = {}
    for d, t in docs:
        s = sets(t, k)
        for i, x in items:
            q = sets(x, k)
            w = D.plain_words(x)
            n = len(q & s) if len(w) >= k else int(bool(w) and holds(D.plain_words(t), w))
            if q and 100 * n >= pct * len(q) and out.get((d, i), (0,))[0] <= n / len(q):
                out[d, i] = max(out.get((d, i), (0, 0, 0)), (n / len(q), n, len(q)))
    return out


@pytest.fixture()
def data(texts):
    r = random.Random(11)
    vocab = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 5, 6, 20, 60, 300])))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "... !!"), (103, items[4][1]), (4, items[9][1])]
    docs = [(i, t) for i, t in enumerate(texts)]
    for n, (i, t) in enumerate(items[:40]):
        w = t.split()
        for j in range(len(w)):
            if r.random() < 0.01 * (n % 4):
                w[j] = "other"
        body = " ".join(r.choice(vocab) for _ in range(200))
        docs.append((1000 + n, body + " " + "** ".join(w).upper() + "!! " + body))
        half = len(w) // 2
        docs.append((2000 + n, " ".join(w[:half]) + " " + body + " " + " ".join(w[half:])))
        docs.append((3000 + n, t))
    docs += [(None, items[5][1]), (3003, items[3][1]), (9000, " ".join(t for _, t in docs if t))]
    return docs, items


@pytest.mark.parametrize("block", [2_000_000, 200])
def test_equals_brute_force(frame, data, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_SHINGLES", block)
    docs, items = data
    df = frame([(d, t, 5) for d, t in docs], "doc_id long, text string, sh int").repartition(5)
    got = {(r.doc_id, r.item_id): (r.containment, r.n_shared, r.n_item) for r in D.contained_items(df, frame(items, "item_id long, text string")).collect()}
    assert got == brute(docs, items)
    assert len(got) > 80


def test_short_items_are_found_at_any_place(frame):
    docs = [(1, "She said: the ANSWER is forty-two, and left the room."), (2, "the answer is forty"), (3, "answer is forty two"), (4, "forty two is the answer is"), (5, None), (6, ""), (7, "two")]
    items = [(1, "answer is forty two"), (2, "two"), (3, "Two!"), (4, "is the answer is left the room and more")]
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item, r.containment) for r in D.contained_items(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")).collect()}
    assert got == {(d, i, 1, 1, 1.0) for d, i in [(1, 1), (3, 1), *((d, i) for d in (1, 3, 4, 7) for i in (2, 3))]}


def test_empty_tables(frame):
    docs, items = frame([(1, "a b c d e f")], "doc_id long, text string"), frame([(1, "a b c d e f")], "item_id long, text string")
    assert len(D.contained_items(docs, items).collect()) == 1
    assert D.contained_items(docs.limit(0), items).collect() == []
    assert D.contained_items(docs, items.limit(0)).collect() == []


def test_sketch_cannot_miss():
    np.seterr(over="ignore")
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 8, 9, 31, 100):
        s = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        index = D.ItemIndex([s], 80)
        least = (80 * n + 99) // 100
        assert index.contained(s[n - least :]) == [(0, least)]  # the largest hashes: the worst case
        assert index.contained(s[n - least + 1 :]) == []
