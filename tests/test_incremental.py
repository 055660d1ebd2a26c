"""Incremental inversion: deltas against a recomputation, untouched buckets, lost runs, repeats."""

import random

import pytest
from pyspark.sql import functions as F

from citegraph.operators.incremental import Inversion

DOCS, EDGES = "id long, doc_id long, title string, size long", "citing_id long, pos int, cited_id long, cited_title string, authors array<array<string>>"


def brute(epochs):
    """(inverted rows, citations by key) of the epochs' contents."""
    docs, cites = {}, {}
    for d, e in epochs.values():
        for row in d:
            docs.setdefault(row[0], []).append(row)
        for citing, pos, cited, title, _ in e:
            cites.setdefault(cited, []).append((citing, pos, title))
    inv = []
    for key, rows in docs.items():
        best = max(rows, key=lambda r: (r[3], r[1], r[2]))
        inv.append((key, best[1], best[2], len(rows), len(cites.get(key, []))))
    return sorted(inv), {k: sorted(v) for k, v in cites.items()}


def stored(inv):
    lists = {}
    for r in inv.table("incoming").collect():
        assert len(r.incoming) <= 2 * inv.chunk_size + 5
        lists.setdefault(r.id, []).extend((c.citing_id, c.pos, c.title) for c in r.incoming)
    counts = {r.id: r.citations for r in inv.table("counts").collect()}
    assert counts == {k: len(v) for k, v in lists.items()}
    return sorted(tuple(r) for r in inv.inverted().collect()), {k: sorted(v) for k, v in lists.items()}


def made(seed, n=30):
    r = random.Random(seed)
    docs = [(r.randint(1, 12), seed * 100 + i, f"t{i}", r.randint(1, 5)) for i in range(n)]
    edges = [(seed * 100 + i, p, r.randint(1, 15), f"c{p}", [["A", "B."]]) for i in range(n) for p in range(r.randint(0, 3))]
    return docs, edges + edges[:2]  # two citations twice


def deliver(spark, inv, epoch, rows):
    return inv.deliver(epoch, spark.createDataFrame(rows[0], DOCS), spark.createDataFrame(rows[1], EDGES))


@pytest.fixture(scope="module")
def state(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("inversion"))
    inv, epochs = Inversion(spark, root, buckets=4, chunk_size=3), {}
    for name in ("a", "b"):
        epochs[name] = made(len(epochs) + 1)
        deliver(spark, inv, name, epochs[name])
    return root, inv, epochs


def test_deliveries_equal_a_recomputation(spark, state):
    root, inv, epochs = state
    assert stored(inv) == brute(epochs)
    docs, edges = epochs["a"]
    epochs["a"] = ([(k, d, t, s + d % 3) for k, d, t, s in docs if d % 4], [e for e in edges if e[0] % 4] + [(101, 9, 3, "new", None)])
    deliver(spark, inv, "a", epochs["a"])
    assert stored(inv) == brute(epochs)
    assert stored(Inversion(spark, root)) == brute(epochs)  # as a later session finds it


def test_untouched_buckets_keep_their_files(spark, state):
    root, inv, epochs = state
    before = {t: dict(parts) for t, parts in inv.state["tables"].items()}
    docs, edges = epochs["b"]
    epochs["b"] = (docs, [*edges, (999, 0, 5, "one more", None)])
    touched = deliver(spark, inv, "b", epochs["b"])
    assert len(touched["counts"]) == len(touched["incoming"]) == 1 and touched["merged"] == []
    (bucket,) = touched["counts"]
    for t, parts in inv.state["tables"].items():
        changed = {b for b in parts if parts[b] != before[t].get(b)}
        assert changed == (set() if t == "merged" else {str(bucket)})
    assert stored(inv) == brute(epochs)
    # the same delivery once more changes nothing at all
    tables = dict(inv.state["tables"])
    assert deliver(spark, inv, "b", epochs["b"]) == {"counts": [], "incoming": [], "merged": []}
    assert inv.state["tables"] == tables


def test_a_lost_run_leaves_the_state(spark, state, monkeypatch):
    root, inv, epochs = state

    def lost(self, state):
        raise RuntimeError("driver lost")

    more = made(7)
    with monkeypatch.context() as m:
        m.setattr(Inversion, "_commit", lost)
        with pytest.raises(RuntimeError):
            deliver(spark, inv, "c", more)
    again = Inversion(spark, root)
    assert stored(again) == brute(epochs)
    epochs["c"] = more
    deliver(spark, again, "c", more)
    assert stored(again) == brute(epochs)
    assert again.drop_old() >= 0
    assert stored(Inversion(spark, root)) == brute(epochs)


def test_an_epoch_can_become_empty(spark, tmp_path):
    inv = Inversion(spark, str(tmp_path), buckets=2)
    assert stored(inv) == ([], {})
    deliver(spark, inv, "a", made(1, 5))
    deliver(spark, inv, "a", ([], []))
    assert stored(inv) == ([], {})


def test_missing_tables_are_seen_to_be_empty(spark, tmp_path):
    """A first delivery joins nothing with tables that are not there, and writes no delta of them."""
    inv = Inversion(spark, str(tmp_path / "empty"))
    none = inv.table("incoming")
    assert none.columns == ["id", "chunk", "n_chunks", "incoming"] and none.collect() == []
    assert "LocalRelation <empty>" in none._jdf.queryExecution().optimizedPlan().toString()
    edges = spark.createDataFrame([(1, 0, 7, "t", None)] * 3 + [(2, 0, 7, "t", None)], EDGES)
    delta = inv._signed(edges.selectExpr("citing_id", "pos", "cited_id", "cited_title title", "authors"), None, "", "", "cited_id")
    assert delta.agg(F.sum("sign")).first()[0] == 4 and "Exchange" not in delta._jdf.queryExecution().executedPlan().toString()
    inv.deliver("a", spark.createDataFrame([(7, 70, "t", 1)], DOCS), edges)
    assert stored(inv) == ([(7, 70, "t", 1, 4)], {7: [(1, 0, "t")] * 3 + [(2, 0, "t")]})
