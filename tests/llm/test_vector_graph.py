import numpy as np
import pytest

from citegraph.llm import vector_graph as V


def brute(rows, least=0.93):
    """(n_links, component) per row of (id, label, vector)."""
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, float)
        return a / np.sqrt((a * a).sum())

    u = [None if lab is None else unit(v) for _, lab, v in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if u[i] is not None and u[j] is not None and rows[i][1] == rows[j][1] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= least:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    smallest = {}
    for i, (k, _, _) in enumerate(rows):
        r = find(i)
        if k is not None:
            smallest[r] = min(smallest.get(r, k), k)
    return [(rows[i][0], n[i], smallest.get(find(i))) for i in range(len(rows))]


@pytest.fixture()
def vectors():
    r = np.random.default_rng(5)
    rows, at = [], 0
    for label in (1, 2, 3):
        for _ in range(60):
            rows.append((at, label, r.normal(size=16).tolist()))
            at += 1
        center = r.normal(size=16)
        for _ in range(40):  # a dense group
            rows.append((at, label, (center + r.normal(size=16) * 0.12).tolist()))
            at += 1
        chain = r.normal(size=16)
        for _ in range(10):  # links without direct neighbourhood of the ends
            chain = chain + r.normal(size=16) * 0.2
            rows.append((at, label, chain.tolist()))
            at += 1
        rows += [(at + i, label, center.tolist()) for i in range(12)]  # copies
        at += 12
    rows += [(at, None, rows[0][2]), (at + 1, 1, None), (at + 2, 1, [0.0] * 16), (at + 3, 1, [1.0, None] + [0.0] * 14), (at + 4, 1, [float("nan")] * 16),
             (at + 5, 1, [float("inf")] + [1.0] * 15), (at + 6, 1, []), (at + 7, 1, [1.0, 2.0]), (at + 8, 1, [2.0, 4.0]), (at + 9, 4, [1.0])]
    return rows


SCHEMA = "vec_id long, label int, embedding array<float>"


@pytest.mark.parametrize("shard", [2048, 40])
def test_links_and_components_equal_brute_force(frame, vectors, monkeypatch, shard):
    monkeypatch.setattr(V, "SHARD", shard)
    monkeypatch.setattr(V, "PER_CENTROID", 40)
    df = frame(vectors, SCHEMA).repartition(4)
    kept = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    got = {r.vec_id: r for r in V.near_vectors(df).collect()}
    for i, n, c in brute(kept):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n, c, i == c), i
        assert got[i].audit_recall >= V.MIN_RECALL


def test_links_over_a_cell_border_count_for_both_ends(spark, frame, monkeypatch):
    r = np.random.default_rng(8)
    centroids = V.unit_rows(r.normal(size=(12, 8)))
    x = V.unit_rows(np.repeat(V.unit_rows(r.normal(size=(25, 8))), 8, axis=0) + r.normal(size=(200, 8)) * 0.12)
    nodes = frame([(i, "1", v.tolist(), 1 + i % 3) for i, v in enumerate(x)], "node long, label string, x array<double>, copies long")
    cells = V._cells(nodes, {("1", 8): centroids}, 2).withColumn("group", V.F.col("cell")).withColumn("blocks", V.F.lit(1).cast("long")).withColumn("block", V.F.lit(0).cast("long"))
    found = V._search(cells, V._build(cells), 0.9, 200).where("b is null").groupBy("a").agg(V.F.sum("n").alias("n"))
    near = np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :2]
    meets = (near[:, :1, None] == near.T[None].transpose(0, 2, 1)).any(axis=2)  # a query's nearest cell holds the node
    links = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert (links & meets & ~meets.T).any()
    want = ((links & (meets | meets.T)) * (1 + np.arange(len(x)) % 3)).sum(axis=1)
    assert {a.a: a.n for a in found.collect()} == dict(enumerate(want.tolist()))


def test_dense_group_does_not_hide_lost_pairs(frame, monkeypatch):
    r = np.random.default_rng(3)
    heart = r.normal(size=16)
    dense = [(heart + r.normal(size=16) * 0.1).tolist() for _ in range(120)]
    ends = V.unit_rows(np.repeat(r.normal(size=(30, 16)), 2, axis=0) + r.normal(size=(60, 16)) * 0.1)  # pairs
    rows = [(i, 1, v) for i, v in enumerate(dense + ends.tolist())]
    want = brute(rows)
    assert sum(n > V.DENSE for _, n, _ in want) > 100 and sum(0 < n < 5 for _, n, _ in want) > 40
    # a cell for each end of a pair, and no second try
    monkeypatch.setattr(V, "_centroids", lambda nodes, count: {("1", 16): np.vstack((V.unit_rows(heart[None]), ends))})
    monkeypatch.setattr(V, "OVERLAP", 1)
    monkeypatch.setattr(V, "TRIES", 1)
    monkeypatch.setattr(V, "SHARD", 50)
    df = frame(rows, "vec_id long, label int, embedding array<double>")
    got = {x.vec_id: (x.n_links, x.component_id, x.audit_recall) for x in V.near_vectors(df).collect()}
    assert got == {i: (n, c, 1.0) for i, n, c in want}


def test_repeated_rows_null_ids_and_clashing_columns(frame):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, 7, a, 5, "x"), (1, 7, a, 5, "x"), (None, 7, a, 5, "x"), (None, 7, b, 5, "x"), (3, 7, [2.0, 0.0, 0.0], 5, "x")]
    out = V.near_vectors(frame(rows, "vec_id long, label int, embedding array<float>, node int, group string"))
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()), key=str) == sorted(
        [(1, 3, 1, True), (1, 3, 1, True), (None, 3, 1, False), (None, 0, None, True), (3, 3, 1, False)], key=str)
    assert V.near_vectors(frame([], SCHEMA)).collect() == []


def test_very_large_and_very_small_components(frame):
    rows = [(1, 1, [1e200, 1e200]), (2, 1, [2e200, 2e200]), (3, 2, [1e-200, 1e-200]), (4, 2, [1.0, 0.01]), (5, 2, [5e-324, 5e-324]), (6, 2, [1e308, 0.0]), (7, 3, [0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in V.near_vectors(frame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 4), 5: (1, 3), 6: (1, 4), 7: (0, 7)}


def test_graph_search_finds_whole_range():
    r = np.random.default_rng(2)
    x = V.unit_rows(np.vstack((r.normal(size=(300, 24)), r.normal(size=24) + r.normal(size=(100, 24)) * 0.15)))
    lists = V.prune_graph(x)
    got = set(zip(*V.range_search(x, np.full(len(x), -1), x, lists, 0.9)))
    want = set(zip(*np.nonzero(x @ x.T >= 0.9)))
    assert got <= want and len(got) >= 0.95 * len(want)
    a, b = V.forest(np.array([1, 5, 9, 7]), np.array([2, 6, 2, 5]))
    assert len(a) == 4 and set(zip(a.tolist(), b.tolist())) == {(2, 1), (9, 1), (6, 5), (7, 5)}
