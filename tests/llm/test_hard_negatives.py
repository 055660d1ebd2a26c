import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegraph.llm import hard_negatives as H
from citegraph.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")


def brute(rows, low=80):
    kept = {}
    for i, x, label in rows:
        if i is None or x is None or label is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * v) for v in x])
        kept[i] = min(kept.get(i, (row[0], H.pack_vector(np.array(row[1], np.int64)), row)), (row[0], H.pack_vector(np.array(row[1], np.int64)), row))
    kept = {i: r[2] for i, r in kept.items()}
    out = []
    for a, (label, x) in kept.items():
        if a % 100:
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, y) in kept.items() if i != a)
        for s, p, _ in [r for r in scores if r[2] == label][:5]:
            fitting = [r for r in scores if r[2] != label and low * -s <= 100 * -r[0] <= 100 * -s][:5]
            out += [(a, p, rank, i, -s, -n) for rank, (n, i, _) in enumerate(fitting, 1)]
    return sorted(out)


def vectors(n, dim, seed, groups=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dim))
    x = centres[r.integers(0, groups, n)] + r.normal(size=(n, dim)) * r.choice([0.05, 0.4, 1.0], (n, 1))
    x[::9] = x[0]  # a vector that many rows share, under several labels
    x[1::50] *= -1
    x[2::70] = 0
    return [(int(i), [float(v) for v in row], int(label)) for i, row, label in zip(r.permutation(n * 3)[:n] if seed % 2 else range(n), x, r.integers(0, 10, n))]


ODD = [(100_000, None, 1), (100_100, [0.1, None, 0.3, 0.1], 1), (100_200, [0.1, NAN, 0.3, 0.1], 2), (100_300, [INF, 0.0, 0.3, 0.1], 2), (100_400, [0.5, 0.5, 0.1, 0.1], None),
       (None, [0.5, 0.5, 0.1, 0.1], 3), (100_500, [], 4), (100_600, [0.9], 4), (100_700, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 5), (100_800, [300.0, -200.0, 0.0, 1e4], 6), (0, [0.25, 0.25, 0.25, 0.25], 2),
       (0, [0.25, 0.25, 0.25, 0.25], 2), (0, [0.5, 0.25, 0.25, 0.25], 2), (200, [0.1, 0.1, 0.1, 0.2], 9)]


def run(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "m", "slot", "anchor", "vec", "x", "score", "rank", "cell", "Place")})
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(tuple(r) for r in QUERIES["op11_hard_negatives"](spark, str(tmp_path)).collect())


def test_against_brute_force(spark, tmp_path):
    rows = vectors(1500, 4, 2) + ODD
    got = run(spark, tmp_path, rows)
    assert got == brute(rows) and len(got) > 100


def test_many_cells_blocks_and_rounds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "PER_CENTROID", 1)
    monkeypatch.setattr(H, "BLOCK_BYTES", 200)
    monkeypatch.setattr(H, "MEMBER_BYTES", 40)
    monkeypatch.setattr(H, "ROUNDS", (1, 4))
    rows = vectors(4000, 3, 4) + ODD
    got = run(spark, tmp_path, rows)
    assert got == brute(rows) and len(got) > 300


@pytest.mark.parametrize("rows", [[], [(5, [0.1, 0.2], 1)], [(100, [0.1, 0.2], 1)], [(100, [0.1], 1), (101, [0.1], 1)], [(100, [1.0], 1), (101, [1.0], 1), (102, [0.9], 2)]])
def test_few_rows(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == brute(rows)


def test_walk_stops_when_certified():
    """A member's walk ends before candidates whose bound is below its list."""
    r = np.random.default_rng(1)
    near, far = np.rint(1000 * (np.eye(8)[:1] + 0.01 * r.normal(size=(600, 8)))).astype(np.int64), np.rint(1000 * (np.eye(8)[1:2] + 0.01 * r.normal(size=(600, 8)))).astype(np.int64)
    block, asked = np.concatenate((far, near)), []
    real = H.products
    H.products = lambda u, v: asked.append(len(v)) or real(u, v)
    try:
        members = near[:2]
        ask, score, vec = H.walk(members, np.zeros(2), np.eye(8)[0], 0.05, np.arange(2), np.full(2, H._HIGH), np.full(2, H._LOW), block, np.zeros(1200), np.arange(1200), True, 5)
    finally:
        H.products = real
    whole = members @ block.T
    for i in range(2):
        order = np.lexsort((np.arange(1200), -whole[i]))[:5]
        assert vec[ask == i].tolist() == order.tolist() and score[ask == i].tolist() == whole[i][order].tolist()
    assert sum(asked) < 1200


def test_large_integers_stay_exact():
    u = np.array([[2**30 + 1, 3], [1, 1]])
    v = np.array([[2**30 + 3, 5]])
    assert H.products(u, v).tolist() == [[(2**30 + 1) * (2**30 + 3) + 15], [2**30 + 8]]
    with pytest.raises(OverflowError):
        H.products(np.array([[2**40]]), np.array([[2**40]]))
    for x in ([0, -1], [2**15 - 1, -(2**15)], [2**15], [-(2**31) - 1], []):
        assert H.unpack_vectors([H.pack_vector(np.array(x, np.int64))]).tolist() == [x]
