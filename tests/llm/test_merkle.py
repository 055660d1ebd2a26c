import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from citegraph.llm import merkle as M
from citegraph.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(d, text):
    return digest(*map(encoded, (d[0], d[3], d[2], d[4], text)))


def tree(leaves):
    """Root and, for each leaf, its (place, siblings) by level."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for j, p in enumerate(at):
            proofs[j].append((p % 3, [x for k, x in enumerate(runs[p // 3]) if k != p % 3]))
            at[j] = p // 3
        nodes = [digest(*r) for r in runs]
    return nodes[0], proofs


def brute(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d[3], []).append(d)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    parts = []
    for s in names:
        rows = sorted(groups[s], key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[1])))
        parts.append((rows, *tree([leaf(d, d[1]) for d in rows])))
    root, above = tree([sub for _, sub, _ in parts]) if parts else (None, [])
    out = []
    for (rows, sub, proofs), more in zip(parts, above):
        for d, proof in zip(rows, proofs):
            hit = d[0] is not None and d[1] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0
            folded = leaf(d, d[1].replace("\n", "") if hit else d[1])
            for place, siblings in proof + more:
                folded = digest(*siblings[:place], folded, *siblings[place:])
            out.append((d[0], leaf(d, d[1]), sub, root, digest(*[x for _, sib in proof + more for x in sib]), folded, folded == root))
    return sorted(out, key=str)


def cases():
    docs = [(i, f"line {i}\nand more\n" if i % 5 else "no end", "en", "big", 10 + i) for i in range(-40, 250)]
    docs += [(7, "once more", "en", "big", 1), (7, "once more", "en", "big", 1), (None, "no id\n", "de", "big", 3), (None, None, None, "big", None)]
    docs += [(i, "", None, None, 0) for i in range(4)] + [(900, None, "fr", "lone", None), (901, "x\n" * 50_000, "fr", "über", 100_000), (902, "zwei\n", "fr", "über", None)]
    return docs + [(1000 + i, f"{i}\n", "en", f"src{i:02}", i) for i in range(11)]


def run(spark, tmp_path, rows, extra=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:  # names the operator uses itself
        for c in ("tree", "pos", "n", "digest", "block", "proof", "leaf", "root", "part", "rank", "before", "Suspect"):
            df = df.withColumn(c, F.lit("clash"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in QUERIES["op13_merkle_manifest"](spark, str(tmp_path)).collect()), key=str)


def test_against_brute_force(spark, tmp_path):
    got = run(spark, tmp_path, cases(), extra=True)
    assert got == brute(cases())
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("levels", [1, 2])
def test_many_passes(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(M, "LEVELS", levels)
    monkeypatch.setattr(M, "BLOCK", 3**levels)
    assert run(spark, tmp_path, cases()) == brute(cases())


@pytest.mark.parametrize("rows", [[], [(5, "only\n", "en", "s", 5)], [(1, "a\n", "en", None, 2), (2, "b", "en", None, 1)]])
def test_few_rows(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 100])
def test_sweeps_of_one_block(n):
    leaves = [digest(str(i)) for i in range(n)]
    root, proofs = tree(leaves)
    inbox = M.sweep_up(leaves, M.height(n))
    assert inbox[M.height(n) + 1, 0] == [root]
    got = M.sweep_down(inbox, n, M.height(n), "")
    assert got == ["".join(f"{p}:{''.join(sib)}/" for p, sib in proof) for proof in proofs]
    assert all(M.fold(a, p) == root for a, p in zip(leaves, got))
