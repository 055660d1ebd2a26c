"""Operator 3: near-duplicate vectors through a robust-pruned flat graph.

Only vectors with equal labels (and lengths) are compared.  Equal vectors are one node with a multiplicity.
Centroids drawn from the nodes cut each label into cells; every node lies in the `OVERLAP` cells
nearest to it (the shards overlap), a query is sent to its nearest cell.

1. *Build.*  Each shard's nodes get neighbour lists by robust pruning: the nearest remaining node is taken, and
   nodes that it reaches more cheaply than the owner does are dropped; lists get their reverse links.
2. *Union.*  A node's lists from all its shards are joined into one.
3. *Search.*  Every vector is a query: greedy beam search from the shard's medoids and the query's own node; as soon as a
   node within range is found the search spreads from all nodes in range until no new one appears.
4. *Verify.*  Links are cosines in double precision of at least the threshold.  A task returns
   each query's number of links and a spanning forest of the links, never the pairs.
5. *Audit.*  For a bounded sample of queries the links are counted by brute force over all nodes, and each query has a
   recall of its own.  If the mean recall of queries with few or of those with many links is below `MIN_RECALL`, or
   more of those with few have lost one, the overlap and the beam are doubled and the search is run again; after the last
   try every block of a label's nodes is compared with every other exactly.

Cells with more than `SHARD` nodes are split into blocks of nodes and of queries; every query block meets every
node block, so a hot cell costs more tasks, not more memory, and loses nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import map_batches, short_batches, stored
from citegraph.llm.components import connected_components

#: nodes of a cell for which a centroid is drawn, and the most centroids (they are broadcast)
PER_CENTROID, MAX_CENTROIDS = 300, 20_000
#: centroids nearer to a kept one than this are left out, so that a dense group has one cell
APART = 0.7
#: cells of a node, nodes of a shard, queries of a task
OVERLAP, SHARD = 3, 1024
#: neighbours of a node, pruning factor, medoids and width of the beam
DEGREE, ALPHA, MEDOIDS, BEAM = 16, 1.2, 16, 48
#: similarities computed at once, entries of a task's table of visited nodes
VISITS, SEEN = 20_000, 500_000
#: audited queries, the share of links that must be found, and the number of links from which a query counts as one of a dense group
AUDIT, MIN_RECALL, DENSE = 1000, 0.95, 100
#: tries with doubled overlap and beam, before everything is compared
#: bytes of the centroids, at most: they go to the driver and to all tasks
CENTROID_BYTES = 200_000_000
TRIES = 3


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; a row is divided by its largest component first, whose square could leave the range of doubles."""
    if not x.size:
        return x
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


# ------------------------------------------------------------------ build
def prune_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Neighbour lists (positions) of the unit vectors `x` by robust pruning, with reverse links."""
    m = len(x)
    near = x.astype(np.float32) @ x.astype(np.float32).T  # single precision does for the graph
    dist = np.maximum(1 - near, 0)
    np.fill_diagonal(near, -np.inf)
    rows = np.arange(m)
    lists = np.full((m, degree), -1)
    for k in range(min(degree, m - 1)):
        pick = near.argmax(axis=1)
        open_ = near[rows, pick] > -np.inf
        lists[open_, k] = pick[open_]
        near[rows, pick] = -np.inf
        near[open_] = np.where(alpha * dist[pick[open_]] <= dist[open_], -np.inf, near[open_])
    a, b = np.repeat(rows, degree), lists.ravel()
    a, b = a[b >= 0], b[b >= 0]
    both = np.unique(np.concatenate((np.stack((a, b), 1), np.stack((b, a), 1))), axis=0) if len(a) else np.empty((0, 2), int)
    return np.split(both[:, 1], np.searchsorted(both[:, 0], rows[1:]))


def medoids_of(x: np.ndarray, k: int = MEDOIDS) -> np.ndarray:
    """The node nearest to the mean, then nodes far from those taken."""
    out = [int((x @ x.mean(axis=0)).argmax())]
    while len(out) < min(k, len(x)):
        out.append(int((x @ x[out].T).max(axis=1).argmin()))
    return np.unique(out)


# ------------------------------------------------------------------ search
def range_search(q: np.ndarray, own: np.ndarray, x: np.ndarray, lists: list[np.ndarray], least: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) positions with cosine >= `least` among unit vectors; `own` is a query's node or -1.

    Similarities are computed for visited nodes only, all queries a step together."""
    m, rows = len(x), np.arange(len(q))
    seen = np.full((len(q), m), -np.inf)
    done = np.zeros((len(q), m), bool)
    width = max(map(len, lists))
    table = np.full((m, max(width, 1)), -1)
    for i, v in enumerate(lists):
        table[i, : len(v)] = v

    def visit(r, c):
        new = seen[r, c] == -np.inf
        r, c = r[new], c[new]
        for s in range(0, len(r), VISITS):
            a, b = r[s : s + VISITS], c[s : s + VISITS]
            seen[a, b] = np.einsum("ij,ij->i", q[a], x[b])

    start = medoids_of(x)
    visit(np.repeat(rows, len(start)), np.tile(start, len(q)))
    visit(rows[own >= 0], own[own >= 0])
    active = rows
    while len(active):
        rest = np.where(done[active], -np.inf, seen[active])
        pick = rest.argmax(axis=1)
        best = rest[np.arange(len(active)), pick]
        if m > beam:
            limit = np.partition(seen[active], m - beam, axis=1)[:, m - beam]
        else:
            limit = np.full(len(active), -np.inf)
        go = (best > -np.inf) & (best >= limit)
        active, pick = active[go], pick[go]
        done[active, pick] = True
        near = table[pick]
        r, c = np.repeat(active, table.shape[1]), near.ravel()
        visit(r[c >= 0], c[c >= 0])
    while True:  # spread from everything in range
        r, c = np.nonzero((seen >= least) & ~done)
        if not len(r):
            break
        done[r, c] = True
        near = table[c]
        rr, cc = np.repeat(r, table.shape[1]), near.ravel()
        pairs = np.unique(rr[cc >= 0] * m + cc[cc >= 0])
        visit(pairs // m, pairs % m)
    return np.nonzero(seen >= least)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the links (a, b) connect, one less than there are nodes at most per part."""
    if not len(a):
        return a, b
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = root.copy()
        np.minimum.at(low, root[x], root[y])
        np.minimum.at(low, root[y], root[x])
        while not (low == low[low]).all():
            low = low[low]
        new = low[root]
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(ids))
    return ids[far], ids[root[far]]


# ------------------------------------------------------------------ Spark jobs
def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length without nulls as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _nodes(vectors: DataFrame) -> DataFrame:
    """(node, label, x, copies): distinct comparable vectors.  A node's number is a 64-bit hash of label and vector."""
    usable = vectors.where("label is not null and size(x) > 0 and not exists(x, v -> v is null or isnan(v) or abs(v) = double('infinity')) and exists(x, v -> v <> 0)")
    return usable.groupBy("node", "label", "x").agg(F.count(F.lit(1)).alias("copies"))


def _centroids(nodes: DataFrame, count: int) -> dict[tuple, np.ndarray]:
    """Unit centroids per (label, length), drawn by a hash of the node; a near one of a kept one is left out."""
    longest = nodes.agg(F.max(F.size("x"))).first()[0] or 1
    most = max(1, min(MAX_CENTROIDS, CENTROID_BYTES // (16 * longest)))
    share = min(1 / PER_CENTROID, most / max(count, 1))
    drawn = nodes.where(F.pmod(F.xxhash64("node", F.lit("centroid")), F.lit(1 << 40)) < F.lit(int(share * (1 << 40)))).select("node", "label", "x")
    groups: dict[tuple, list] = {}
    for r in drawn.orderBy("node").limit(2 * most).collect():
        groups.setdefault((r.label, len(r.x)), []).append(r.x)
    out = {}
    for key, xs in groups.items():
        kept = np.empty((0, key[1]))
        for v in unit_rows(np.array(xs, np.float64)):
            if not len(kept) or (kept @ v).max() < APART:
                kept = np.vstack((kept, v))
        out[key] = kept
    return out


def _cells(nodes: DataFrame, centroids: dict[tuple, np.ndarray], overlap: int) -> DataFrame:
    """(node, label, x, copies, cell, home, nearest, around): a row for each of a node's cells; home marks the nearest
    one, around holds all of them."""
    shared = nodes.sparkSession.sparkContext.broadcast(centroids)

    def assign(b: pa.RecordBatch) -> pa.RecordBatch:
        labels, vecs = b.column(1).to_pylist(), b.column(2)
        sizes = [len(v) for v in vecs]
        take, cell, home, nearest, around = [], [], [], [], []
        for key in sorted({*zip(labels, sizes)}, key=str):
            at = np.array([i for i, k in enumerate(zip(labels, sizes)) if k == key])
            c = shared.value.get(key)
            if c is None:
                near = np.zeros((len(at), 1), int)
            else:
                near = np.argsort(-(unit_rows(_matrix(vecs.take(pa.array(at)))) @ c.T), axis=1, kind="stable")[:, :overlap]
            take.append(np.repeat(at, near.shape[1]))
            cell.append(near.ravel())
            home.append(np.tile(np.arange(near.shape[1]) == 0, len(at)))
            nearest.append(np.repeat(near[:, 0], near.shape[1]))
            around += list(np.repeat(near, near.shape[1], axis=0))
        out = b.take(pa.array(np.concatenate(take)))
        own = [pa.array(np.concatenate(cell), pa.int64()), pa.array(np.concatenate(home)), pa.array(np.concatenate(nearest), pa.int64()), pa.array(around, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*out.columns, *own], names=[*b.schema.names, "cell", "home", "nearest", "around"])

    schema = "node long, label string, x array<double>, copies long, cell long, home boolean, nearest long, around array<long>"
    return map_batches(nodes.select("node", "label", "x", "copies"), assign, schema)


def _build(shards: DataFrame) -> DataFrame:
    """(node, near): neighbour lists of each (group, block) of nodes, joined over the shards of a node."""

    def build(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        lists = prune_graph(unit_rows(_matrix(t.column("x").combine_chunks())))
        return pa.table({"node": node, "near": pa.array([node[v] for v in lists], pa.list_(pa.int64()))})

    built = shards.select("group", "block", "node", "x").groupBy("group", "block").applyInArrow(build, "node long, near array<long>")
    return built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def _search(shards: DataFrame, graph: DataFrame | None, least: float, beam: int) -> DataFrame:
    """Rows (node, n_links, null), to be summed, and forest links (a, null, b) of all (group, block, queries) tasks.

    A query meets the nodes of its nearest cell, which may have their own queries elsewhere: a link with a node whose
    nearest cell does not hold the query is counted for both ends.  Without a graph all nodes of a task are compared."""
    cols = ("group", "block", "part", "node", "x", "copies", "nearest")
    parts = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    exact = graph is None
    base = shards.withColumn("near", F.lit(None).cast("array<long>")) if exact else shards.join(graph, "node", "left")
    as_node = base.withColumn("part", F.explode(parts)).select(*cols, "near", F.lit(None).cast("array<long>").alias("around"), F.lit(False).alias("asks"))
    as_query = shards.where("home").withColumn("part", F.col("block")).withColumn("block", F.explode(parts)).select(*cols, F.lit(None).cast("array<long>").alias("near"), "around", F.lit(True).alias("asks"))

    def search(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy()
        node = t.column("node").to_numpy()
        vec = unit_rows(_matrix(t.column("x").combine_chunks()))
        at, ask = np.flatnonzero(~asks), np.flatnonzero(asks)
        empty = pa.table({"a": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not len(at) or not len(ask):
            return empty
        at = at[np.argsort(node[at])]
        ids = node[at]
        near = t.column("near").combine_chunks()
        lists = []
        for i in at.tolist():
            v = near[i].values.to_numpy(zero_copy_only=False) if near[i].is_valid else np.empty(0, np.int64)
            p = np.minimum(np.searchsorted(ids, v), len(ids) - 1)
            lists.append(p[ids[p] == v])
        place = np.minimum(np.searchsorted(ids, node[ask]), len(ids) - 1)
        own = np.where(ids[place] == node[ask], place, -1)
        held = t.column("copies").to_numpy()
        copies, nearest = held[at], t.column("nearest").to_numpy()[at]
        around = _matrix(t.column("around").combine_chunks().take(pa.array(ask)))
        back = np.zeros(len(at), np.int64)  # links of the nodes that their own queries do not meet
        out = []
        step = max(1, SEEN // len(at))  # queries whose visited table stays small
        for s in range(0, len(ask), step):
            q = ask[s : s + step]
            r, c = np.nonzero(vec[q] @ vec[at].T >= least) if exact else range_search(vec[q], own[s : s + step], vec[at], lists, least, beam)
            other = ids[c] != node[q][r]
            r, c = r[other], c[other]
            a, b = forest(node[q][r], ids[c])
            n = np.bincount(r, weights=copies[c], minlength=len(q)).astype(np.int64)
            unmet = (around[s : s + step][r] != nearest[c][:, None]).all(axis=1)
            np.add.at(back, c[unmet], held[q][r[unmet]])
            out.append(pa.table({"a": node[q], "n": n, "b": pa.nulls(len(q), pa.int64())}))
            out.append(pa.table({"a": a, "n": pa.nulls(len(a), pa.int64()), "b": b}))
        hit = np.flatnonzero(back)
        out.append(pa.table({"a": ids[hit], "n": back[hit], "b": pa.nulls(len(hit), pa.int64())}))
        return pa.concat_tables(out)

    return as_node.union(as_query).groupBy("group", "block", "part").applyInArrow(search, "a long, n long, b long")


def _audit(nodes: DataFrame, counted: DataFrame, count: int, least: float) -> tuple[float, float]:
    """Of the audited queries that have links: the mean share of a query's links that were found, the lower one of
    queries with up to `DENSE` links and of those with more, and the share of the former that lost none (1 where there are none)."""
    draw = F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1 << 40)) < F.lit(int(min(1.0, AUDIT / max(count, 1)) * (1 << 40)))
    sample = nodes.where(draw).select("node", "label", "x").limit(2 * AUDIT)
    groups: dict[tuple, list] = {}
    for r in sample.collect():
        groups.setdefault((r.label, len(r.x)), []).append((r.node, r.x))
    asked = {k: (np.array([n for n, _ in v]), unit_rows(np.array([x for _, x in v], np.float64))) for k, v in groups.items()}
    shared = nodes.sparkSession.sparkContext.broadcast(asked)

    def brute(b: pa.RecordBatch) -> pa.RecordBatch:
        node, labels, vecs, copies = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2), b.column(3).to_numpy()
        sizes = [len(v) for v in vecs]
        a, n = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for key in {*zip(labels, sizes)} & shared.value.keys():
            at = np.array([i for i, k in enumerate(zip(labels, sizes)) if k == key])
            ids, q = shared.value[key]
            hit = (q @ unit_rows(_matrix(vecs.take(pa.array(at)))).T >= least) & (ids[:, None] != node[at][None, :])
            a.append(ids)
            n.append((hit * copies[at]).sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(n))], names=["node", "true"])

    true = map_batches(nodes.select("node", "label", "x", "copies"), brute, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    share = F.least(F.coalesce("n", F.lit(0)) / F.col("true"), F.lit(1.0)).alias("share")
    each = true.where(F.col("true") > 0).join(counted, "node", "left").select(share, (F.col("true") > DENSE).alias("dense"))
    by_kind = {r.dense: r for r in each.groupBy("dense").agg(F.avg("share").alias("recall"), F.avg((F.col("share") == 1).cast("int")).alias("whole")).collect()}
    return min([1.0, *(r.recall for r in by_kind.values())]), by_kind[False].whole if False in by_kind else 1.0


def near_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93) -> DataFrame:
    """One row per row of `table`: `id_col`, n_links (other rows with an equal label and a cosine of at least `least`),
    component_id (smallest id reachable over links, itself included), kept (the id is that of its component) and
    audit_recall (mean share of an audited query's links that the search found, the lower one of queries with few and with
    many links; 1 if all vectors were compared).

    Vectors that are null, empty, zero or hold a null, NaN or infinite component, and vectors with a null label, link
    with nothing; so do vectors of unequal lengths.  Repeated rows are copies that link with each other.  A row with a
    null id is compared but never names a component; alone its component is null and it is kept.  Further
    columns are not read; an empty table gives no rows.
    """
    short_batches(table.sparkSession)
    vectors = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("x"))
    vectors = vectors.withColumn("node", F.xxhash64("label", "x"))
    nodes = stored(_nodes(vectors), "nodes")
    count = nodes.count()
    centroids = _centroids(nodes, count)
    overlap, beam = OVERLAP, BEAM
    for attempt in range(TRIES + 1):
        exact = attempt == TRIES  # one cell a label: all blocks meet
        cells = stored(_cells(nodes, {} if exact else centroids, overlap).withColumn("group", F.xxhash64("label", F.size("x"), "cell")), "cells")
        sizes = cells.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / SHARD).alias("blocks"))
        shards = stored(cells.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks"))), "shards")
        found = stored(_search(shards, None if exact else stored(_build(shards), "graph"), least, beam), "found")
        counted = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
        recall, whole = (1.0, 1.0) if exact else _audit(nodes, counted, count, least)
        if min(recall, whole) >= MIN_RECALL:
            break
        overlap, beam = 2 * overlap, 2 * beam
    comps = stored(connected_components(found.where("b is not null").select("a", "b")), "components")
    least_id = vectors.groupBy("node").agg(F.min("id").alias("least"))
    least_id = least_id.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = least_id.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = nodes.select("node", "copies").join(counted, "node").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    linked = linked.join(named, "component").select("node", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    out = vectors.select("id", "node").join(linked, "node", "left")
    alone = F.col("n_links").isNull()
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce(alone | (F.col("id") == F.col("component_id")), F.col("component_id").isNull()).alias("kept"), F.lit(float(recall)).alias("audit_recall"),
    )
