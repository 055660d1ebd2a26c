"""Operator 11: hard negatives by anchor-clustered shared lists (after MAXIMUS, exact).

Anchors are clustered by direction.  An anchor u of a cluster with centroid c lies within an angle theta of it, so for a
candidate v ``u . v <= |u| |v| cos(max(0, angle(c, v) - theta))``: but for |u| this bound is the same for the whole
cluster.  So each cluster sorts the candidates by the bound once, and every member walks that list from the
top until the bound of what follows cannot reach its list any more.

Spread over a cluster of machines, a list has three levels.  Candidates lie in cells (by the nearest of the same
centroids) and, sorted by their angle to it, in blocks of bounded bytes; members of a cluster likewise.  Cells are
sorted by their bounds for each anchor cluster, a round of the walk takes the next ranks of that order, drops the
cells and blocks whose bounds are below all its members' thresholds, and a task walks the candidates of one block for
the members of one block.  After a round the partial lists are merged, and thresholds rise.  What is left out is certified
not to reach a list, so the result is exact.

Rows that agree in label and vector differ only in the tie order: of such a group no list can hold more than its smallest ids,
one more than a list is long.  So only those are candidates, and equal anchors walk once; a vector that a third of the
rows repeat costs a few rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegraph.llm.common import map_batches, short_batches, stored, tidy

#: anchors on which the centroids are fitted (drawn by hash, at most this many bytes of them), anchors a centroid, centroids
SAMPLE, SAMPLE_BYTES, PER_CENTROID, CENTROIDS = 16_384, 32 << 20, 64, 1024
#: bytes of a block's vectors: candidates, members of an anchor cluster
BLOCK_BYTES, MEMBER_BYTES = 128 << 10, 16 << 10
#: candidates of a block that are compared at once
STEP = 256
#: cells of a cluster's order up to which the rounds go (the last one goes on to the end)
ROUNDS = (2, 16)
#: what rounding may take off an angle (radians)
SLACK = 1e-6
_LOW, _HIGH = -(2**63), 2**63 - 1


# ------------------------------------------------------------------ vectors as bytes
def pack_vector(x: np.ndarray) -> bytes:
    """An integer vector in the smallest width that holds it, which the first byte names."""
    most = max(int(x.max()), -int(x.min()) - 1) if len(x) else 0
    width = 2 if most < 2**15 else 4 if most < 2**31 else 8
    return bytes((width,)) + x.astype(f"<i{width}").tobytes()


def unpack_vectors(packed: list[bytes]) -> np.ndarray:
    """Rows of integers, short vectors filled up with zeros."""
    if len({(p[0], len(p)) for p in packed}) == 1:
        width = packed[0][0]
        return np.frombuffer(b"".join([p[1:] for p in packed]), f"<i{width}").reshape(len(packed), -1).astype(np.int64)
    rows = [np.frombuffer(p, f"<i{p[0]}", offset=1) for p in packed]
    out = np.zeros((len(rows), max(map(len, rows))), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))


def _angles(x: np.ndarray, norm: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Angles between rows of `x` and `centroids` (unit vectors); 0 for zero rows, whose products are all 0."""
    d = min(x.shape[1], centroids.shape[1])
    cos = x[:, :d].astype(np.float64) @ centroids[:, :d].T / np.where(norm > 0, norm, 1)[:, None]
    return np.where(norm[:, None] > 0, np.arccos(np.clip(cos, -1, 1)), 0.0)


def products(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in doubles where these hold every partial sum, else in Python's integers
    (a product that does not fit a long raises OverflowError)."""
    d = min(u.shape[1], v.shape[1])
    u, v = u[:, :d], v[:, :d]
    if len(u) and len(v) and d and _norms(u).max() * _norms(v).max() >= 2.0**52:
        return (u.astype(object) @ v.T.astype(object)).astype(np.int64)
    return (u.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)


def fit_centroids(x: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """Unit centroids of the rows by spherical k-means from the first rows (which come in hash order)."""
    unit = x / np.where((n := _norms(x)) > 0, n, 1)[:, None]
    centroids = unit[:k].copy()
    for _ in range(rounds):
        nearest = (unit @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, unit)
        size = np.sqrt((sums**2).sum(axis=1))
        centroids = np.where(size[:, None] > 0, sums / np.where(size > 0, size, 1)[:, None], centroids)
    return centroids


# ------------------------------------------------------------------ walking one block
def merge(ask, score, vec, k: int):
    """The first `k` of each ask: higher scores first, ties by smaller id."""
    order = np.lexsort((vec, -score, ask))
    ask, score, vec = ask[order], score[order], vec[order]
    first = np.flatnonzero(np.diff(ask, prepend=-1))
    rank = np.arange(len(ask)) - np.repeat(first, np.diff(np.append(first, len(ask))))
    keep = rank < k
    return ask[keep], score[keep], vec[keep], rank[keep]


def walk(members, labels, centroid, theta, slot, cap, floor, block, block_labels, ids, same: bool, k: int):
    """What the asks of one member block find in one candidate block: (ask, score, id) of the first `k` of each ask.

    An ask belongs to the member `slot` and takes scores from `floor` to `cap`, of candidates with the
    member's label (`same`) or with another one."""
    norm = _norms(block)
    bound = norm * np.cos(np.clip(_angles(block, norm, centroid[None])[:, 0] - theta - SLACK, 0, np.pi))
    order = np.argsort(-bound, kind="stable")
    block, block_labels, ids, bound = block[order], block_labels[order], ids[order], bound[order]
    reach, floor = _norms(members)[slot], floor.copy()
    found = (np.empty(0, np.int64),) * 3
    for i in range(0, len(ids), STEP):
        at = slice(i, i + STEP)
        open_ = np.flatnonzero(reach * bound[i] * (1 + 1e-9) + 1e-6 >= floor)
        if not len(open_):
            break  # certified: what follows reaches no list
        used, place = np.unique(slot[open_], return_inverse=True)
        scores = products(members[used], block[at])[place]
        ok = (scores >= floor[open_, None]) & (scores <= cap[open_, None])
        ok &= (labels[slot[open_], None] == block_labels[None, at]) == same
        r, c = np.nonzero(ok)
        if not len(r):
            continue
        ask, score, vec, rank = merge(*(np.concatenate(z) for z in zip(found, (open_[r], scores[r, c], ids[at][c]))), k)
        found = ask, score, vec
        full = rank == k - 1
        floor[ask[full]] = np.maximum(floor[ask[full]], score[full])
    return found


# ------------------------------------------------------------------ tables
def _vectors(df: DataFrame, scale: int) -> DataFrame:
    """(id, label, anchor, vec) from (id, label, anchor, x): components become floor(scale * x)."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        x = b.column(3)
        ends = x.offsets.to_numpy().astype(np.int64)
        values = np.floor(x.values.to_numpy(zero_copy_only=False) * float(scale))
        if np.abs(values[ends[0] : ends[-1]]).max(initial=0) >= 2.0**62:
            raise OverflowError("a component does not fit a long")
        values = values.astype(np.int64)
        return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([pack_vector(values[a:z]) for a, z in zip(ends, ends[1:])], pa.binary())], names=["id", "label", "anchor", "vec"])

    return map_batches(df, run, "id long, label long, anchor boolean, vec binary")


def _packed(rows: DataFrame, centroids: np.ndarray, most_bytes: int) -> DataFrame:
    """Blocks of `rows` (id, label, vec): (block, cell, n, lo, hi, norm, ids, labels, vecs), the rows of a cell in order of
    their angles to its centroid (lo to hi), at most `most_bytes` of vectors each (one vector at least)."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        x = unpack_vectors(b.column(2).to_pylist())
        norm = _norms(x)
        angles = _angles(x, norm, shared.value)
        cell = angles.argmin(axis=1)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell]), pa.array(norm)], names=["id", "label", "vec", "cell", "angle", "norm"])

    placed = map_batches(rows.select("id", "label", "vec"), place, "id long, label long, vec binary, cell int, angle double, norm double")
    order = ("cell", "angle", "id", "label")

    def run(batches):
        part, n = TaskContext.get().partitionId() << 32, 0
        cell, size, held = None, 0, []

        def flush():
            nonlocal n, held, size
            ids, labels, vecs, _, angles, norms = zip(*held)
            row = [part + n, cell, len(ids), angles[0], angles[-1], max(norms), np.array(ids, "<i8").tobytes(), np.array(labels, "<i8").tobytes(), list(vecs)]
            n, held, size = n + 1, [], 0
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=["block", "cell", "n", "lo", "hi", "norm", "ids", "labels", "vecs"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if held and (row[3] != cell or size + len(row[2]) > most_bytes):
                    yield flush()
                cell = row[3]
                held.append(row)
                size += len(row[2])
        if held:
            yield flush()

    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(tidy(run), "block long, cell int, n int, lo double, hi double, norm double, ids binary, labels binary, vecs array<binary>")


def _slots(members: DataFrame) -> DataFrame:
    """(m, slot, first_id): the members of each block by their place."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids = [np.frombuffer(x.as_py(), "<i8") for x in b.column(1)]
        m = np.repeat(b.column(0).to_numpy(), [len(x) for x in ids])
        return pa.RecordBatch.from_arrays([pa.array(m), pa.array(np.concatenate([np.arange(len(x)) for x in ids])), pa.array(np.concatenate(ids))], names=["m", "slot", "first_id"])

    return map_batches(members.select("block", "ids"), run, "m long, slot long, first_id long")


class _Lists:
    """The anchor clusters' shared lists: member blocks, candidate blocks, and the order of cells for each cluster."""

    def __init__(self, members: DataFrame, blocks: DataFrame, centroids: np.ndarray):
        self.members, self.blocks, self.centroids, k = members, blocks, centroids, len(centroids)
        at = _angles(centroids, np.ones(k), centroids)
        low, high, norm, theta = np.full(k, np.pi), np.zeros(k), np.zeros(k), np.zeros(k)
        for r in blocks.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("norm").alias("norm")).collect():  # a row a centroid
            low[r.cell], high[r.cell], norm[r.cell] = r.lo, r.hi, r.norm
        for r in members.groupBy("cell").agg(F.max("hi").alias("hi")).collect():
            theta[r.cell] = r.hi
        gap = np.maximum(np.maximum(at - high[None], low[None] - at) - SLACK, 0)  # between a centroid and the rows of a cell
        order = np.argsort(-norm[None] * np.cos(np.clip(gap - theta[:, None], 0, np.pi)), axis=1, kind="stable")
        self.shared = members.sparkSession.sparkContext.broadcast((at, gap, norm, order, centroids))

    def _pairs(self, asks: DataFrame, start: int, stop: int) -> DataFrame:
        """(member block, candidate block) of the ranks start..stop of the members' lists that may reach an ask."""
        shared = self.shared

        def cells(b: pa.RecordBatch) -> pa.RecordBatch:
            at, gap, norm, order, _ = shared.value
            out = []
            for m, cluster, theta, reach, least in zip(*(c.to_pylist() for c in b.columns)):
                for cell in order[cluster, start:stop].tolist():
                    if norm[cell] > 0 or least <= 0:
                        if reach * norm[cell] * max(np.cos(min(max(gap[cluster, cell] - theta - SLACK, 0), np.pi)), 0) * (1 + 1e-9) + 1e-6 >= least:
                            out.append((m, cell, float(at[cluster, cell]), theta, reach, least))
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds], names=["m", "cell", "at", "theta", "reach", "least"])

        open_ = asks.groupBy("m").agg(F.min("floor").alias("least")).join(self.members.select(F.col("block").alias("m"), "cell", "hi", "norm"), "m")
        near = map_batches(open_.select("m", "cell", "hi", "norm", "least"), cells, "m long, cell int, at double, theta double, reach double, least long")
        gap = F.greatest(F.col("at") - F.col("hi"), F.col("lo") - F.col("at")) - F.col("theta") - 2 * SLACK
        reach = F.col("reach") * F.col("norm") * F.greatest(F.cos(F.least(F.greatest(gap, F.lit(0.0)), F.lit(float(np.pi)))), F.lit(0.0)) * (1 + 1e-9) + 1e-6
        return near.join(self.blocks.select("block", "cell", "lo", "hi", "norm"), "cell").where(reach >= F.col("least")).select("m", "block")

    def walked(self, asks: DataFrame, same: bool, k: int) -> DataFrame:
        """(m, slot, cap, score, id): the first `k` candidates of each ask (m, slot, cap, floor)."""
        shared = self.shared

        def run(batches):
            centroids = shared.value[4]
            for b in batches:
                for row in b.to_pylist():
                    members, block = unpack_vectors(row["member_vecs"]), unpack_vectors(row["vecs"])
                    slot, cap, floor = (np.array([a[c] for a in row["asks"]], np.int64) for c in ("slot", "cap", "floor"))
                    ask, score, vec = walk(members, np.frombuffer(row["member_labels"], "<i8"), centroids[row["cluster"]], row["theta"], slot, cap, floor, block,
                                           np.frombuffer(row["labels"], "<i8"), np.frombuffer(row["ids"], "<i8"), same, k)
                    if len(ask):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ask), row["m"])), pa.array(slot[ask]), pa.array(cap[ask]), pa.array(score), pa.array(vec)], names=["m", "slot", "cap", "score", "id"])

        schema = "m long, slot long, cap long, score long, id long"
        best = Window.partitionBy("m", "slot", "cap").orderBy(F.desc("score"), "id")
        lists, start = None, 0
        for stop in (*ROUNDS, len(self.centroids)):
            if start >= min(stop, len(self.centroids)):
                continue
            bundles = asks.groupBy("m").agg(F.collect_list(F.struct("slot", "cap", "floor")).alias("asks"))
            who = self.members.select(F.col("block").alias("m"), F.col("cell").alias("cluster"), F.col("hi").alias("theta"), F.col("labels").alias("member_labels"), F.col("vecs").alias("member_vecs"))
            pairs = stored(self._pairs(asks, start, stop), "pairs").join(who, "m").join(bundles, "m").join(self.blocks.select("block", "ids", "labels", "vecs"), "block")
            hits = pairs.mapInArrow(tidy(run), schema)
            hits = hits if lists is None else hits.unionByName(lists)
            lists = stored(hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "lists")
            full = lists.groupBy("m", "slot", "cap").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
            asks = asks.join(full, ["m", "slot", "cap"], "left").select("m", "slot", "cap", F.greatest("floor", F.coalesce("least", "floor")).alias("floor"))
            start = stop
        return lists


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   scale: int = 256, n_positives: int = 5, n_negatives: int = 5, low_pct: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all exact.

    Vectors become integers, floor(`scale` * x); a score is an inner product, higher ones come first, ties by smaller id.
    Each anchor (rows of `vectors` where `is_anchor` holds) has its first `n_positives` other rows of the same label as
    positives; for each of them the result holds the first `n_negatives` rows of other labels whose scores lie between
    `low_pct` percent of the positive's and the positive's own (so a positive with a score below 0 has none).

    Rows with a null id, label or vector, or with a null or non-finite component, take no part.  Of rows that share an id
    one takes part: that with the smallest label, then vector.  Vectors of unequal length are compared as if
    filled up with zeros; an empty one scores 0 with all.  Scores must fit a long (else the query fails).  Other
    columns are not read, whatever their names.  Without anchors, or for an empty table, there are no rows.
    """
    spark = vectors.sparkSession
    short_batches(spark)
    x = F.col(vector_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), x.alias("x"))
    rows = stored(_vectors(rows, scale), "vectors")
    twice = stored(rows.groupBy("id").count().where("count > 1").select("id"), "repeated")
    one = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vec", "anchor")).alias("r")).select("id", "r.label", "r.anchor", "r.vec")
    rows = rows.join(twice, "id", "left_anti").unionByName(one)

    # equal vectors of one label: the smallest ids stand for all
    depth = max(n_positives + 1, n_negatives)
    alike = Window.partitionBy("label", "vec").orderBy("id")
    candidates = rows.withColumn("place", F.row_number().over(alike)).where(F.col("place") <= depth).drop("place")
    anchors = stored(rows.where("anchor").select(F.col("id").alias("anchor_id"), "label", "vec"), "anchors")
    asking = stored(anchors.groupBy("label", "vec").agg(F.min("anchor_id").alias("id")), "asking")

    n, width = asking.agg(F.count(F.lit(1)), F.max(F.length("vec"))).first()
    drawn = asking.orderBy(F.xxhash64("label", "vec"), "label", "vec").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * (width or 1))))).select("vec").collect()
    sample = unpack_vectors([bytes(r.vec) for r in drawn]).astype(np.float64) if drawn else np.zeros((1, 1))
    centroids = fit_centroids(sample, max(1, min(CENTROIDS, len(sample), n // PER_CENTROID)))

    members = stored(_packed(asking, centroids, MEMBER_BYTES), "members")
    blocks = stored(_packed(candidates, centroids, BLOCK_BYTES), "blocks")
    lists = _Lists(members, blocks, centroids)
    slots = stored(_slots(members), "slots")
    asks = slots.select("m", "slot", F.lit(_HIGH).alias("cap"), F.lit(_LOW).alias("floor"))
    near = lists.walked(asks, True, n_positives + 1)

    # each anchor's own list is that of its vector without itself; members keep the order of their ids
    own = asking.withColumnRenamed("id", "first_id").join(anchors, ["label", "vec"]).select("first_id", "anchor_id")
    mine = slots.join(own, "first_id").select("m", "slot", "anchor_id")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    positives = mine.join(near.select("m", "slot", "score", "id"), ["m", "slot"]).where("id <> anchor_id")
    positives = positives.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n_positives)
    positives = stored(positives.select("m", "slot", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    asks = stored(positives.where("positive_score >= 0").select("m", "slot", F.col("positive_score").alias("cap")).distinct()
                  .withColumn("floor", F.expr(f"cast(ceil({low_pct} * cast(cap as decimal(38,0)) / 100) as bigint)")), "asks")
    far = lists.walked(asks, False, n_negatives)
    ranked = far.withColumn("rank", F.row_number().over(Window.partitionBy("m", "slot", "cap").orderBy(F.desc("score"), "id")))
    ranked = ranked.select("m", "slot", F.col("cap").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(ranked, ["m", "slot", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
