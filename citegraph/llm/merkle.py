"""Operator 13: Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; the leaves of a source, in order, form a tree of three children a node; the roots of the
sources form one more tree.  A node's label is (tree, level, index).  Time-forward processing visits the nodes in the
order of their labels and passes messages to later labels through a priority queue: children send their digests to
their parents; then a sweep in the reversed order sends every node's proof suffix (the siblings from there to the root)
down to its children, until each leaf holds its proof.

The external part of the queue is Spark's sort: rows and messages are dealt by the block of ``3 ** LEVELS`` consecutive
nodes that they belong to and arrive sorted by label, so that a task holds one block at a time, whatever the size of a
source.  Inside a block the queue is a heap.  A pass climbs `LEVELS` levels, so 10^9 leaves take three passes up and
three down, over tables that shrink by ``3 ** LEVELS`` each.
"""

from __future__ import annotations

import heapq
from hashlib import sha256
from itertools import batched

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from citegraph.llm.common import map_batches, stored, tidy

#: children of a node
FAN = 3
#: levels that one pass climbs: a block is a tree of FAN ** LEVELS nodes at most
LEVELS = 7
BLOCK = FAN**LEVELS


def encoded(col: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    s = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the encoded fields."""
    return F.sha2(F.concat(*map(encoded, fields)), 256)


def height(n: int) -> int:
    """Levels above `n` nodes until one is left."""
    h, room = 0, 1
    while room < n:
        h, room = h + 1, room * FAN
    return h


def _digest(*parts: str) -> str:
    return sha256("".join(parts).encode("ascii")).hexdigest()


def sweep_up(digests: list[str], levels: int) -> dict[tuple[int, int], list[str]]:
    """The messages of a block's tree by label: the child digests that each node above the leaves receives, in order,
    and the root's own digest under the label behind it, (levels + 1, 0)."""
    queue = [(1, i // FAN, i, d) for i, d in enumerate(digests)]  # sorted, so a heap
    inbox: dict[tuple[int, int], list[str]] = {}
    while queue:
        level, index = queue[0][:2]
        got = []
        while queue and queue[0][0] == level and queue[0][1] == index:
            got.append(heapq.heappop(queue)[3])
        inbox[level, index] = got
        if level <= levels:
            heapq.heappush(queue, (level + 1, index // FAN, index, _digest(*got)))
    return inbox


def sweep_down(inbox: dict[tuple[int, int], list[str]], n: int, levels: int, suffix: str) -> list[str]:
    """The proof of each of the block's `n` leaves, given the suffix of its root: visited in reversed label order,
    a node sends each child its siblings and what it has received itself."""
    queue, proofs = [(-levels, 0, suffix)], [""] * n
    while queue:
        level, index, suffix = heapq.heappop(queue)
        level, index = -level, -index
        if level == 0:
            proofs[index] = suffix
            continue
        got = inbox[level, index]
        for place in range(len(got)):
            step = f"{place}:{''.join(got[:place])}{''.join(got[place + 1:])}/"
            heapq.heappush(queue, (1 - level, -(index * FAN + place), step + suffix))
    return proofs


def fold(leaf: str, proof: str) -> str:
    """The root that a leaf and a proof (steps ``place:siblings/`` from the leaf's run upwards) give."""
    for step in proof.split("/")[:-1]:
        siblings, at = step[2:], 64 * int(step[0])
        leaf = _digest(siblings[:at], leaf, siblings[at:])
    return leaf


def _blocks(batches):
    """Rows of each (tree, block), which arrive together, as lists without these two columns."""
    key, held = None, []
    for b in batches:
        for tree, block, *row in zip(*(c.to_pylist() for c in b.columns)):
            if (tree, block) != key:
                if held:
                    yield key, held
                key, held = (tree, block), []
            held.append(row)
    if held:
        yield key, held


def _dealt(nodes: DataFrame, *more: str) -> DataFrame:
    """Rows with their block, sorted by label within it; `more` are further columns."""
    if "block" not in nodes.columns:
        nodes = nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))
    return nodes.select("tree", "block", "pos", "n", "digest", *more).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _climb(nodes: DataFrame) -> DataFrame:
    """The roots of all blocks of `nodes` (tree, pos, n, digest), as nodes of the next pass."""

    def run(batches):
        for group in batched(_blocks(batches), 1000):
            rows = []
            for (tree, block), held in group:
                n = held[0][1]
                levels = min(LEVELS, height(n))
                rows.append((tree, block, -(-n // BLOCK), sweep_up([d for _, _, d in held], levels)[levels + 1, 0][0]))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["tree", "pos", "n", "digest"])

    return _dealt(nodes).mapInArrow(tidy(run), "tree string, pos long, n long, digest string")


def _descend(nodes: DataFrame, above: DataFrame, *keep: str) -> DataFrame:
    """Each row of `nodes` with its ``proof``, given the suffixes of its blocks in `above` (tree, pos, proof): they are
    messages that are sorted in front of the block's own rows.  `keep` are further columns of `nodes` to return."""
    types = dict(nodes.dtypes)
    down = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.col("proof").alias("digest"),
                        *[F.lit(None).cast(types[c]).alias(c) for c in keep])
    rows = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).select("tree", "block", "pos", "n", "digest", *keep).unionByName(down)
    schema = ", ".join(["tree string, pos long, digest string, proof string", *[f"`{c}` {types[c]}" for c in keep]])

    def run(batches):
        for (tree, _), held in _blocks(batches):
            suffix, leaves = held[0][2], held[1:]
            levels = min(LEVELS, height(leaves[0][1]))
            inbox = sweep_up([r[2] for r in leaves], levels)
            proofs = sweep_down(inbox, len(leaves), levels, suffix)
            for i in range(0, len(leaves), 200):  # proofs are long
                part = leaves[i : i + 200]
                columns = [[tree] * len(part), [r[0] for r in part], [r[2] for r in part], proofs[i : i + 200], *[[r[3 + j] for r in part] for j in range(len(keep))]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], names=[f.name for f in arrow])

    arrow = list(to_arrow_schema(StructType.fromDDL(schema)))
    return _dealt(rows, *keep).mapInArrow(tidy(run), schema)


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` (tree, ...) with pos, the rank within the tree by `order`, and n, the tree's size.

    Rows are sorted over all partitions and counted per partition.  Of a partition only its first tree can
    have rows in partitions before, so there is at most one offset a partition: that table is broadcast."""
    names = rows.columns

    def run(batches):
        part, last, count = TaskContext.get().partitionId(), None, -1
        for b in batches:
            if not b.num_rows:
                continue
            ranks = []
            for tree in b.column(0).to_pylist():
                count = count + 1 if tree == last else 0
                last = tree
                ranks.append(count)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ranks), pa.int32()), pa.array(ranks, pa.int64()), *b.columns], names=["part", "rank", *names])

    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).select("tree", *[c for c in names if c != "tree"])
    names = ranged.columns
    ranked = stored(ranged.mapInArrow(tidy(run), "part int, rank long, " + ", ".join(f"`{c}` {t}" for c, t in ranged.dtypes)), "ranked")
    counts = ranked.groupBy("part", "tree").agg(F.max("rank").alias("last"))
    before = F.sum(F.col("last") + 1).over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", "tree", before.alias("before")).where("before is not null")
    sizes = stored(counts.groupBy("tree").agg(F.sum(F.col("last") + 1).alias("n")), "sizes")  # with its size known, a short list is broadcast
    placed = ranked.join(F.broadcast(offsets), ["part", "tree"], "left").join(sizes, "tree")
    return placed.select("tree", (F.col("rank") + F.coalesce("before", F.lit(0))).alias("pos"), "n", *[c for c in names if c != "tree"])


def _passes(nodes: DataFrame) -> list[DataFrame]:
    """The node tables of all passes: `nodes`, its blocks' roots, and so on up to one root a tree."""
    out = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        out.append(stored(_climb(out[-1]), "roots"))
        most = -(-most // BLOCK)
        if most <= 1:
            return out


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
                    suspect: Column | None = None) -> DataFrame:
    """One row per row of `docs`: id, leaf (digest of `fields`), suspect (the digest given as such, null without one), subroot
    (of the group's tree), root (of all), proof (steps ``place:siblings/`` from the leaf's run up to the root).

    Leaves ascend by `id_col` within the group (null ids first; rows with one id by their digest, so that repeated rows
    have one order), groups by UTF-8 bytes (null first, as a group of its own).  Null fields have their own encoding,
    empty and long texts need no care: only digests leave the scan.  An only row is its tree's root, with an empty proof
    within the tree.  Columns that are not named, whatever their names, are not read.  An empty table gives no rows.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null first, the rest in byte order
    leaves = docs.select(tree.alias("tree"), F.col(id_col).cast("long").alias("id"), leaf_digest(*(F.col(f) for f in fields)).alias("digest"),
                         (F.lit(None) if suspect is None else suspect).cast("string").alias("suspect"))
    leaves = stored(_numbered(stored(leaves, "leaves"), "id", "digest"), "placed")
    nodes = _passes(leaves)
    subroots = nodes[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    top = _passes(stored(_numbered(subroots, "name"), "subroots"))
    root = top[-1].first()
    above = top[-1].select("tree", "pos", F.lit("").alias("proof"))
    for level in reversed(top[1:-1]):
        above = _descend(level, above)
    named = stored(_descend(top[0], above, "name"), "suffixes")
    # a tree's own root travels behind the last step of the messages
    above = named.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), F.concat("proof", "digest").alias("proof"))
    for level in reversed(nodes[1:-1]):
        above = stored(_descend(level, above), "suffixes")
    out = _descend(leaves, above, "id", "suspect")
    return out.select(F.col("id").alias(id_col), F.col("digest").alias("leaf"), "suspect", F.right("proof", F.lit(64)).alias("subroot"),
                      F.lit(root.digest if root else None).cast("string").alias("root"), F.substr("proof", F.lit(1), F.length("proof") - 64).alias("proof"))


def folded_roots(manifest: DataFrame, leaf_col: str) -> DataFrame:
    """`manifest` with folded_root, recomputed from the leaf in `leaf_col` and the row's proof."""
    at, names = [manifest.columns.index(leaf_col), manifest.columns.index("proof")], [*manifest.columns, "folded_root"]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        roots = [fold(leaf, proof) for leaf, proof in zip(*(b.column(i).to_pylist() for i in at))]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(roots, pa.string())], names=names)

    return map_batches(manifest, run, ", ".join([*[f"`{c}` {t}" for c, t in manifest.dtypes], "folded_root string"]))
