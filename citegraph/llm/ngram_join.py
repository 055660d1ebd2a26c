"""Operator 7: exact n-gram Jaccard self-join by vertical partitioning.

The global order of all shingles is the order of their 64-bit hashes; its fragments
are ranges of hash values.  Cutting every shingle set at the same values gives
segments, and each fragment can be worked on without the others:

1. *Candidates.*  Two sets with Jaccard >= t differ in at most ``D = (|A|+|B|)(1-t)/(1+t)``
   shingles.  The order is cut into ``F = D + 2`` fragments, so at least two
   fragments hold identical segments.  A set sends one key per non-empty segment
   (the hash of fragment and content); sets that share a key are candidates.  Only
   identical runs of neighbouring shingles meet, so a passage that many documents share
   does not bring them together, and no frequency cut is needed.  ``F`` belongs to a size
   class; a set near the lower end of its class also sends the keys of the class below.
   At most one segment pair can be empty on both sides unless a set has two
   empty segments, and such sets send keys for empty segments too: no link is lost.
2. *Filter.*  Each set carries the parities of its shingles in ``B`` cells.  Two parity
   vectors differ in at most as many cells as the sets differ in shingles, so a
   distance above ``D`` rules a pair out exactly.
3. *Counting.*  For the remaining pairs each fragment's overlap is counted on its own
   and the partial counts are summed per pair; the pair links if the sum says so.

Identical sets are one class from the start.  Inside a key's group no full set of pairs is
emitted: first each node is paired with one other only, the head of most of its groups (the smallest member, in later
rounds the first in another order), and verified links are contracted to components; then only pairs that lie in different
components are tried.  Small groups send pairs, which are merged before parities are attached, once a pair; members of large
groups carry folded parities and are compared in the task (before, each is tried with its nearest one there).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import discard, map_batches, short_batches, stored, text_runs, tidy, whole_row
from citegraph.llm.components import connected_components
from citegraph.llm.shingles import mix, shingle_set, shingle_sets

#: upper size of a class over its lower size
CLASS_RATIO = 1.5
#: fragments whose overlaps are counted separately
COUNT_FRAGMENTS = 8
#: rows of a large group that are compared with as many others at once
BLOCK = 512
#: members of a key's group that are compared in one task, and members of a head that are counted in one task
GROUP = 2048
#: rounds in which each node is paired with one head before pairs of different components are tried
ROUNDS = 3
#: halvings of the parities that members of a large group carry, and words (of 64 cells) that they keep at least
FOLDS, WORDS = 1, 8
#: characters whose sets are made at once
RUN_CHARS = 500_000
#: members of a key's group up to which its pairs are emitted before they are compared
SMALL = 32


def min_overlap(size_a, size_b, pct: int):
    """Smallest intersection with ``100 * intersection >= pct * union``."""
    return (pct * (size_a + size_b) + 99 + pct) // (100 + pct)


def max_difference(size_a, size_b, pct: int):
    """Largest symmetric difference of a linked pair (negative if the sizes rule it out)."""
    return size_a + size_b - 2 * min_overlap(size_a, size_b, pct)


@lru_cache(1 << 16)
def size_classes(n: int, pct: int) -> list[tuple[int, int, int]]:
    """(class, fragments, parity cells) under which a set of `n` shingles sends keys:
    its own class and, if a linked set can lie there, the one below."""
    out, k, low = [], 0, 1
    while True:
        high = max(low, int(low * CLASS_RATIO))
        if low <= n and n * pct <= high * 100:  # n in the class, or a visitor from the class above
            most = high * 100 // pct  # the larger set of a pair whose smaller one lies in the class
            d = (high + most) * (100 - pct) // (100 + pct)
            out.append((k, d + 2, 1 << max(6, (2 * most - 1).bit_length())))
        if low > n:
            return out
        k, low = k + 1, high + 1


def segments(s: np.ndarray, parts: int) -> np.ndarray:
    """Positions at which `parts` equal hash ranges cut the sorted set `s`."""
    return np.concatenate(([0], np.searchsorted(s, _bounds(parts)), [len(s)]))


@lru_cache(256)
def _bounds(parts: int) -> np.ndarray:
    return np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // parts)


@lru_cache(256)
def _places(size_class: int, parts: int) -> np.ndarray:
    return mix(np.arange(parts, dtype=np.uint64) + np.uint64(size_class * 1_000_003 + 1))


def segment_keys(s: np.ndarray, size_class: int, parts: int) -> np.ndarray:
    """One 64-bit key per fragment of one class: class, fragment and the segment's content."""
    cut = segments(s, parts)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(s), dtype=np.uint64)))
    size = (cut[1:] - cut[:-1]).astype(np.uint64)
    keys = mix(mix(sums[cut[1:]] - sums[cut[:-1]] + size) ^ _places(size_class, parts))
    return keys if (size == 0).sum() >= 2 else keys[size > 0]


def keys_and_parities(sets: list[np.ndarray], pct: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(keys, ends, parities) of non-empty sorted sets; set i has the keys from `ends[i]` to `ends[i + 1]`.

    A set has the keys (see ``segment_keys``) of each of its classes.  Bit j of its parity says whether an odd number of
    shingles falls into cell j.  All sets are worked on at once."""
    if not sets:
        return np.empty(0, np.uint64), np.zeros(1, np.int64), []
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])
    lows, highs, places, owner, cells = [], [], [], [], []
    for i, s in enumerate(sets):
        classes = size_classes(len(s), pct)
        cells.append(max(c for _, _, c in classes))
        for x, parts, _ in classes:
            cut = segments(s, parts) + starts[i]
            lows.append(cut[:-1])
            highs.append(cut[1:])
            places.append(_places(x, parts))
            owner.append(i)
    parts = np.fromiter(map(len, places), np.int64, len(places))
    low, high = np.concatenate(lows), np.concatenate(highs)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat), dtype=np.uint64)))
    size = (high - low).astype(np.uint64)
    keys = mix(mix(sums[high] - sums[low] + size) ^ np.concatenate(places))
    empty = np.add.reduceat((size == 0).astype(np.int64), np.cumsum(parts) - parts)
    kept = (size > 0) | np.repeat(empty >= 2, parts)
    ends = np.concatenate(([0], np.cumsum(np.bincount(np.repeat(owner, parts)[kept], minlength=len(sets)))))

    cells = np.array(cells)
    first = np.cumsum(cells) - cells
    count = np.diff(starts)
    cell = (mix(flat ^ np.uint64(0x5851F42D4C957F2D)) & np.repeat(cells - 1, count).astype(np.uint64)).astype(np.int64) + np.repeat(first, count)
    bits = np.packbits((np.bincount(cell, minlength=int(cells.sum())) & 1).astype(np.uint8)).tobytes()
    return keys[kept], ends, [bits[a // 8 : (a + c) // 8] for a, c in zip(first.tolist(), cells.tolist())]


def set_classes(flat: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """128-bit names of the shingle sets ``flat[starts[i]:starts[i + 1]]``."""
    out, n = np.zeros((len(starts) - 1, 2), np.uint64), np.diff(starts)
    some = np.flatnonzero(n)
    if len(some):
        out[some, 0] = np.bitwise_xor.reduceat(mix(flat + np.repeat(n, n).astype(np.uint64)), starts[some])
        out[some, 1] = np.add.reduceat(mix(mix(flat) ^ np.uint64(0xD6E8FEB86659FD93)), starts[some])
    return [x.tobytes() for x in out]


def set_class(s: np.ndarray) -> bytes:
    """128-bit name of a shingle set."""
    return set_classes(s, np.array([0, len(s)]))[0]


def node_of(cls: bytes) -> int:
    """64-bit number of a set's name (two of 10^9 sets share one with a chance of 3 %)."""
    return int(np.frombuffer(cls, np.int64)[0])


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, pct: int) -> DataFrame:
    """One pass over the whole texts: (doc, n, cls, node, keys, parity); keys and parity are
    null for sets that cannot link to another one, for rows with a null id, and for a set that the same task has sent
    before (with an id)."""

    def run(batches):
        seen: set[bytes] = set()  # 16 bytes a document of the task
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in text_runs([len(t) if t else 0 for t in texts], RUN_CHARS):
                flat, starts = shingle_sets([texts[i] for i in at], k)
                n = np.diff(starts)
                cls, doc = set_classes(flat, starts), b.column(0).slice(at.start, len(at))
                sent = []
                for i in np.flatnonzero(doc.is_valid().to_numpy(zero_copy_only=False) & (n > 0) & (max_difference(n, n + 1, pct) >= 1)).tolist():
                    if cls[i] not in seen:
                        seen.add(cls[i])
                        sent.append(i)
                own = np.full(len(at), -1)
                own[sent] = np.arange(len(sent))
                keys, ends, par = keys_and_parities([flat[starts[i] : starts[i + 1]] for i in sent], pct)
                count = np.zeros(len(at) + 1, np.int32)
                count[1:][sent] = np.diff(ends)
                keys = pa.ListArray.from_arrays(pa.array(np.cumsum(count, dtype=np.int32)), pa.array(keys.view(np.int64)), mask=pa.array(own < 0))
                par = pa.array([par[i] if i >= 0 else None for i in own.tolist()], pa.binary())
                node = np.frombuffer(b"".join(cls), np.int64)[::2]
                yield pa.RecordBatch.from_arrays([doc, pa.array(n), pa.array(cls, pa.binary()), pa.array(node), keys, par], names=["doc", "n", "cls", "node", "keys", "parity"])

    cols = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return cols.mapInArrow(tidy(run), "doc long, n long, cls binary, node long, keys array<long>, parity binary")


def _shared_keys(rows: DataFrame) -> DataFrame:
    """(key, node, head) of the keys that at least two nodes have; head is the smallest of them.  Rows arrive sorted by
    key and node; a task keeps one row back, whatever the size of a key's group."""

    def run(batches):
        last = None  # key, node and head of the last row, and whether it has been sent
        for b in batches:
            if not b.num_rows:
                continue
            key, node = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            if last is not None:
                key, node = np.concatenate(([last[0]], key)), np.concatenate(([last[1]], node))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])  # repeated rows once
            key, node = key[new], node[new]
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            at = np.flatnonzero(first)
            head = np.repeat(node[at], np.diff(np.append(at, len(key))))
            same = np.append(~first[1:], False)  # as the next row
            shared = same | ~first
            if last is not None:
                head[: at[1] if len(at) > 1 else len(key)] = last[2]
                shared[0] = shared[0] and not last[3]
            sent = bool(shared[-1]) or (last is not None and last[3] and len(key) == 1)
            last = key[-1], node[-1], head[-1], sent
            if shared.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[shared]) for x in (key, node, head)], names=["key", "node", "head"])

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(tidy(run), "key long, node long, head long")


def _folded(parity: list[bytes], width: np.ndarray) -> np.ndarray:
    """Parity vectors as rows of 64-bit words, row i folded to `width[i]` words (zeros behind).  Folding halves on
    halves keeps what parities say: they differ in at most as many cells as the sets differ in shingles."""
    size = np.fromiter(map(len, parity), np.int64, len(parity)) // 8
    out = np.zeros((len(parity), int(width.max())), np.uint64)
    for w, to in np.unique(np.stack((size, width), axis=1), axis=0):
        at = np.flatnonzero((size == w) & (width == to))
        words = np.frombuffer(b"".join([parity[i] for i in at]), np.uint64)
        out[at, :to] = np.bitwise_xor.reduce(words.reshape(len(at), w // to, to), axis=1)
    return out


def _pairs_of_group(comp, side, node, n, parity, pct: int, nearest: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Possible pairs (the smaller and the larger node) of different components in one large group, by blocks of rows
    against blocks of earlier rows; with `nearest`, of each larger node the pair whose parities differ least."""
    words = np.fromiter(map(len, parity), np.int64, len(parity)) // 8
    par, found = _folded(parity, np.full(len(parity), words.min())), []
    for i in range(0, len(node), BLOCK):
        least = np.full(min(BLOCK, len(node) - i), np.iinfo(np.int64).max)
        to = np.zeros(len(least), np.int64)
        for j in range(0, i + 1, BLOCK):
            x, y = slice(i, i + BLOCK), slice(j, j + BLOCK)
            need = max_difference(n[x][:, None], n[y][None, :], pct)
            ok = (need >= 0) & (node[x][:, None] > node[y][None, :]) & (comp[x][:, None] != comp[y][None, :])
            ok &= (side[x][:, None] < 0) | (side[x][:, None] != side[y][None, :])
            far = np.zeros(need.shape, np.int64)
            for w in range(par.shape[1]):
                far += np.bitwise_count(par[x, w][:, None] ^ par[y, w][None, :])
            ok &= far <= need
            if nearest:
                far[~ok] = np.iinfo(np.int64).max
                c = far.argmin(axis=1)
                closer = far[np.arange(len(c)), c] < least
                least[closer], to[closer] = far[closer, c[closer]], node[y][c[closer]]
            else:
                r, c = np.nonzero(ok)
                found.append((node[y][c], node[x][r]))
        if nearest:
            has = least < np.iinfo(np.int64).max
            found.append((to[has], node[i : i + BLOCK][has]))
    return found


def _groups(batches):
    """Tables of rows whose groups (equal first columns) are whole, for rows that arrive sorted."""
    kept: list[pa.RecordBatch] = []  # of the open group
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        start = int(np.searchsorted(key, key[-1]))  # of the last group, which may go on
        if kept and start == 0 and kept[0].column(0)[0].as_py() == key[-1]:
            kept.append(batch)
            continue
        if kept or start:
            yield pa.Table.from_batches([*kept, batch.slice(0, start)])
        kept = [batch.slice(start)]
    if kept:
        yield pa.Table.from_batches(kept)


def _starts(key: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))


def _few_pairs(rows: DataFrame) -> DataFrame:
    """The pairs (a, b), a < b, of different components within each small group of `rows` (key, node, comp)."""

    def run(batches):
        for part in _groups(batches):
            key, node, comp = (part.column(i).to_numpy() for i in range(3))
            starts = _starts(key)
            size = np.diff(starts)
            place, found = np.arange(len(key)) - np.repeat(starts[:-1], size), []
            for d in range(1, int(size.max())):  # rows d apart in one group
                y = np.flatnonzero(place >= d)
                y = y[comp[y] != comp[y - d]]
                found.append(np.stack((node[y - d], node[y]), axis=1))
            pairs = np.unique(np.concatenate([np.empty((0, 2), np.int64), *found]), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return rows.select("key", "node", "comp").repartition("key").sortWithinPartitions("key", "node").mapInArrow(tidy(run), "a long, b long").distinct()


def _plausible(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs that sizes and parities in `sets` (node, n, parity) allow."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n_a, n_b = b.column(2).to_numpy(), b.column(4).to_numpy()
        need, ok = max_difference(n_a, n_b, pct), np.zeros(b.num_rows, bool)
        par_a, par_b = b.column(3).to_pylist(), b.column(5).to_pylist()
        at = np.flatnonzero(need >= 0)
        if len(at):
            x, y = [par_a[i] for i in at], [par_b[i] for i in at]
            width = np.minimum(np.fromiter(map(len, x), np.int64, len(at)), np.fromiter(map(len, y), np.int64, len(at))) // 8
            ok[at] = np.bitwise_count(_folded(x, width) ^ _folded(y, width)).sum(axis=1) <= need[at]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    one, two = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("par_a")), sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("par_b"))
    return map_batches(pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "par_a", "n_b", "par_b"), run, "a long, b long")


def _many_pairs(rows: DataFrame, sets: DataFrame, pct: int, nearest: bool) -> DataFrame:
    """The possible pairs (a, b), a < b, of different components within each large group of `rows` (key, node, comp, count);
    with `nearest`, one for each member and task at most.

    Members carry their parities.  A group of more than `GROUP` members is split into blocks by a hash of the member, and
    pairs of blocks become groups of their own, so that no task holds more than about twice `GROUP` members at once."""

    def run(batches):
        for part in _groups(batches):
            key, comp, side, node, n = (part.column(i).to_numpy() for i in range(5))
            parity, starts = part.column(5).to_pylist(), _starts(key)
            for s in map(slice, starts[:-1], starts[1:]):
                pairs = np.concatenate([np.stack(p, axis=1) for p in _pairs_of_group(comp[s], side[s], node[s], n[s], parity[s], pct, nearest)])
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    blocks = F.ceil(F.col("count") / GROUP)
    dealt = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(
        F.when(F.col("blocks") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))).alias("key"), "comp",
        F.when(F.col("block") == F.col("other"), F.lit(-1)).otherwise(F.col("block")).cast("long").alias("side"), "node",
    )
    def folded(b: pa.RecordBatch) -> pa.RecordBatch:
        parity = [(p if p is None else _folded([p], np.array([max(min(WORDS, len(p) // 8), len(p) // 8 >> FOLDS)]))[0].tobytes()) for p in b.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(parity, pa.binary())], names=["node", "n", "parity"])

    short = map_batches(sets, folded, "node long, n long, parity binary")
    out = dealt.join(short, "node").select("key", "comp", "side", "node", "n", "parity").repartition("key").sortWithinPartitions("key", "node")
    return out.mapInArrow(tidy(run), "a long, b long").distinct()


def _heads(rest: DataFrame, turn: int) -> DataFrame:
    """(a, b): each node of `rest` (key, node, comp) with one node of another component, the head of most of its groups
    in the order of this turn."""
    first = rest.groupBy("key").agg(F.min_by(F.struct(F.col("node").alias("head"), F.col("comp").alias("head_comp")), F.xxhash64("node", F.lit(turn))).alias("h")).select("key", "h.*")
    asked = rest.join(first, "key").where("comp <> head_comp").groupBy("node", "head").count()
    best = asked.groupBy("node").agg(F.max_by("head", F.struct("count", -F.col("head"))).alias("head"))
    return best.select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, pct: int) -> DataFrame:
    """The pairs (a, b) that link: overlaps are counted fragment by fragment and summed per pair.

    Each set travels once for each pair that it is `b` of, and once for all pairs that it is `a` of; a head `a` of
    more than `GROUP` pairs is dealt over several tasks."""
    many = pairs.groupBy("a").count().where(F.col("count") > GROUP).select("a", F.ceil(F.col("count") / GROUP).alias("blocks"))
    dealt = pairs.join(many, "a", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("b"), F.col("blocks")), F.lit(0)))
    parts = dealt.select(F.col("b").alias("node"), F.col("a").alias("head"), "block").union(dealt.select(F.col("a").alias("node"), "a", "block").distinct())
    parts = stored(parts.join(reps.select("node", "doc"), "node"), "parts")
    ids = stored(parts.select("doc").distinct(), "verified")  # a short list is broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).join(ids, "doc", "left_semi")

    def cut(batches):
        np.seterr(over="ignore")
        last, sent = (None, None, None), set()
        for b in batches:
            head, block, frag, member, node, size, seg = [], [], [], [], [], [], []
            for text, i, h, part in zip(b.column(0).to_pylist(), *(b.column(j).to_pylist() for j in (1, 2, 3))):
                if text != last[0]:  # a text's parts often follow each other
                    s = shingle_set(text, k)
                    last, sent = (text, node_of(set_class(s)), s), set()
                if last[1] != i or (h, part) in sent:  # another text of a repeated id, or a repeated row
                    continue
                sent.add((h, part))
                at = segments(last[2], COUNT_FRAGMENTS)
                for f in range(COUNT_FRAGMENTS):
                    head.append(h)
                    block.append(part)
                    frag.append(f)
                    member.append(i != h)
                    node.append(i)
                    size.append(len(last[2]))
                    seg.append(last[2][at[f] : at[f + 1]].view(np.int64))
            columns = zip((head, block, frag, member, node, size, seg), (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=["head", "block", "fragment", "member", "node", "size", "seg"])

    def overlaps(batches):
        key, own, own_size, before = None, None, 0, None  # the head's segment, which comes before its members', and the row before
        for b in batches:
            if not b.num_rows:
                continue
            head, block, frag, node, size = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4, 5))
            member, ends, values = b.column(3).to_numpy(zero_copy_only=False), b.column(6).offsets.to_numpy(), b.column(6).values.to_numpy()
            out = []
            again = np.append(False, (head[1:] == head[:-1]) & (block[1:] == block[:-1]) & (frag[1:] == frag[:-1]) & (node[1:] == node[:-1]))
            again[0] = (head[0], block[0], frag[0], node[0]) == before  # a repeated row that lay in another task
            before = head[-1], block[-1], frag[-1], node[-1]
            starts = np.flatnonzero(np.concatenate(([True], (head[1:] != head[:-1]) | (block[1:] != block[:-1]) | (frag[1:] != frag[:-1]))))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows]):
                if (head[s], block[s], frag[s]) != key:
                    key = head[s], block[s], frag[s]
                    own, own_size = values[ends[s] : ends[s + 1]].view(np.uint64).copy(), int(size[s])
                while s < e and not member[s]:
                    s += 1
                if s < e:
                    theirs = values[ends[s] : ends[e]].view(np.uint64)
                    hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs if len(own) else np.zeros(len(theirs), bool)
                    part = np.diff(np.concatenate(([0], np.cumsum(hit)))[ends[s : e + 1] - ends[s]])
                    once = ~again[s:e]
                    out.append([x[once] for x in (np.full(e - s, key[0]), node[s:e], np.full(e - s, own_size), size[s:e], part)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], names=["a", "b", "size_a", "size_b", "part"])

    asked = texts.join(parts, "doc").select("text", "node", "head", "block").mapInArrow(tidy(cut), "head long, block long, fragment int, member boolean, node long, size long, seg array<long>")
    key = ("head", "block", "fragment")
    partial = asked.repartition(*key).sortWithinPartitions(*key, "member", "node").mapInArrow(tidy(overlaps), "a long, b long, size_a long, size_b long, part long")
    whole = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("part").alias("overlap"))
    return whole.where(f"100 * overlap >= {pct} * (size_a + size_b - overlap)").select("a", "b")


def ngram_jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, pct: int = 90) -> DataFrame:
    """One row per row of `docs`: `id_col`, n_shingles (size of its set of `k`-word shingles) and
    component_id, the smallest id reachable over links (100 * intersection >= `pct` * union), itself included.

    Null and empty texts and texts without words have an empty set and link with nothing; a text with fewer
    than `k` words has one shingle.  Repeated rows and texts with equal sets are linked copies.  Rows that share
    an id are one node, linked over any of their texts; rows with a null id link with nothing and get a null
    component.  Other columns of `docs`, whatever their names, are not read.  An empty table gives no rows.
    """
    short_batches(docs.sparkSession)
    wide = stored(signatures(docs, id_col, text_col, k, pct), "signatures")
    keys = wide.where("doc is not null and n > 0 and keys is not null").select(F.explode("keys").alias("key"), "node")
    shared = stored(_shared_keys(keys), "shared-keys")
    sig = stored(wide.drop("keys"), "sets")
    discard(wide)  # the keys that no other node has are most of it
    full = sig.where("doc is not null and n > 0")
    # classes of equal sets with one document each: partial aggregates, so a hot class is one row per task
    reps = full.groupBy("cls").agg(F.first("node").alias("node"), F.min("doc").alias("doc"), F.max(F.struct("n", "parity")).alias("s"))
    reps = stored(reps.select("cls", "node", "doc", "s.n", "s.parity"), "classes")
    sets = reps.select("node", "n", "parity")

    # each node with the head of most of its groups, in several orders
    first = shared.where("node <> head").groupBy("node", "head").count().groupBy("node").agg(F.max_by("head", F.struct("count", -F.col("head"))).alias("a"))
    tried = stored(_plausible(first.select("a", F.col("node").alias("b")), sets, pct), "pairs")
    links = stored(_verified(tried, reps, docs, id_col, text_col, k, pct), "links")
    left = shared
    for turn in range(1, ROUNDS + 2):
        comps = connected_components(links)
        joined = left.select("key", "node").join(comps, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
        mixed = joined.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("count")).where("lo < hi").select("key", "count")
        rest = stored(joined.join(mixed, "key"), "mixed")
        discard(left)
        left = rest
        if turn < ROUNDS:
            more = _heads(rest, turn)
        elif turn == ROUNDS:  # members of large groups with their nearest ones
            more = _many_pairs(rest.where(F.col("count") > SMALL), sets, pct, nearest=True)
        else:
            break
        more = stored(_plausible(more.join(tried, ["a", "b"], "left_anti"), sets, pct), "pairs")
        tried = tried.union(more)
        links = links.union(stored(_verified(more, reps, docs, id_col, text_col, k, pct), "links"))
    few = _few_pairs(rest.where(F.col("count") <= SMALL))
    many = _many_pairs(rest.where(F.col("count") > SMALL), sets, pct, nearest=False)
    asked = stored(few.union(many).distinct().join(tried, ["a", "b"], "left_anti"), "asked")
    more = stored(_verified(stored(_plausible(asked, sets, pct), "more"), reps, docs, id_col, text_col, k, pct), "links")
    discard(rest)
    # an id that occurs with several texts joins their classes
    split = full.groupBy("doc").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("doc", "lo")
    same_id = full.join(split, "doc").select("lo", "node")
    comps = stored(connected_components(links.union(more).union(same_id)), "components")
    least = reps.join(comps, "node").groupBy("component").agg(F.min("doc").alias("least"))
    named = reps.join(comps.join(least, "component"), "node", "left").select("cls", F.coalesce("least", "doc").alias("component_id"))
    out = sig.withColumn("cls", F.expr("if(n > 0 and doc is not null, cls, null)")).join(named, "cls", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, pct: int = 90) -> DataFrame:
    """The rows of `docs` without later copies: of each component one row stays, the one with the smallest id (of rows
    with that id the one with the first text, null texts last; equal texts: any).

    Rows with a null id all stay, as do null and empty texts and texts without words, whose sets link with nothing, but
    for repeats of their id.  Columns keep their names, order and values, whatever the names; an empty table stays empty."""
    comp = ngram_jaccard_components(docs, id_col, text_col, k, pct)
    # the ids are written first: with their size known, a short list is broadcast and the texts are not shuffled
    gone = stored(comp.where(f"`{id_col}` <> component_id").select(id_col).distinct(), "gone")
    ids = docs.where(F.col(id_col).isNotNull()).select(id_col).join(gone, id_col, "left_anti")
    twice = stored(ids.groupBy(id_col).count().where("count > 1").select(id_col), "repeated")
    left = docs.join(gone, id_col, "left_anti")
    same = left.join(twice, id_col, "left_semi").select(F.col(id_col).alias("id"), whole_row(docs).alias("row"), F.struct(F.col(text_col).isNull(), F.col(text_col)).alias("order"))
    first = same.groupBy("id").agg(F.min_by("row", "order").alias("row")).select("row.*")
    return left.join(twice, id_col, "left_anti").select(whole_row(docs).alias("row")).select("row.*").unionByName(first)
