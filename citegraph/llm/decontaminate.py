"""Operator 8: benchmark decontamination by size-partitioned MinHash containment.

A document contains a test item if it holds at least `threshold` of the item's distinct
five-word shingles, wherever they stand; an item of fewer words is one shingle, its whole
word sequence, and is looked for among the document's shingles of that length.  Items are partitioned by size; in the
partition of items with up to ``u`` shingles an item's sketch is its
``floor((1 - threshold) u) + 1`` smallest shingle hashes.  A document with enough of an
item's shingles cannot miss all of its sketch, so every containing document is found however
long it is, and only documents that hold a hash of a sketch are verified, by the
exact share of the item's shingles.

The items are the stated query set: they are sent to all tasks in blocks of about
`BLOCK_SHINGLES`, and documents are neither shuffled nor exploded.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import map_batches, short_batches, stored
from citegraph.llm.shingles import hash_words, ngram_hashes, shingles

#: shingles of the items that are broadcast at a time (8 bytes each, and as much for owners)
BLOCK_SHINGLES = 2_000_000
#: bits, at least, of the table that tells most of a document's shingles from those of sketches; it has 16 to 32 places a hash
TABLE_BITS = 20

_SPACE = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))
_WIDE = re.compile("[\u0080-¿ -⁯　-〿]")


def plain_words(text: str | None) -> list[bytes]:
    """Words for matching: lower case, and anything but letters and digits (ASCII punctuation and controls,
    Latin-1 signs, general and CJK punctuation) only parts words.  A passage in capitals or
    with marks around its words is still the passage."""
    return _WIDE.sub(" ", text.lower()).encode("utf-8", "surrogatepass").translate(_SPACE).split() if text else []


def item_shingles(text: str | None, k: int) -> tuple[int, np.ndarray]:
    """(words of a shingle, sorted distinct shingle hashes); a text shorter than `k` words is one shingle."""
    words = hash_words(plain_words(text))
    return min(k, len(words)), np.unique(shingles(words, k))


def shingles_of_lengths(words: np.ndarray, lengths: list[int]) -> np.ndarray:
    """The hashes of a document's shingles of each of the lengths."""
    return np.concatenate([ngram_hashes(words, n) for n in lengths]) if lengths else np.empty(0, np.uint64)


class ItemIndex:
    """A block of items: sketches for the search, all shingles for the verification."""

    def __init__(self, sets: list[np.ndarray], threshold_pct: int):
        self.need = np.array([(threshold_pct * len(s) + 99) // 100 for s in sets], np.int64)
        sketch, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for i, s in enumerate(sets):
            upper = 1 << (len(s) - 1).bit_length()  # of the item's size partition
            part = s[: (100 - threshold_pct) * upper // 100 + 1]
            sketch.append(part)
            owner.append(np.full(len(part), i))
        sketch, owner = np.concatenate(sketch), np.concatenate(owner)
        order = np.argsort(sketch, kind="stable")
        self.sketch, self.owner, self.sets = sketch[order], owner[order], sets
        bits = max(TABLE_BITS, len(sketch).bit_length() + 4)
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[sketch >> self.shift] = True

    def contained(self, h: np.ndarray) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items that a document with shingle hashes `h` contains."""
        hits = h[self.table[h >> self.shift]]
        if not len(hits):
            return []
        lo, hi = np.searchsorted(self.sketch, hits), np.searchsorted(self.sketch, hits, "right")
        items = {int(i) for a, b in zip(lo[hi > lo], hi[hi > lo]) for i in self.owner[a:b]}
        if not items:
            return []
        doc, out = np.unique(h), []
        for i in sorted(items):
            at = np.minimum(np.searchsorted(doc, self.sets[i]), len(doc) - 1)
            n = int((doc[at] == self.sets[i]).sum())
            if n >= self.need[i]:
                out.append((i, n))
        return out


def contained_items(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", k: int = 5, threshold_pct: int = 80) -> DataFrame:
    """(doc id, item id, n_shared, n_item, containment): each item with at least `threshold_pct` % of its distinct
    `k`-word shingles in a document.

    Items that are null, empty or without words are contained in nothing; an item of fewer than `k` words is
    contained where its words follow each other at any place of a document.  Null and empty documents contain nothing; whole
    texts are searched.  Repeated rows of a document or item give one row per pair of ids, the one with the largest
    containment; null ids are paired like any other id.  Further columns are not read; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    short_batches(spark)

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        np.seterr(over="ignore")
        lengths, sets = zip(*(item_shingles(t.as_py(), k) for t in b.column(1)))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths, pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["item", "len", "sh"])

    item_rows = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    sets = stored(map_batches(item_rows, cut, "item long, len int, sh array<long>").where("size(sh) > 0").distinct(), "items")
    total = sets.agg(F.sum(F.size("sh"))).first()[0] or 0
    blocks = -(-total // BLOCK_SHINGLES)
    schema = f"`{id_col}` long, `{item_col}` long, n_shared long, n_item long"
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    found = spark.createDataFrame([], schema)
    for block in range(blocks):
        part = sets.where(F.pmod(F.xxhash64("sh"), F.lit(blocks)) == block).toArrow()
        item_ids, lengths = part["item"].to_pylist(), sorted(set(part["len"].to_pylist()))
        index = spark.sparkContext.broadcast(ItemIndex([np.sort(np.asarray(x, np.int64).view(np.uint64)) for x in part["sh"].to_pylist()], threshold_pct))

        def search(b: pa.RecordBatch, item_ids=item_ids, lengths=lengths, index=index) -> pa.RecordBatch:
            np.seterr(over="ignore")
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                h = shingles_of_lengths(hash_words(plain_words(text.as_py())), lengths)
                if len(h):
                    out += [(doc, item_ids[i], n, len(index.value.sets[i])) for i, n in index.value.contained(h)]
            cols = zip(*out) if out else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["d", "i", "n", "m"])

        found = found.union(map_batches(rows, search, schema))
    best = found.withColumn("containment", F.col("n_shared") / F.col("n_item")).groupBy(id_col, item_col)
    best = best.agg(F.max(F.struct("containment", "n_shared", "n_item")).alias("s"))
    return best.select(id_col, item_col, "s.n_shared", "s.n_item", "s.containment")
