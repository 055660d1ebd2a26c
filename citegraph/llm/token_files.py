"""Operator 10: token ids in a patched frame-of-reference file format.

Documents are range-partitioned by id; a partition is a shard.  A shard's tasks write
segments (whole documents, about `SEGMENT_IDS` ids), each one binary value of a Parquet table
with the columns shard, segment, base (ids of the shard before the segment), n_ids and payload.

A payload is little-endian: the header (8 uint32: magic, version, documents, ids, block length,
blocks, packed uint64 words, exceptions), then

* int64 ids and uint32 token counts of the documents; a null id is flagged by a uint8 each
* the block index: uint32 first packed word and first exception of each block, and their ends
* per block a uint32 minimum and a uint8 width
* the packed words: of each id its distance to the block's minimum, in `width` bits
* exceptions: uint8 position in the block and uint32 distance

The width covers `PERCENTILE` % of a block's distances; larger ones are zero in the packed words
and stored as exceptions.  Any block can be decoded alone through the index.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegraph.llm.common import give_back, short_batches, stored, text_runs, tidy

BLOCK = 256
PERCENTILE = 95
SEGMENT_IDS = 1 << 17


class Memory(NamedTuple):
    """What an encoding worker may hold.  It changes neither ids nor files."""

    words: int  # words whose ids are remembered; beyond, those that have not recurred are forgotten
    run_bytes: int  # of texts encoded together (one text at least)
    kept: bool  # whether a worker keeps its encoder for its later tasks


#: for a job of its own, and for one of several jobs of an application, whose executors hold other things too
AMPLE, SPARING = Memory(500_000, 4_000_000, True), Memory(200_000, 2_000_000, False)
MAGIC, VERSION = 0x46505443, 1
SCHEMA = "shard int, segment int, base long, n_ids long, payload binary"


# ------------------------------------------------------------------ blocks
def pack(ids: np.ndarray) -> dict[str, np.ndarray]:
    """Blocks of a non-empty uint32 id array, as the arrays of a payload."""
    n = -(-len(ids) // BLOCK)
    padded = np.full(n * BLOCK, ids[-1], np.uint32)
    padded[: len(ids)] = ids
    grid = padded.reshape(n, BLOCK)
    low = grid.min(axis=1)
    grid = grid - low[:, None]
    kth = (BLOCK * PERCENTILE - 1) // 100
    width = np.ceil(np.log2(np.partition(grid, kth, axis=1)[:, kth].astype(np.float64) + 1)).astype(np.uint8)
    over = grid.astype(np.uint64) >> width.astype(np.uint64)[:, None] != 0
    row, col = np.nonzero(over)
    exceptions = grid[row, col]
    grid[row, col] = 0
    per_block = width.astype(np.int64) * (BLOCK // 64)
    first = np.concatenate(([0], np.cumsum(per_block)))
    words = np.zeros(first[-1], np.uint64)
    for w in np.unique(width[width > 0]):
        blocks = np.nonzero(width == w)[0]
        part = np.ascontiguousarray(grid[blocks].T).astype(np.uint64)
        out = np.zeros((per_block[blocks[0]], len(blocks)), np.uint64)
        for i in range(BLOCK):
            at, shift = divmod(i * int(w), 64)
            out[at] |= part[i] << np.uint64(shift)
            if shift + int(w) > 64:
                out[at + 1] |= part[i] >> np.uint64(64 - shift)
        words[(first[blocks][:, None] + np.arange(len(out))).ravel()] = out.T.ravel()
    first_exception = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n))))
    return {
        "first_word": first.astype("<u4"), "first_exception": first_exception.astype("<u4"), "low": low.astype("<u4"), "width": width,
        "words": words.astype("<u8"), "position": col.astype(np.uint8), "distance": exceptions.astype("<u4"),
    }


def unpack(p: dict[str, np.ndarray], start: int, stop: int) -> np.ndarray:
    """The ids of blocks start..stop-1, read through the block index."""
    width, low = p["width"][start:stop], p["low"][start:stop]
    first = p["first_word"][start:stop].astype(np.int64)
    grid = np.zeros((stop - start, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        blocks = np.nonzero(width == w)[0]
        n = int(w) * (BLOCK // 64)
        part = np.ascontiguousarray(p["words"][first[blocks][:, None] + np.arange(n)].T)
        out = np.empty((BLOCK, len(blocks)), np.uint32)
        mask = np.uint64((1 << int(w)) - 1)
        for i in range(BLOCK):
            at, shift = divmod(i * int(w), 64)
            x = part[at] >> np.uint64(shift)
            if shift + int(w) > 64:
                x = x | (part[at + 1] << np.uint64(64 - shift))
            out[i] = x & mask
        grid[blocks] = out.T
    ends = p["first_exception"][start : stop + 1].astype(np.int64)
    row = np.repeat(np.arange(stop - start), np.diff(ends))
    grid[row, p["position"][ends[0] : ends[-1]]] = p["distance"][ends[0] : ends[-1]]
    return (grid + low[:, None]).ravel()


# ------------------------------------------------------------------ segments
def write_segment(docs: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    """One payload.  Every document has one id at least, so there is a block."""
    p = pack(ids)
    head = np.array([MAGIC, VERSION, len(docs), len(ids), BLOCK, len(p["low"]), len(p["words"]), len(p["position"])], "<u4")
    null = np.array([d is None for d in docs], np.uint8)
    parts = [head, np.array([d or 0 for d in docs], "<i8"), np.array(counts, "<u4"), null, *p.values()]
    return b"".join(x.tobytes() for x in parts)


def open_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, int, dict[str, np.ndarray]]:
    """(document ids, token counts, number of ids, block arrays) of a payload."""
    head = np.frombuffer(payload, "<u4", 8)
    if head[0] != MAGIC or head[1] != VERSION or head[4] != BLOCK:
        raise ValueError("not a token segment of this version")
    docs, n_ids, blocks, words, exceptions = (int(head[i]) for i in (2, 3, 5, 6, 7))
    at, out = 32, []
    for kind, n in (("<i8", docs), ("<u4", docs), ("u1", docs), ("<u4", blocks + 1), ("<u4", blocks + 1), ("<u4", blocks), ("u1", blocks), ("<u8", words), ("u1", exceptions), ("<u4", exceptions)):
        out.append(np.frombuffer(payload, kind, n, at))
        at += out[-1].nbytes
    names = ("first_word", "first_exception", "low", "width", "words", "position", "distance")
    return [None if x else int(d) for d, x in zip(out[0], out[2])], out[1], n_ids, dict(zip(names, out[3:]))


def read_ids(payload: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start..stop-1 of a segment; only the blocks that hold them are decoded."""
    _, _, n, p = open_segment(payload)
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.empty(0, np.uint32)
    b = start // BLOCK
    return unpack(p, b, -(-stop // BLOCK))[start - b * BLOCK : stop - b * BLOCK]


# ------------------------------------------------------------------ encoding
#: signs, none of which starts a rule of its own
_SIGNS = b"!#$%&()*+,-./:;=?@[]^_`{|}~"
#: words of Latin letters with case, and with visible ASCII: their normal form and lower case are the same in Python
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: the vocabulary's rule (fixed by its file) for the pieces of such a word, in lower case
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class Encoder:
    """Ids of whole texts, word by word.  The vocabulary's tokenizer drops white space and never
    joins across it, so the ids of a text are those of its white-space-separated words in turn;
    a word's ids are computed by the tokenizers library and remembered while the word recurs."""

    def __init__(self, path: str, most: int = AMPLE.words):
        from tokenizers import Tokenizer, pre_tokenizers

        self.most = most
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, int] = {}
        self.flat, self.first, self.size, self.uses = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        # The vocabulary's model sees a word's pieces as printable characters for their bytes.
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.printable = {c: byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(0xA1, 0x100)}

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each).  Words of plain Latin letters, digits and signs are cut as the
        vocabulary's rules cut them and go to its model directly; others go through all its steps."""
        cut, whole, signs = self.tokenizer.model.tokenize, self.tokenizer.encode, {}
        ids, ends = array("I"), []
        for w in words:
            core = w.rstrip(_SIGNS)
            text = core.decode("utf-8", "replace")
            if _LETTERS.fullmatch(text):  # with signs behind them
                text = text.lower()
                ids.extend([t.id for t in cut(text if text.isascii() else text.translate(self.printable))])
                if len(core) < len(w):
                    if (end := w[len(core) :]) not in signs:
                        signs[end] = [t.id for t in cut(end.decode("ascii"))]
                    ids.extend(signs[end])
            else:
                text = w.decode("utf-8", "replace")
                if _PLAIN.fullmatch(text) and "<|" not in text:
                    for x in _PIECES.findall(text.lower()):
                        ids.extend([t.id for t in cut(x if x.isascii() else x.translate(self.printable))])
                else:
                    ids.extend(whole(text, add_special_tokens=False).ids)
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(np.array(ends, np.int64), prepend=0)

    def _forget(self):
        """Keep the words that have recurred since they were learned."""
        keep = np.flatnonzero(self.uses > 1)
        if len(keep) > self.most // 2:
            keep = np.sort(keep[np.argsort(-self.uses[keep], kind="stable")[: self.most // 2]])
        words = list(self.known)
        self.known = {words[i]: n for n, i in enumerate(keep.tolist())}
        size, first = self.size[keep], self.first[keep]
        ends = np.cumsum(size)
        self.flat = self.flat[np.repeat(first - ends + size, size) + np.arange(size.sum())]
        self.first, self.size, self.uses = ends - size, size, np.zeros(len(keep), np.int64)

    def _learn(self, words: list[bytes]):
        ids, size = self._ids(words)
        self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(size) - size))
        self.size, self.uses = np.concatenate((self.size, size)), np.concatenate((self.uses, np.zeros(len(size), np.int64)))
        self.flat = np.concatenate((self.flat, ids))
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))

    def encode(self, texts: pa.Array, end_id: int) -> list[np.ndarray]:
        """The ids of each text of a string array and its end id; a null text is empty."""
        texts = texts.fill_null("")
        data = b"".join(x.to_pybytes() for x in texts.buffers()[2:] if x)
        # else a mark might join a small letter only, or a control token come about, which has small letters in the text itself
        if b"\xcc" not in data and b"\xcd" not in data and b"<|" not in data:
            texts = pc.ascii_lower(texts)
        words = pc.ascii_split_whitespace(texts)
        flat = words.flatten().dictionary_encode()
        distinct = flat.dictionary.cast(pa.binary()).to_pylist()
        if len(self.known) > self.most:
            self._forget()
        place = np.fromiter((self.known.get(w, -1) for w in distinct), np.int64, len(distinct))
        if len(new := np.flatnonzero(place < 0)):
            place[new] = np.arange(len(self.known), len(self.known) + len(new))
            self._learn([distinct[i] for i in new.tolist()])
        at = flat.indices.to_numpy().astype(np.int64)
        self.uses[place] += np.bincount(at, minlength=len(place))
        at = place[at]
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.first[at] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        ends = np.concatenate(([0], ends))[np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))] if len(words) else []
        return [np.append(ids[a:b], np.uint32(end_id)) for a, b in zip(np.concatenate(([0], ends[:-1])).astype(np.int64), ends)] if len(words) else []


@lru_cache(maxsize=2)
def kept_encoder(path: str, most: int) -> Encoder:
    """The Python worker's encoder, for its later tasks."""
    return Encoder(path, most)


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", memory: Memory = AMPLE) -> DataFrame:
    """The segment table of all rows of `docs` in ascending id order (nulls first; rows with one id by a hash of
    their text), not yet written.  `tokenizer_path` must name a file that every executor has, of a
    tokenizer that parts words at white space and drops it."""
    short_batches(docs.sparkSession)
    cols = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ranged = cols.repartitionByRange("id").withColumn("tie", F.xxhash64("text")).sortWithinPartitions("id", "tie").select("id", "text")

    def segments_of(batches):
        make = kept_encoder if memory.kept else Encoder
        encoder, shard = make(tokenizer_path, memory.words), TaskContext.get().partitionId()
        segment = base = held = 0
        ids: list[np.ndarray] = []
        names: list[int | None] = []

        def flush():
            whole = np.concatenate(ids)
            row = [[shard], [segment], [base], [len(whole)], [write_segment(names, [len(x) for x in ids], whole)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["shard", "segment", "base", "n_ids", "payload"]), len(whole)

        for b in batches:
            for part in text_runs(pc.binary_length(b.column(1)).fill_null(0).to_pylist(), memory.run_bytes):
                rows = b.slice(part.start, len(part))
                for name, x in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1), end_id)):
                    ids.append(x)
                    names.append(name)
                    held += len(x)
                    if held >= SEGMENT_IDS:
                        out, n = flush()
                        yield out
                        ids, names, held, segment, base = [], [], 0, segment + 1, base + n
        if ids:
            yield flush()[0]

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.disable()  # words and ids hold no cycles, but are many
        try:
            yield from segments_of(batches)
        finally:
            gc.enable()
            gc.collect()
            give_back()

    return ranged.mapInArrow(run, SCHEMA)


def token_index(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of a written segment table, decoded from its payloads: `id_col`, start (ids of all documents before
    it), n_tokens and ids_crc32 (of its ids as little-endian uint32)."""

    def run(batches):
        for b in batches:
            for shard, base, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                docs, counts, n, p = open_segment(payload.as_py())
                ids = unpack(p, 0, len(p["low"]))[:n].astype("<u4")
                ends = np.cumsum(counts, dtype=np.int64)
                crc = [zlib.crc32(ids[e - c : e]) for e, c in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(docs), shard, np.int32)), pa.array(docs, pa.int64()), pa.array(base + ends - counts, pa.int64()), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())],
                    names=["shard", "id", "at", "n_tokens", "ids_crc32"],
                )

    # one row per shard (a partition each): their running total is a small window
    sums = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = segments.select("shard", "base", "payload").mapInArrow(tidy(run), "shard int, id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(shards, "shard").select(F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", memory: Memory = AMPLE) -> DataFrame:
    """Write the token ids of all rows of `docs` to the shared scratch folder and return what the files hold, one row
    per row of `docs`: `id_col`, start, n_tokens (with the end id), ids_crc32.

    Null and empty texts have the end id only; whole texts are encoded.  Repeated rows are documents of
    their own, next to each other; rows with a null id come first.  Further columns are not read; an empty table gives no rows.
    """
    return token_index(stored(encode_documents(docs, tokenizer_path, end_id, id_col, text_col, memory), "tokens"), id_col)
