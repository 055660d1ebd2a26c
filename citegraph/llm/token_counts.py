"""Operator 12: token counts by compiling the tokenizer into finite-state transducers.

Two deterministic transducers in a row stand for the tokenizer file:

* The *segmenter* reads character classes and marks where words start (letter runs, single digits, runs of other signs,
  contractions behind an apostrophe).  It has seven states.  The text is cut into chunks of `CHUNK` characters that are
  read side by side: every chunk's *state map* (the exit state for each entering state) is found without its
  predecessors, the maps are composed by a parallel prefix scan, and with the entering states known all chunks emit
  their marks side by side.
* The *merger* reads a word's bytes and each of its transitions carries the number of tokens that the byte adds
  (negative where it joins tokens).  A sequence of tokens is what byte-pair merging gives if and only if this holds for each two
  neighbours, so the last token of every prefix of a word is the one vocabulary entry that fits behind the prefix
  before it.  A state is the longest end of the prefix that can still begin an entry, with the last token and relative
  count at each of its positions: finitely many, compiled when they are first reached.

Words recur, so that a word's count is remembered; the library's tokenizer itself never runs on a text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import short_batches, text_runs, tidy

#: characters of a chunk, and bytes of text that are worked on at once
CHUNK, RUN_BYTES = 256, 2 << 20
#: characters of a text that are handed to a worker as one piece (pieces end at white space; a longer run without any is whole)
PIECE = 1 << 16
#: words whose counts are remembered, merger states, and the longest word remembered (bytes)
WORDS, MERGER_STATES, WORD_BYTES = 400_000, 400_000, 64

# ------------------------------------------------------------------ segmenter
#: states: nothing open, a letter run, a run of other signs, an apostrophe that starts a word, and one followed by r, v, l
START, LETTERS, SIGNS, APOSTROPHE, APOSTROPHE_R, APOSTROPHE_V, APOSTROPHE_L = range(7)
STATES = 7
#: character classes: the letters that occur in contractions are classes of their own
SPACE, LETTER, DIGIT, SIGN, QUOTE = range(5)
_SPECIAL = {c: 5 + i for i, c in enumerate("stmdrevl")}
CLASSES = 5 + len(_SPECIAL)
#: marks of a transition: a word starts at this character, at the one before
HERE, BEFORE = 1, 2


def segmenter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and mark, indexed by ``state * CLASSES + class``.  The rule is the vocabulary's own (fixed value):
    ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+``."""
    to, mark = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    fresh = [START, LETTERS, START, SIGNS, APOSTROPHE] + [LETTERS] * len(_SPECIAL)  # a word starts with this class
    for state in range(STATES):
        for c in range(CLASSES):
            to[state, c], mark[state, c] = fresh[c], HERE
    letters = [LETTER, *_SPECIAL.values()]
    mark[LETTERS, letters] = 0
    for c in (SIGN, QUOTE):
        to[[SIGNS, APOSTROPHE], c], mark[[SIGNS, APOSTROPHE], c] = SIGNS, 0
    for c in "stmd":  # the contraction ends here
        to[APOSTROPHE, _SPECIAL[c]], mark[APOSTROPHE, _SPECIAL[c]] = START, 0
    for state, first, second in ((APOSTROPHE_R, "r", "e"), (APOSTROPHE_V, "v", "e"), (APOSTROPHE_L, "l", "l")):
        to[APOSTROPHE, _SPECIAL[first]], mark[APOSTROPHE, _SPECIAL[first]] = state, 0
        mark[state] |= BEFORE  # no contraction: the letter behind the apostrophe starts a word
        mark[state, letters] = BEFORE  # and goes on
        to[state, _SPECIAL[second]], mark[state, _SPECIAL[second]] = START, 0
    return to.ravel(), mark.ravel()


_TO, _MARK = segmenter()


def state_maps(chunks: np.ndarray) -> np.ndarray:
    """(chunk, entering state) -> exit state, for classes laid out as (position, chunk)."""
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks.shape[1], 1))
    for c in chunks:
        maps = _TO[maps * np.uint8(CLASSES) + c[:, None]]
    return maps


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Row k: the composition of the maps 0..k, in log2(rows) steps."""
    scan, d = maps.copy(), 1
    while d < len(scan):
        scan[d:] = np.take_along_axis(scan[d:], scan[:-d].astype(np.intp), axis=1)
        d *= 2
    return scan


def word_starts(classes: np.ndarray) -> np.ndarray:
    """Whether a word (or a white-space character) starts at each character of a text that ends with white space."""
    rows = -(-len(classes) // CHUNK)
    chunks = np.full(rows * CHUNK, SPACE, np.uint8)
    chunks[: len(classes)] = classes
    chunks = np.ascontiguousarray(chunks.reshape(rows, CHUNK).T)
    state = np.zeros(rows, np.uint8)
    state[1:] = prefix_scan(state_maps(chunks))[:-1, START]
    marks = np.empty_like(chunks)
    for j, c in enumerate(chunks):
        code = state * np.uint8(CLASSES) + c
        marks[j], state = _MARK[code], _TO[code]
    marks = marks.T.reshape(-1)[: len(classes)]
    starts = marks & HERE != 0
    starts[:-1] |= marks[1:] & BEFORE != 0
    return starts


# ------------------------------------------------------------------ merger
class Merger:
    """Tokens of words under byte-pair merging, as a transducer that is compiled as it is used."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves (fixed values); the rest follow from 256
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        byte_of = {c: b for b, c in shown.items()}

        def spelled(token: str) -> bytes | None:
            return bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else None

        self.inner: dict[bytes, int] = {}  # entries within a word
        self.final: dict[bytes, int] = {}  # entries that end a word
        for token, i in vocab.items():
            ends = token.endswith(suffix)
            if (text := spelled(token.removesuffix(suffix))) is not None and text:
                (self.final if ends else self.inner)[text] = i
        pairs = [m if isinstance(m, (list, tuple)) else m.split(" ") for m in merges]
        self.joins = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.symbols = {i: [self.inner[text[j : j + 1]] for j in range(len(text))] for text, i in self.inner.items()}
        self.symbols |= {i: [*(self.inner[text[j : j + 1]] for j in range(len(text) - 1)), self.final[text[-1:]]] for text, i in self.final.items()}
        self.prefixes = {text[:j] for entries in (self.inner, self.final) for text in entries for j in range(1, len(text))} | {b""}
        self._forget()

    def _forget(self):
        start = (b"", ((-1, 0),))
        self.states, self.number = [start], {start: 0}
        self.next: list[dict[int, tuple[int, int]]] = [{}]
        self.last: list[dict[int, int]] = [{}]
        self.fits: dict[tuple[int, int], bool] = {}

    def merged(self, ids: list[int]) -> list[int]:
        """The merging itself: the pair of the lowest rank first."""
        ids = list(ids)
        while True:
            found = [(self.joins[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.joins]
            if not found:
                return ids
            (_, new), i = min(found, key=lambda x: (x[0][0], x[1]))
            ids[i : i + 2] = [new]

    def _fit(self, before: int, token: int) -> bool:
        """Whether `token` stays behind `before` (-1: at the start of a word)."""
        key = before, token
        if key not in self.fits:
            whole = self.symbols[token] if before < 0 else self.symbols[before] + self.symbols[token]
            self.fits[key] = self.merged(whole) == ([token] if before < 0 else [before, token])
        return self.fits[key]

    def _append(self, state: int, byte: bytes, entries: dict[bytes, int]) -> tuple[int, int]:
        """(last token, tokens added) when `byte` follows."""
        text, ends = self.states[state]
        for at, end in enumerate(ends):
            if end and (token := entries.get(text[at:] + byte)) is not None and self._fit(end[0], token):
                return token, end[1] + 1
        raise ValueError("the vocabulary lacks an entry for a byte")

    def _step(self, state: int, b: int) -> tuple[int, int]:
        byte = bytes((b,))
        token, added = self._append(state, byte, self.inner)
        text, ends = self.states[state]
        text, ends = text + byte, [*((e[0], e[1] - added) if e else None for e in ends), (token, 0)]
        first = next(i for i in range(len(text) + 1) if text[i:] in self.prefixes)
        new = (text[first:], tuple(e if text[first + i :] in self.prefixes else None for i, e in enumerate(ends[first:])))
        if new not in self.number:
            self.number[new] = len(self.states)
            self.states.append(new)
            self.next.append({})
            self.last.append({})
        out = self.next[state][b] = self.number[new], added
        return out

    def count(self, word: bytes) -> int:
        """Tokens of a word (at least one byte)."""
        if len(self.states) > MERGER_STATES:
            self._forget()
        state = n = 0
        table = self.next
        for b in word[:-1]:
            state, added = table[state].get(b) or self._step(state, b)
            n += added
        b = word[-1]
        if (added := self.last[state].get(b)) is None:
            added = self.last[state][b] = self._append(state, bytes((b,)), self.final)[1]
        return n + added


# ------------------------------------------------------------------ whole texts
class _Lazy(dict):
    """A table whose entries are computed when first asked for."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        self[key] = out = self.make(key)
        return out


class Counter:
    """Token counts of texts under the tokenizer file at `path`: a word-level byte-pair vocabulary with a suffix at word
    ends, lower case, white space dropped.  What single characters are (their lower case, letters, digits, white
    space) is asked of the file's own rules once a character."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, rules = spec["model"], json.dumps(spec["pre_tokenizer"])
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" not in rules:
            raise ValueError(f"{path}: not a byte-pair vocabulary with word ends and these word rules")
        self.merger = Merger(model["vocab"], model["merges"], model["end_of_word_suffix"])
        tokenizer = Tokenizer.from_file(path)
        normal, cut = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.lead = special[0][:2] if special else ""  # all of them start alike
        self.lower = _Lazy(lambda c: normal(chr(c)))

        def kind(c: int) -> int:
            ch = chr(c)
            if ch in _SPECIAL:
                return _SPECIAL[ch]
            if ch == "'":
                return QUOTE
            pieces = [b - a for _, (a, b) in cut(f"a{ch}{ch}!")]  # which neighbours it joins
            return {(3, 1): LETTER, (1, 1, 1, 1): DIGIT, (1, 3): SIGN, (1, 1): SPACE}[tuple(pieces)]

        self.kind = kind
        self.kinds = np.full(0x110000, 255, np.uint8)
        self.words: dict[bytes, int] = {}

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        return (text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)).translate(self.lower)

    def _word(self, word: bytes) -> int:
        if word.isspace() and self.kinds[ord(word.decode())] == SPACE:
            return 0
        return self.merger.count(word)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        pieces, owner = [], []
        for i, text in enumerate(texts):
            parts = [text]
            if self.special and self.lead in text:
                parts = self.special.split(text)
                out[i] += len(parts) // 2  # every other part is a special string: one token
            for part in parts[::2]:
                pieces.append(self._normal(part))
                owner.append(i)
        whole = "\n".join([*pieces, ""])
        if not whole:
            return out
        chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds[chars]
        if (unknown := kinds == 255).any():
            for c in np.unique(chars[unknown]).tolist():
                self.kinds[c] = self.kind(c)
            kinds = self.kinds[chars]
        starts = np.flatnonzero(word_starts(kinds))
        data = whole.encode("utf-8", "surrogatepass")
        if len(data) == len(chars):
            at = starts
        else:
            width = 1 + (chars >= 0x80).astype(np.int8) + (chars >= 0x800) + (chars >= 0x10000)
            at = (np.cumsum(width, dtype=np.int64) - width)[starts]
        offsets = np.append(at, len(data)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        if len(self.words) > WORDS:
            self.words.clear()
        known, sizes = self.words, []
        for w in words.dictionary.to_pylist():
            if (n := known.get(w)) is None:
                n = self._word(w)
                if len(w) <= WORD_BYTES:
                    known[w] = n
            sizes.append(n)
        # the words of a piece run up to the line end behind it
        total = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64)[words.indices.to_numpy()])))
        ends = np.cumsum([len(p) + 1 for p in pieces])
        upto = total[np.searchsorted(starts, ends)]
        np.add.at(out, owner, np.diff(upto, prepend=0))
        return out


@lru_cache(maxsize=2)
def kept_counter(path: str) -> Counter:
    """The Python worker's counter, for its later tasks."""
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: `id_col`, n_bytes (of the text in UTF-8), n_tokens.

    Null and empty texts have no token.  Repeated rows and rows that share an id are counted each, rows with a null id
    too.  Strings of special tokens within texts count one, as the library's default has it.  A long text travels in
    pieces that end at white space, so a worker holds a few megabytes, or one run without white space.  No shuffle:
    the pieces of a row follow each other.  Columns that are not named are not read; an empty table gives no rows.
    `tokenizer_path` must name a file that every executor has."""
    short_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    parts = F.when(F.octet_length("text") <= PIECE, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE - 1}}}[ \t\r\n]|[^ \t\r\n]++"), F.lit(0)))
    rows = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.posexplode(parts).alias("pos", "part"))

    def run(batches):
        counter = kept_counter(tokenizer_path)
        ids, sizes, counts = [], [], []  # of the row whose pieces still come

        def out(last: int):
            rows = [ids[:last], sizes[:last], counts[:last]]
            del ids[:last], sizes[:last], counts[:last]
            return pa.RecordBatch.from_arrays([pa.array(rows[0], kind), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64())], names=["id", "n_bytes", "n_tokens"])

        kind = pa.null()
        for b in batches:
            kind = b.column(0).type
            found = []
            for part in text_runs(pc.binary_length(b.column(3)).to_pylist(), RUN_BYTES):
                texts = b.column(3).slice(part.start, len(part)).cast(pa.binary()).to_pylist()
                found += counter.counts([t.decode("utf-8", "replace") for t in texts]).tolist()
            for i, size, pos, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), found):
                if pos:
                    counts[-1] += n
                else:
                    ids.append(i)
                    sizes.append(size)
                    counts.append(n)
            if len(ids) > 1:
                yield out(len(ids) - 1)
        if ids:
            yield out(len(ids))

    done = rows.mapInArrow(tidy(run), f"id {dict(rows.dtypes)['id']}, n_bytes long, n_tokens long")
    return done.select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
