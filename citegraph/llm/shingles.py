"""Words and word shingles of whole texts as 64-bit hashes.

Words are the runs of characters other than ASCII white space (``[^\\x20\\x09-\\x0D]+``)
after lower-casing A-Z only; other letters keep their case, so that the rule is
the same in Python, SQL and on any JVM locale.  A text with fewer words than a
shingle has one shingle, its whole word sequence; a text without words (or a
null text) has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: words whose hashes a process keeps, about 15 MB
KNOWN = 1 << 17


def words_of(text: str | None) -> list[bytes]:
    """The lower-cased words, in order (bytes methods treat ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class _Hashes(dict):
    """Hashes of words met before; at most `KNOWN` are kept."""

    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh64_intdigest(word)
        if len(self) < KNOWN and len(word) <= 32:
            self[word] = out
        return out


_known = _Hashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads combined hashes over the whole range."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    x ^= x >> np.uint64(31)
    return x


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams of a sequence of word hashes, in order (none if it is shorter)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(m, n, np.uint64)
    for j in range(n):
        acc = mix(acc * _STEP + h[j : j + m])
    return acc


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word shingles in order; the whole sequence where it is shorter than k."""
    return ngram_hashes(h, min(k, len(h))) if len(h) else np.empty(0, np.uint64)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct k-word shingles of a text."""
    return shingle_sets([text], k)[0]


def shingle_sets(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(flat, starts): the sorted distinct k-word shingles of text i are ``flat[starts[i]:starts[i + 1]]``."""
    hashed = [hash_words(words_of(t)) for t in texts]
    n = np.fromiter(map(len, hashed), np.int64, len(hashed))
    h, first = np.concatenate(hashed) if hashed else np.empty(0, np.uint64), np.cumsum(n) - n
    grams = ngram_hashes(h, k)  # those that begin in one text and end in the next are not read
    sets = [grams[a : a + m - k + 1] if m >= k else shingles(h[a : a + m], k) for a, m in zip(first.tolist(), n.tolist())]
    for s in sets:
        s.sort()  # no shingle lies in two texts' parts
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    count = np.fromiter(map(len, sets), np.int64, len(sets))
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[(np.cumsum(count) - count)[count > 0]] = True
    return flat[new], np.concatenate(([0], np.cumsum(new)))[np.concatenate(([0], np.cumsum(count)))]
