"""Phrases of a batch of queries, sought in documents side by side.

A phrase is its words at their offsets.  The batch's phrases form a trie: a node is a run of first words, and a step leads on by
the distance to the next word and that word.  A task walks the trie over all places of its documents at once, and a place is left
as soon as its words begin no phrase; so what is looked at grows with the documents and with what is found, not with phrases
times documents.  The trie is broadcast: a few numbers a word of the batch."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

#: documents whose places are walked at once
DOCS = 500


@dataclass
class Phrases:
    """``steps[m]``: by distance, the sorted codes (node times words, plus word) of the nodes' next words and where they lead;
    ``ends[m]``: (node, query), sorted by node, of the phrases that end there."""

    queries: pa.Array
    words: np.ndarray  # sorted hashes
    first: np.ndarray  # the node that each word begins, or -1
    span: int = 0
    steps: list[dict[int, tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)
    ends: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)


def trie(words: pa.Table) -> Phrases:
    """The trie of distinct rows (query_id, offset, hash of field and word)."""
    coded = words.column(0).combine_chunks().dictionary_encode()
    query, offset = coded.indices.to_numpy().astype(np.int64), words.column(1).to_numpy().astype(np.int64)
    known, rank = np.unique(words.column(2).to_numpy(), return_inverse=True)
    order = np.lexsort((rank, offset, query))
    query, offset, rank = query[order], offset[order], rank[order].astype(np.int64)
    start = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.empty(0, np.int64)
    count = np.diff(np.append(start, len(query)))
    out = Phrases(coded.dictionary, known, np.full(len(known), -1))
    if not len(start):
        return out
    out.span = int((offset[start + count - 1] - offset[start]).max()) + 1
    begins, node = np.unique(rank[start], return_inverse=True)
    out.first[begins] = np.arange(len(begins))
    for m in range(int(count.max())):
        if m:
            distance = offset[start + m] - offset[start + m - 1]
            both, node_next = np.unique(np.stack((distance, node * len(known) + rank[start + m])), axis=1, return_inverse=True)
            out.steps.append({int(d): (both[1, both[0] == d], np.flatnonzero(both[0] == d)) for d in np.unique(both[0])})
            node = node_next.reshape(-1)
        done = count == m + 1
        by = np.argsort(node[done], kind="stable")
        out.ends.append((node[done][by], query[start[done]][by]))
        start, count, node = start[~done], count[~done], node[~done]
    return out


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for all j from ``low[i]`` to ``high[i] - 1``."""
    n = high - low
    return np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def found(p: Phrases, doc: np.ndarray, position: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, document) numbers of the phrases that stand in documents, whose words (hashes) stand at positions; each once."""
    if not len(p.words) or not len(doc):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rank = np.minimum(np.searchsorted(p.words, word), len(p.words) - 1)
    asked = p.words[rank] == word
    doc, position, rank = doc[asked], position[asked].astype(np.int64), rank[asked]
    if not len(doc):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    stride = int(position.max()) + p.span + 1  # no phrase reaches into the next document
    place = doc * stride + position
    order = np.argsort(place, kind="stable")
    place, rank = place[order], rank[order]
    at = np.flatnonzero(p.first[rank] >= 0)
    node, where = p.first[rank[at]], place[at]
    out_q, out_d = [], []
    for m, (end, query) in enumerate(p.ends):
        i, j = _spread(np.searchsorted(end, node), np.searchsorted(end, node, "right"))
        out_q.append(query[j])
        out_d.append(where[i] // stride)
        if m == len(p.steps) or not len(node):
            break
        nodes, wheres = [], []
        for d, (codes, to) in p.steps[m].items():
            i, j = _spread(np.searchsorted(place, where + d), np.searchsorted(place, where + d, "right"))
            code = node[i] * len(p.words) + rank[j]
            k = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[k] == code
            nodes.append(to[k[hit]])
            wheres.append(place[j[hit]])
        node, where = np.concatenate(nodes), np.concatenate(wheres)
    pairs = np.unique(np.stack((np.concatenate(out_q), np.concatenate(out_d))), axis=1)
    return pairs[0], pairs[1]


def matcher(shared):
    """A ``mapInArrow`` function from (key, array<struct<hash, positions>>) to (query_id, key); ``shared`` broadcasts `Phrases`."""

    def run(batches):
        p = shared.value
        for whole in batches:
            for s in range(0, whole.num_rows, DOCS):
                b = whole.slice(s, DOCS)
                entries = b.column(1)
                each = entries.flatten()  # of this slice only
                ends = entries.value_lengths().to_numpy(zero_copy_only=False)
                hashes, positions = each.flatten()
                hashes = hashes.to_numpy(zero_copy_only=False)
                n = positions.value_lengths().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.repeat(np.arange(b.num_rows), ends), n)
                q, d = found(p, doc, positions.flatten().to_numpy(zero_copy_only=False), np.repeat(hashes, n))
                if len(q):
                    yield pa.RecordBatch.from_arrays([p.queries.take(pa.array(q)), b.column(0).take(pa.array(d))], names=["query_id", "key"])

    return run
