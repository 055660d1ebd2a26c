import random
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citegraph.llm import token_counts as T
from citegraph.llm.queries import QUERIES, vocabulary

PATH = vocabulary("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@lru_cache
def counter():
    return T.Counter(PATH)


@lru_cache
def library():
    return Tokenizer.from_file(PATH)


def direct(texts):
    return [len(e.ids) for e in library().encode_batch(list(texts), add_special_tokens=False)]


PIECES = ["don't", "we'LL", "'rex", "'l", "''s", "!'s", "'ve", "'t'd'", "o'", "12", "½٣", "x1y2", "Größe", "ΣΑΣ", "İı", "ȩ́", "́", "中文字", "한국어", "😀👍🏽", " ", " ", " ", "\x1c", "\x85",
          "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", " ", "\n", "\t", "...", "--'", "​", "ﬁ", "ǅ", "a" * 300, "'" * 40, "zq" * 50]


def test_hostile_texts():
    r = random.Random(3)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    texts += ["", " ", "\n\n", "a" * 100_000, "qx" * 30_000, " ".join(PIECES) * 200]
    assert counter().counts(texts).tolist() == direct(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("'srtvelmd <|>")), max_size=40), min_size=1, max_size=8))
def test_any_text(texts):
    assert counter().counts(texts).tolist() == direct(texts)


def test_state_maps_compose():
    """The parallel scan enters each chunk in the state in which reading from the start does."""
    r = np.random.default_rng(5)
    classes = r.integers(0, T.CLASSES, 5000).astype(np.uint8)
    chunks = classes.reshape(-1, 50)
    state, entered = T.START, []
    for row in chunks:
        entered.append(state)
        for c in row:
            state = T._TO[state * T.CLASSES + c]
    scan = T.prefix_scan(T.state_maps(np.ascontiguousarray(chunks.T)))
    assert [T.START, *scan[:-1, T.START].tolist()] == [int(s) for s in entered]


def test_small_tables_and_chunks(monkeypatch):
    monkeypatch.setattr(T, "CHUNK", 3)
    monkeypatch.setattr(T, "MERGER_STATES", 20)
    monkeypatch.setattr(T, "WORDS", 5)
    r = random.Random(4)
    for _ in range(30):
        texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 6))) for _ in range(20)]
        assert counter().counts(texts).tolist() == direct(texts)


@pytest.mark.parametrize("piece", [T.PIECE, 7])
def test_documents(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(T, "PIECE", piece)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    rows = list(enumerate([*texts, None, "", "  \n", "long run " + "ab1'" * 40_000 + " end", " lead", "trail "]))
    rows += [(3, "again"), (3, "again"), (None, "no id, three words"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "pos", "part", "n_tokens", "n_bytes", "Doc")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op12_token_counts"](spark, str(tmp_path)).collect()), key=str)
    sizes = direct(t or "" for _, t in rows)
    assert got == sorted(((d, len((t or "").encode()), n, n > 2048) for (d, t), n in zip(rows, sizes)), key=str)


def test_empty_table(spark):
    assert T.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        T.Counter(vocabulary("byte_bpe_50k.json"))
