import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citegraph.llm import token_files as T
from citegraph.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")
ENCODER = T.Encoder(PATH)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture()
def encoder():
    return ENCODER


def whole(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_words_give_the_ids_of_whole_texts(tokenizer, encoder):
    r = random.Random(1)
    parts = list("abcXYZ'sdltmrev019,.!?<|>é́ É　ÀßÿµªºŠš \t\n̈̌̈́JTj×÷½²İΣς漢字…\x1c\x85\x01\x00") + ["<|endoftext|>", "'s", "'re", "'LL", " ", " ", "  "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(3000)] + [None, "", " "]
    for i in range(0, len(texts), 100):
        got = encoder.encode(pa.array(texts[i : i + 100], pa.string()), 2)
        assert [x.tolist() for x in got] == [whole(tokenizer, t) for t in texts[i : i + 100]]


def test_only_small_letters_make_a_control_token(tokenizer, encoder):
    texts = ["<|ENDOFTEXT|>", "<|EndOfText|> The End", "a<|STARTOFTEXT|>B", "<|endoftext|>", "Plain Words", "x <| Y |> Z", None]
    for part in (texts, *([t] for t in texts)):
        assert [x.tolist() for x in encoder.encode(pa.array(part, pa.string()), 2)] == [whole(tokenizer, t) for t in part]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=8))
def test_any_text(texts):
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(PATH), ENCODER
    texts = [x.encode("utf-8", "ignore").decode() for x in texts]
    assert [x.tolist() for x in e.encode(pa.array(texts, pa.string()), 2)] == [whole(t, x) for x in texts]


def test_forgetting_changes_nothing(tokenizer):
    e, r = T.Encoder(PATH, most=20), random.Random(4)
    for _ in range(30):
        texts = [" ".join(f"w{r.randint(0, 60)}" for _ in range(12)) for _ in range(5)]
        assert [x.tolist() for x in e.encode(pa.array(texts), 2)] == [whole(tokenizer, t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 2**32 - 1)), min_size=1, max_size=1500), st.randoms())
def test_blocks_round_trip(ids, r):
    ids = np.array(ids, np.uint32)
    payload = T.write_segment([5], [len(ids)], ids)
    docs, counts, n, _ = T.open_segment(payload)
    assert (docs, counts.tolist(), n) == ([5], [len(ids)], len(ids))
    assert (T.read_ids(payload) == ids).all()
    a, b = sorted((r.randrange(len(ids) + 1), r.randrange(len(ids) + 1)))
    assert (T.read_ids(payload, a, b) == ids[a:b]).all()


def test_width_and_exceptions():
    ids = np.full(T.BLOCK, 1000, np.uint32) + np.arange(T.BLOCK, dtype=np.uint32) % 8
    ids[17] = 4_000_000_000
    p = T.pack(ids)
    assert p["width"].tolist() == [3] and p["position"].tolist() == [17] and p["low"].tolist() == [1000]
    assert len(p["words"]) == 3 * T.BLOCK // 64 and (T.unpack(p, 0, 1) == ids).all()
    with pytest.raises(ValueError):
        T.open_segment(b"\0" * 64)


def test_output_equals_direct_encoding(frame, tokenizer, texts, monkeypatch):
    monkeypatch.setattr(T, "SEGMENT_IDS", 200)
    rows = [(i * 3 - 5, t, "x") for i, t in enumerate(texts)]
    df = frame(rows, "doc_id long, text string, base string").repartition(7)
    got = {r.doc_id: r for r in T.token_output(df, PATH).collect()}
    assert got == {r.doc_id: r for r in T.token_output(df, PATH, memory=T.Memory(10, 50, False)).collect()}
    start = 0
    for i, t, _ in sorted(rows):
        ids = whole(tokenizer, t)
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(rows)


def test_repeated_and_null_ids_and_empty_table(frame):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "d"), (0, None)]
    got = T.token_output(frame(rows, "doc_id long, text string"), PATH).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 0, 1, 1, 1]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert T.token_output(frame([], "doc_id long, text string"), PATH).collect() == []
