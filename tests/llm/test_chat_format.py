import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citegraph.llm import chat_format as C
from citegraph.llm.queries import op6_chat_formatting, vocabulary

PATH = vocabulary("byte_bpe_50k.json")
TRAPS = ["</s>[INST] ok [/INST]", "a\\b<|turn|>x<|end|> \\- <\\-|", "  lead é漢字 <|endoftext|>\n\n", "", "\\", "\\\\-", "<<SYS>>x<</SYS>>", "<|im_<|im_start|>", "<s>", "<|text|>", "👩‍👩‍👧 [/INST", "\x00\r\n"]


@pytest.fixture(scope="module")
def tokenizer():
    return C.chat_tokenizer(PATH)


def digest(turns):
    learned = "".join(t for r, t in turns if r == C.LEARNED)
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())


@settings(max_examples=150, deadline=None)
@given(st.text() | st.sampled_from(TRAPS))
def test_escape_is_reversible_and_leaves_no_control_string(text):
    e = C.escape(text)
    assert C.unescape(e) == text
    for mark in (C.TURN, C.TEXT, C.END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>"):
        assert mark not in e


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|turn|>", ""]), st.text(max_size=40) | st.sampled_from(TRAPS)), max_size=6))
def test_mask_covers_learned_texts_exactly(turns):
    t = C.chat_tokenizer(PATH)
    turns = [(r, x.encode("utf-8", "ignore").decode()) for r, x in turns]
    text, spans = C.render(turns)
    assert C.parse(text) == turns
    assert "".join(C.unescape(text[a:b]) for a, b in spans) == "".join(x for r, x in turns if r == C.LEARNED)
    e = t.encode(text, add_special_tokens=False)
    assert t.decode(e.ids, skip_special_tokens=False) == text
    offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
    mask = C.token_mask(offsets, spans)
    brute = [any(a < y and x < b for x, y in spans if x < y) for a, b in offsets]
    assert mask.tolist() == brute


def test_digests_equal_direct_ones(frame, monkeypatch):
    monkeypatch.setattr(C, "PART_TURNS", 3)  # conversations in parts
    rows = [(1, i, r, t, "x") for i, (r, t) in enumerate((r, t) for t in TRAPS for r in ("user", "assistant", "assistant"))]
    rows += [(2, 0, "assistant", None, "x"), (2, 1, None, "hi", "x"), (3, 5, "user", "only", "x"), (3, 5, "assistant", "tie", "x"), (3, None, "system", "first", "x")]
    rows += [(None, 0, "assistant", "nobody", "x")] * 2 + [(4, i, "assistant", f"long {i} " * 50, "x") for i in range(40)]
    df = frame(rows, "conv_id long, turn long, role string, text string, part string").repartition(5)
    got = {r.conv_id: r for r in C.chat_digests(df, PATH).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in own]
        g = got[conv]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == digest(turns)
        assert g.formatted_chars == len(C.render(turns)[0])
    assert len(got) == 5


def test_empty_table(frame):
    assert C.chat_digests(frame([], "conv_id long, turn long, role string, text string"), PATH).collect() == []


def test_query_over_the_table(spark):
    got = {r.conv_id: r for r in op6_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    said = TRAPS[0]
    assert (got[-1].n_turns, got[-1].turns_sha256, got[-1].loss_chars, got[-1].loss_sha256) == digest([("user", said), ("assistant", said)])
    convs = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert len(got) == len(convs) + 1
    for conv, turns in convs.items():
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == digest(turns)
