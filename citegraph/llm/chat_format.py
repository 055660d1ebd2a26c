"""Operator 6: chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the tokens that lie in a
turn to be learned are found by binary search of the sorted turn spans in the sorted token spans.

The template of a turn is ``<|turn|>`` role ``<|text|>`` text ``<|end|>``.  The three marks are special
tokens of the tokenizer, so no token crosses one, and no mark can come from a text: in
roles and texts a backslash is doubled and the opening sign of a control string (these marks and those of other
templates) gets a backslash and a hyphen behind it, which `unescape` takes back.

Conversations of more than `PART_TURNS` turn numbers are rendered in parts, each row of the output one part:
since tokens never cross a mark, the parts' tokens in turn are those of the whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.llm.common import short_batches, stored, tidy

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: turn numbers of a part
PART_TURNS = 256
#: role whose texts are learned
LEARNED = "assistant"
#: characters encoded by one call
CALL_CHARS = 2_000_000

_OPEN = re.compile(r"\\|<(?=\||/?s>|/?<?/?SYS>|(?:start|end)_of_turn>|(?:bos|eos|pad|unk)>)|\[(?=/?(?:INST|SYSTEM_PROMPT|AVAILABLE_TOOLS|TOOL_CALLS|TOOL_RESULTS)\])")
_CLOSE = re.compile(r"\\([\\-])")
_PARSE = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    return _OPEN.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\-", text)


def unescape(text: str) -> str:
    return _CLOSE.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted text and the (start, end) spans, in code points, of the texts to be learned."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        start = at + len(head)
        at = start + len(body) + len(END)
        parts += [head, body, END]
        if role == LEARNED:
            spans.append((start, start + len(body)))
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted text."""
    return [(unescape(r), unescape(t)) for r, t in _PARSE.findall(formatted)]


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens (sorted offsets) lie in a span (sorted); a span's first and last token by binary search."""
    first = np.searchsorted(offsets[:, 1], spans[:, 0], "right")
    last = np.searchsorted(offsets[:, 0], spans[:, 1], "left")
    edge = np.zeros(len(offsets) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, np.maximum(last, first), -1)
    return np.cumsum(edge[:-1]) > 0


def chat_tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, TEXT, END)])
    return t


def _quiet():
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def format_conversations(convs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(conv_id, part, formatted, input_ids, loss_mask) of (conv_id, turn, role, text) rows: one row per conversation,
    or per `PART_TURNS` turn numbers of it.

    Turns are ordered by turn, role and text, nulls first; a null role or text is empty.  Repeated rows are turns
    of their own.  Rows with a null conv_id are one conversation.  Whole texts are formatted.  Further columns are
    not read; an empty table gives no rows.  `tokenizer_path` must name a byte-level tokenizer's file that every
    executor has.
    """
    short_batches(convs.sparkSession)
    rows = convs.select(
        F.col("conv_id").cast("long"), F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(-(1 << 60))).cast("long").alias("part"),
        F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text")

    def run(batches):
        _quiet()
        tokenizer = chat_tokenizer(tokenizer_path)

        def flush(whole):
            made = [render(turns) for _, turns in whole]
            encoded = tokenizer.encode_batch([x for x, _ in made], add_special_tokens=False)
            ids, masks = [], []
            for (_, spans), e in zip(made, encoded):
                ids.append(np.array(e.ids, np.int32))
                masks.append(token_mask(np.array(e.offsets, np.int64).reshape(-1, 2), spans).astype(np.int8))
            cols = [
                pa.array([k[0] for k, _ in whole], pa.int64()), pa.array([k[1] for k, _ in whole], pa.int64()), pa.array([x for x, _ in made], pa.string()),
                pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int8())),
            ]
            return pa.RecordBatch.from_arrays(cols, names=["conv_id", "part", "formatted", "input_ids", "loss_mask"])

        whole, size = [], 0  # finished parts but for the last
        for b in batches:
            for conv, part, role, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if not whole or whole[-1][0] != (conv, part):
                    if size > CALL_CHARS:
                        yield flush(whole)
                        whole, size = [], 0
                    whole.append(((conv, part), []))
                whole[-1][1].append((role, text))
                size += len(text)
        if whole:
            yield flush(whole)

    return dealt.select("conv_id", "part", "role", "text").mapInArrow(tidy(run), "conv_id long, part long, formatted string, input_ids array<int>, loss_mask array<byte>")


def conversation_digests(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per conversation of a written table of `format_conversations`, read back from it: conv_id, n_turns and
    turns_sha256 from the parsed texts, loss_chars and loss_sha256 from the tokens under the mask, formatted_chars.
    A conversation's parts are streamed in order, so a task holds one part at a time."""

    def run(batches):
        _quiet()
        tokenizer = chat_tokenizer(tokenizer_path)
        key, state, done = None, None, []

        def close():
            turns, loss, n, chars, size = state
            done.append((key[0], n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def batch():
            out = [pa.array(x, k) for x, k in zip(zip(*done), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
            done.clear()
            return pa.RecordBatch.from_arrays(out, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            for i in range(b.num_rows):
                conv, text = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                if key != (conv,):
                    if key:
                        close()
                    key, state = (conv,), [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                turns = parse(text)
                state[0].update("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass"))
                state[2] += len(turns)
                state[4] += len(text)
                ids = b.column(2)[i].values.to_numpy(zero_copy_only=False)
                mask = b.column(3)[i].values.to_numpy(zero_copy_only=False)
                edge = np.flatnonzero(np.diff(mask, prepend=0, append=0))
                runs = [ids[s:e].tolist() for s, e in zip(edge[::2], edge[1::2])]
                learned = "".join(map(unescape, tokenizer.decode_batch(runs, skip_special_tokens=False))) if runs else ""
                state[1].update(learned.encode("utf-8", "surrogatepass"))
                state[3] += len(learned)
            if done:
                yield batch()
        if key:
            close()
            yield batch()

    rows = formatted.select("conv_id", "formatted", "input_ids", "loss_mask", "part").repartition("conv_id").sortWithinPartitions("conv_id", "part").drop("part")
    return rows.mapInArrow(tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_digests(convs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Format all conversations, write the result to the shared scratch folder and digest what was written."""
    short_batches(convs.sparkSession)
    return conversation_digests(stored(format_conversations(convs, tokenizer_path), "chat"), tokenizer_path)
