"""Chat formatting with loss masks aligned to token offsets.

A whole conversation is rendered with a template, encoded once with character offsets, and the sorted spans of
the trained turns are intersected with the sorted token spans by binary search.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line feed per turn. The three marks are tokens of
their own. Inside roles and texts a backslash becomes two, and ``<|`` becomes ``<\\|``, so that no text can
close its turn; :func:`unescape` reverses it.

Defined cases: a null role or text is empty; turns are ordered by turn (nulls first), then role, then text, and
repeated rows are all kept; rows with a null conversation form one conversation; an empty table gives no rows;
columns besides the four are ignored. One conversation is formatted by one task, in bounded batches of others.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(SEP) + r"(.*?)" + re.escape(END) + "\n", re.S)

SCHEMA = (
    "conv_id bigint, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>,"
    " loss_mask array<boolean>, span_starts array<int>, span_ends array<int>"
)
_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("formatted", pa.string())]
    + [(n, pa.list_(pa.int32())) for n in ("token_ids", "token_starts", "token_ends")]
    + [("loss_mask", pa.list_(pa.bool_()))]
    + [(n, pa.list_(pa.int32())) for n in ("span_starts", "span_ends")]
)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[int], list[int]]:
    """The formatted conversation and the character spans of the texts of the role ``trained``."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        if role == trained:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, unescaped."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def mask(token_starts: np.ndarray, token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True for each token that shares a character with a span; tokens and spans ascend."""
    out = np.zeros(len(token_starts), dtype=bool)
    lows, highs = np.searchsorted(token_ends, starts, side="right"), np.searchsorted(token_starts, ends, side="left")
    for low, high, empty in zip(lows, highs, starts == ends):
        if not empty:
            out[low:high] = True
    return out


def masked_text(formatted: str, row: dict) -> str:
    """The text below the mask, each character once and within the spans, unescaped."""
    picked = np.flatnonzero(row["loss_mask"])
    starts, ends = np.asarray(row["token_starts"])[picked], np.asarray(row["token_ends"])[picked]
    if not len(picked):
        return ""
    first, last = np.asarray(row["span_starts"]), np.asarray(row["span_ends"])
    filled = first < last
    first, last = first[filled], last[filled]
    at = np.searchsorted(last, starts, side="right")
    starts = np.maximum(np.maximum(starts, np.concatenate([[0], np.maximum.accumulate(ends)[:-1]])), first[at])
    ends = np.minimum(ends, last[at])
    return unescape("".join(formatted[a:b] for a, b in zip(starts.tolist(), ends.tolist()) if a < b))


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    key, turns, open_ = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
            if open_ and conv != key:
                yield key, turns
                turns = []
            key, open_ = conv, True
            turns.append((role or "", text or ""))
    if open_:
        yield key, turns


def format_chats(conversations: DataFrame, tokenizer_path: str, trained: str = "assistant", batch_chars: int = 2_000_000) -> DataFrame:
    """One row per conversation: text, tokens with offsets, loss mask over tokens, spans of the trained texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import AddedToken, Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (START, SEP, END)])

        def encoded(held: list) -> pa.RecordBatch:
            codes = tokenizer.encode_batch([text for _, (text, _, _) in held], add_special_tokens=False)
            rows: dict[str, list] = {n: [] for n in _ARROW.names}
            for (conv, (text, starts, ends)), code in zip(held, codes):
                offsets = np.array(code.offsets, dtype=np.int32).reshape(-1, 2)
                spans = np.array(starts, dtype=np.int32), np.array(ends, dtype=np.int32)
                loss = mask(offsets[:, 0], offsets[:, 1], *spans)
                for name, value in zip(_ARROW.names, (conv, text, code.ids, offsets[:, 0], offsets[:, 1], loss, *spans)):
                    rows[name].append(value)
            return pa.RecordBatch.from_pydict(rows, schema=_ARROW)

        held, size = [], 0
        for conv, turns in _conversations(batches):
            held.append((conv, render(turns, trained)))
            size += len(held[-1][1][0])
            if size >= batch_chars:
                yield encoded(held)
                held, size = [], 0
        if held:
            yield encoded(held)

    rows = conversations.select("conv_id", "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SCHEMA)
