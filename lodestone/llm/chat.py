"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole by a template that marks turns, encoded once with
character offsets, and the spans of assistant texts are intersected with the token
spans by binary search: a token takes part in the loss if its span overlaps one.

Template of a turn: `<|turn|>ROLE\\nTEXT<|end|>\\n`. Inside roles and texts a backslash
doubles and a `<` becomes `\\l`, so no text can hold a mark, and unescaping is exact.

Null texts are empty, null roles are the empty role, turns sort by number (nulls
first), then role, then text. Rows with a null conv_id form one conversation. Empty
tables give no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: Characters of rendered turns that the encoder takes at a time. It goes on behind a turn
#: mark, where no token can reach over, so ids and offsets are those of encoding all at once.
SPAN_CHARS = 1 << 20
_MARKED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def escape_role(role: str) -> str:
    """A role ends at the first line end, so its own are escaped, too."""
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _MARKED.sub(lambda m: {"l": "<", "n": "\n"}.get(m[1], m[1]), text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted spans of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape_role(role)}\n", escape(text)
        parts += [head, body, END]
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that a formatted conversation was made of."""
    out = []
    for part in formatted.split(TURN)[1:]:
        role, _, text = part.removesuffix(END).partition("\n")
        out.append((unescape(role), unescape(text)))
    return out


def align(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Mask over tokens: true where a token's span meets a turn span.

    Both lists are sorted. For each turn span the tokens that end after its start and
    begin before its end are found by binary search.
    """
    mask = np.zeros(len(offsets), bool)
    for start, stop in spans:
        if stop > start:
            first = np.searchsorted(offsets[:, 1], start, side="right")
            last = np.searchsorted(offsets[:, 0], stop, side="left")
            mask[first:last] = True
    return mask


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray, spans: list[tuple[int, int]]) -> list[str]:
    """Text under the mask, span by span, clipped to the turn (a token may reach past)."""
    out = []
    for start, stop in spans:
        first = np.searchsorted(offsets[:, 1], start, side="right")
        last = np.searchsorted(offsets[:, 0], stop, side="left")
        on = np.flatnonzero(mask[first:last]) + first
        out.append(formatted[max(start, int(offsets[on[0], 0])) : min(stop, int(offsets[on[-1], 1]))] if len(on) and stop > start else "")
    return out


def _conversations(batches) -> Iterator[tuple[int | None, list[tuple[str, str]], bool]]:
    """(conv_id, turns, is the last part) from rows sorted by conversation and turn."""
    current, turns, size, begun = None, [], 0, False
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if begun and conv_id != current:
                yield current, turns, True
                turns, size = [], 0
            elif size >= SPAN_CHARS:
                yield current, turns, False
                turns, size = [], 0
            current, begun = conv_id, True
            turns.append((role or "", text or ""))
            size += len(role or "") + len(text or "")
    if begun:
        yield current, turns, True


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "role", "text", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text")


_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
        _TOKENIZERS[path].encode_special_tokens = True
    return _TOKENIZERS[path]


def format_conversations(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """conv_id, formatted, ids and loss_mask (one flag per id), one row per conversation."""

    def run(batches):
        tokenizer = _tokenizer(tokenizer_path)
        texts, ids, masks = [], [], []
        for conv_id, turns, last in _conversations(batches):
            formatted, spans = render(turns)
            encoding = tokenizer.encode(formatted, add_special_tokens=False)
            texts.append(formatted)
            ids.append(np.array(encoding.ids, np.int32))
            masks.append(align(np.array(encoding.offsets, np.int64).reshape(-1, 2), spans))
            if not last:
                continue
            flat, mask = np.concatenate(ids), np.concatenate(masks)
            ends = pa.array([0, len(flat)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv_id], pa.int64()), pa.array(["".join(texts)]), pa.ListArray.from_arrays(ends, pa.array(flat)), pa.ListArray.from_arrays(ends, pa.array(mask))],
                names=["conv_id", "formatted", "ids", "loss_mask"],
            )
            texts, ids, masks = [], [], []

    return _sorted(conversations).mapInArrow(run, "conv_id long, formatted string, ids array<int>, loss_mask array<boolean>")


def digest_conversations(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per conversation: turn count and digests, read back from the formatted output.

    Rows stream in turn order, so even a conversation with a third of all turns is
    digested in bounded memory (its hash is sequential by definition).
    """

    def run(batches):
        tokenizer = _tokenizer(tokenizer_path)
        rows, state = [], None
        for conv_id, turns, last in _conversations(batches):
            if state is None:
                state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            formatted, spans = render(turns)
            offsets = np.array(tokenizer.encode(formatted, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)
            mask = align(offsets, spans)
            back = parse(formatted)
            state[0] += len(back)
            for role, text in back:
                state[1].update(f"{role}\n{text}\n".encode())
            for text in map(unescape, masked_text(formatted, offsets, mask, spans)):
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
            if last:
                rows.append((conv_id, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                state = None
            if len(rows) >= 1000:
                yield _digests(rows)
                rows = []
        yield _digests(rows)

    return _sorted(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in n else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)


def with_probe(conversations: DataFrame, conv_id: int = -7) -> DataFrame:
    """The table plus a two-turn conversation whose texts imitate control strings."""
    text = "\\### Assistant: </turn> ok"
    spark = conversations.sparkSession
    probe = spark.range(2).select(F.lit(conv_id).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
