"""Chat formatting by columnar byte assembly.

Rows are brought together by conversation and ordered by turn. For each block of rows
the lengths of all segments (marks, roles, texts) are taken from the columns, running
sums give where each segment begins in the output, and index arrays scatter the bytes
of headers and contents into one preallocated buffer, which becomes the Arrow column as
it is. The loss mask is a list of byte spans, one for each assistant text.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. What looks like a
control string in a text, ``<`` and ``|`` with any number of backslashes between them,
gets one backslash more, which reading takes off again; so no text can end a turn. In a
role, backslashes and line ends are escaped too.

Defined results: null texts and roles are empty; null turns come first, equal turns are
ordered by role and text; rows with a null conversation id are one conversation; repeated
rows stay. A conversation is one cell of the output, so its size is bound by what a cell
may hold; blocks are cut between conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
BLOCK_BYTES = 8 << 20

FORMATTED = "conv_id bigint, n_turns bigint, formatted string, loss array<struct<start:bigint,end:bigint>>"


def _escaped_texts(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\\\1|")


def _escaped_roles(roles: pa.Array) -> pa.Array:
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        roles = pc.replace_substring(roles, raw, shown)
    return _escaped_texts(roles)


def unescaped_text(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r"}.get(m[1], m[1]), unescaped_text(role))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    return ends, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)


def _scatter(out: np.ndarray, at: np.ndarray, ends: np.ndarray, data: np.ndarray) -> None:
    """Copy segment i of ``data`` to place ``at[i]``: one index array for all bytes of a column."""
    sizes = np.diff(ends)
    total = int(sizes.sum())
    within = np.arange(total) - np.repeat(ends[:-1] - ends[0], sizes)
    out[np.repeat(at, sizes) + within] = data[ends[0]:ends[-1]]


def _constant(out: np.ndarray, at: np.ndarray, mark: bytes) -> None:
    out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, dtype=np.uint8)


def assemble(ids: pa.Array, roles: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """One row per conversation of rows that lie together."""
    roles, texts = (pc.fill_null(c.cast(pa.large_string()), "") for c in (roles, texts))
    spoken = pc.equal(roles, ASSISTANT).to_numpy(zero_copy_only=False)
    role_ends, role_data = _bytes(_escaped_roles(roles))
    text_ends, text_data = _bytes(_escaped_texts(texts))
    start, newline, close = START.encode(), b"\n", END.encode() + b"\n"
    head, mid, tail = len(start), len(newline), len(close)
    role_sizes, text_sizes = np.diff(role_ends), np.diff(text_ends)
    turn_ends = np.cumsum(head + role_sizes + mid + text_sizes + tail)
    turns = np.concatenate(([0], turn_ends[:-1]))
    role_at = turns + head
    text_at = role_at + role_sizes + mid
    buffer = pa.allocate_buffer(int(turn_ends[-1]))
    out = np.frombuffer(buffer, dtype=np.uint8)
    _constant(out, turns, start)
    _scatter(out, role_at, role_ends, role_data)
    _constant(out, text_at - mid, newline)
    _scatter(out, text_at, text_ends, text_data)
    _constant(out, text_at + text_sizes, close)

    key = ids.to_numpy(zero_copy_only=False) if not ids.null_count else np.array(ids.to_pylist(), dtype=object)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    counts = np.diff(np.concatenate((first, [len(ids)])))
    bounds = np.concatenate((turns[first], turn_ends[-1:]))
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int64)), buffer).cast(pa.string())
    conversation = np.repeat(np.arange(len(first)), counts)
    base = bounds[conversation]
    spans = pa.StructArray.from_arrays([pa.array((text_at - base)[spoken]), pa.array((text_at + text_sizes - base)[spoken])], ["start", "end"])
    per = np.bincount(conversation[spoken], minlength=len(first))
    loss = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32()), spans)
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(counts.astype(np.int64)), formatted, loss], ["conv_id", "n_turns", "formatted", "loss"])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole conversations: the last conversation of a block waits for what follows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK_BYTES:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column(0).to_pylist()
            cut = len(ids) - 1
            while cut > 0 and ids[cut - 1] == ids[-1]:
                cut -= 1
            if cut:
                yield assemble(*(table.column(c).slice(0, cut).combine_chunks() for c in range(3)))
            held, size = table.slice(cut).to_batches(), 0
    if held and (table := pa.Table.from_batches(held).combine_chunks()).num_rows:
        yield assemble(*(table.column(c).combine_chunks() for c in range(3)))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss (byte spans) for each conversation of (conv_id, turn, role, text)."""
    rows = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(_format, FORMATTED)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.partition("\n")
        turns.append((unescaped_role(role), unescaped_text(text[:text.rindex(END)])))
    return turns


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, n, formatted, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            whole = hashlib.sha256()
            turns = read_turns(formatted)
            for role, text in turns:
                whole.update(f"{role}\n{text}\n".encode())
            raw, learned, chars = formatted.encode(), hashlib.sha256(), 0
            for span in loss:
                text = unescaped_text(raw[span["start"]:span["end"]].decode())
                learned.update(text.encode())
                chars += len(text)
            rows.append((conv, len(turns), whole.hexdigest(), chars, learned.hexdigest(), len(formatted)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())],
                                          ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digest(chats: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives."""
    return chats.mapInArrow(_digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
