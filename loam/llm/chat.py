"""Chat formatting by columnar byte assembly.

Turns are sorted by conversation over the whole cluster, so that one very long
conversation spreads over tasks; each task writes the parts of conversations that
it holds, some turns and bytes at a time. The segments of these turns (header, role,
text, end) get their lengths, the running sums of these give each segment's place, and
numpy scatters headers and contents into one preallocated buffer (long texts by
slices). That buffer, with the places where parts begin, is the Arrow column of
formatted texts; nothing is copied into strings. The loss mask is a list of byte ranges.

Template: ``<|im_start|>role LF text <|im_end|> LF``. Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so no control string but the
template's own occurs and reading back restores every text; in roles a line feed
becomes backslash and n.

A null text or role is empty; null conv_ids are left out; null turns come first;
turns that tie are ordered by role and text; rows that repeat are turns of their
own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.bpe import _arrow_schema
from loam.llm.common import freed

START, END = "<|im_start|>", "<|im_end|>"
#: Bytes and turns of what is put together at once, beyond which only a single turn goes;
#: bytes from which a text is copied as a slice.
PART_BYTES, PART_TURNS, LONG = 1 << 20, 4096, 2048
PARTS = "conv_id long, part_task int, part int, n_turns int, formatted string, loss array<struct<begin:int,end:int>>"
_TURN = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(column: pa.Array, role: bool = False) -> pa.Array:
    column = pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "<|", "<\\|")
    return pc.replace_substring(column, "\n", "\\n") if role else column


def unescaped(text: str, role: bool = False) -> str:
    return _ESCAPED.sub(lambda m: "\n" if role and m[1] == "n" else m[1], text) if "\\" in text else text


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of a large string column."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at[:-1], np.diff(at)


def _scatter(out: np.ndarray, place: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copies every row's bytes to its place."""
    long = length >= LONG
    for p, s, n in zip(place[long].tolist(), start[long].tolist(), length[long].tolist()):
        out[p : p + n] = data[s : s + n]
    place, start, length = place[~long], start[~long], length[~long]
    within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(place, length) + within] = data[np.repeat(start, length) + within]


def _stamp(out: np.ndarray, place: np.ndarray, text: str) -> None:
    raw = np.frombuffer(text.encode(), np.uint8)
    out[place[:, None] + np.arange(len(raw))] = raw


def cuts(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of turns of so many bytes that are put together at once."""
    end, first = np.cumsum(size), 0
    while first < len(size):
        before = end[first - 1] if first else 0
        last = min(first + PART_TURNS, max(first + 1, int(np.searchsorted(end, before + PART_BYTES, side="right"))), len(size))
        yield first, last
        first = last


def assemble(conv: np.ndarray, role: pa.Array, text: pa.Array, assistant: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.StringArray, pa.ListArray]:
    """conv_id, number of turns, formatted text and loss ranges of each conversation's part."""
    (rd, rs, rn), (td, ts, tn) = _flat(escaped(role, role=True)), _flat(escaped(text))
    head, tail = len(START), len(END) + 1
    length = head + rn + 1 + tn + tail
    end = np.cumsum(length)
    at = end - length
    out = np.empty(int(end[-1]), np.uint8)
    _stamp(out, at, START)
    _scatter(out, at + head, rd, rs, rn)
    _stamp(out, at + head + rn, "\n")
    body = at + head + rn + 1
    _scatter(out, body, td, ts, tn)
    _stamp(out, body + tn, END + "\n")
    first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
    offsets = np.append(at[first], end[-1]).astype(np.int32)
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(out))
    part = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(conv))))
    here = np.flatnonzero(assistant)
    begin = body[here] - at[first][part[here]]
    ranges = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(begin + tn[here], pa.int32())], names=["begin", "end"])
    loss = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(part[here], minlength=len(first)))), pa.int32()), ranges)
    return conv[first], np.bincount(part), formatted, loss


#: Characters of a role and of a text by which turns of one number are ranged.
BEGINNING = 32


def format_conversations(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """conv_id, part_task, part, n_turns, formatted, loss: the parts of every
    conversation; in order of part_task and part they are its formatted text.
    ``loss`` holds the byte ranges of the assistant's (escaped) texts in a part."""
    empty = F.lit("")
    src = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    arrow = _arrow_schema(turns, PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = (pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False) + pc.binary_length(batch.column("role")).to_numpy(zero_copy_only=False)).astype(np.int64)
            for a, b in cuts(size):
                piece = batch.slice(a, b - a)
                conv = piece.column("conv_id").to_numpy(zero_copy_only=False)
                ids, turns, formatted, loss = assemble(conv, piece.column("role"), piece.column("text"), pc.equal(piece.column("role"), assistant).to_numpy(zero_copy_only=False))
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(n, task, np.int32)), pa.array(np.arange(part, part + n, dtype=np.int32)), pa.array(turns, pa.int32()), formatted, loss.cast(arrow.field("loss").type)], schema=arrow)
                part += n

    # the sampler of ranges sees ids and beginnings, no texts; what begins alike stays together
    head = F.substring("role", 1, BEGINNING)
    begins = F.when(F.char_length("role") <= BEGINNING, F.substring("text", 1, BEGINNING)).otherwise("")
    return src.repartitionByRange("conv_id", "turn", head, begins).sortWithinPartitions(*order).mapInArrow(freed(run), PARTS)


def turns_of(raw: bytes) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted text."""
    for m in _TURN.finditer(raw):
        yield unescaped(m[1].decode(), role=True), unescaped(m[2].decode())


def read_digests(parts: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all
    read back from the formatted parts, one part of a conversation at a time."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    arrow = _arrow_schema(parts, schema)
    order = ["conv_id", "part_task", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = None
        turns = loss = None
        n = chars = formatted = 0

        def done() -> pa.RecordBatch:
            row = (conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted)
            return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(row, arrow)], schema=arrow)

        for batch in (b.slice(k, 16) for b in batches for k in range(0, b.num_rows, 16)):
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    if conv is not None:
                        yield done()
                    conv, turns, loss, n, chars, formatted = row["conv_id"], hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                raw = row["formatted"].encode()
                formatted += len(row["formatted"])
                for role, text in turns_of(raw):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for s in row["loss"]:
                    text = unescaped(raw[s["begin"] : s["end"]].decode())
                    loss.update(text.encode())
                    chars += len(text)
        if conv is not None:
            yield done()

    return parts.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(freed(run), schema)
