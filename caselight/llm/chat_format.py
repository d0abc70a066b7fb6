"""Conversations as marked-up training text, assembled column-wise.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles a backslash goes between
``<`` and ``|`` (and any backslashes there), so a marker never occurs inside; taking one backslash
out again restores the text. In roles, backslashes and line feeds are escaped as well.
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

OPEN, CLOSE = b"<|im_start|>", b"<|im_end|>\n"
PIECES = "conv_id long, first_turn long, piece long, n_turns long, formatted binary, loss_starts array<int>, loss_ends array<int>"
_TURN = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\\\1|")


def escape_role(column: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(column, "\\", "\\\\"), "\n", "\\n"))


def unescape(text: bytes) -> bytes:
    return re.sub(rb"<\\(\\*)\|", rb"<\1|", text)


def unescape_role(role: bytes) -> bytes:
    return re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], unescape(role))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets (one more than rows) and bytes of a string column."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def _scatter(out: np.ndarray, to: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> None:
    """Copies the segments of ``data`` to the places ``to``."""
    out[np.arange(len(data)) + np.repeat(to - offsets[:-1], np.diff(offsets))] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns: bytes, start of each turn (one more than rows), start and end
    of each text in it."""
    r_at, r_data = _bytes_of(roles)
    t_at, t_data = _bytes_of(texts)
    r_len, t_len = np.diff(r_at), np.diff(t_at)
    starts = np.concatenate([[0], np.cumsum(r_len + t_len + len(OPEN) + 1 + len(CLOSE))])
    out = np.empty(starts[-1], np.uint8)
    role_at = starts[:-1] + len(OPEN)
    text_at = role_at + r_len + 1
    end = text_at + t_len
    out[starts[:-1, None] + np.arange(len(OPEN))] = np.frombuffer(OPEN, np.uint8)
    _scatter(out, role_at, r_at, r_data)
    out[text_at - 1] = 10
    _scatter(out, text_at, t_at, t_data)
    out[end[:, None] + np.arange(len(CLOSE))] = np.frombuffer(CLOSE, np.uint8)
    return out, starts, text_at, end


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        roles, texts = escape_role(batch["role"].fill_null("")), escape(batch["text"].fill_null(""))
        out, starts, text_at, text_end = assemble(roles, texts)
        assistant = pc.equal(batch["role"].fill_null(""), "assistant").to_numpy(zero_copy_only=False)
        ids = batch["conv_id"].to_pylist()
        heads = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
        rows = []
        for a, b in zip(heads, heads[1:]):
            own = a + np.flatnonzero(assistant[a:b])
            rows.append((ids[a], batch["turn"][a].as_py(), pieces, b - a, out[starts[a] : starts[b]].tobytes(), text_at[own] - starts[a], text_end[own] - starts[a]))
            pieces += 1
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        names = ("conv_id", "first_turn", "piece", "n_turns", "formatted", "loss_starts", "loss_ends")
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formatted conversations from ``turns`` (conv_id, turn, role, text), in pieces.

    Columns: conv_id, first_turn, piece, n_turns, formatted (UTF-8 bytes), loss_starts and
    loss_ends (byte spans of the assistant's texts in the piece, escaped). A conversation is
    the concatenation of its pieces in the order of (first_turn, piece); most have one. Rows are
    dealt by ranges of (conv_id, turn), so a very long conversation is spread over tasks, and a
    piece never exceeds an Arrow batch. Null texts and roles are empty, null turns come first,
    rows of the same turn are ordered by role and text, rows without conv_id are one
    conversation. An empty table gives no rows; other columns are ignored.
    """
    columns = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"]
    rows = turns.select(*columns).repartitionByRange("conv_id", "turn")
    return rows.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format, PIECES)


def turns_of(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of all turns, read back from formatted text."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("not a formatted conversation")
        at = m.end()
        out.append((unescape_role(m[1]), unescape(m[2])))
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


def code_points(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads ordered pieces as a stream; a conversation's state is two hashes and counts."""
    names = [x.split()[0] for x in _DIGESTS.split(", ")]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    current, done = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if current is None or current[0] != row["conv_id"]:
                if current:
                    done.append(current)
                current = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            text = row["formatted"]
            for role, content in turns_of(text):
                current[1] += 1
                current[2].update(role + b"\n" + content + b"\n")
            for a, b in zip(row["loss_starts"], row["loss_ends"], strict=True):
                content = unescape(text[a:b])
                current[3] += code_points(content)
                current[4].update(content)
            current[5] += code_points(text)
        if done:
            yield _rows(done, names, types)
            done = []
    if current:
        yield _rows([current], names, types)


def _rows(done: list, names: list[str], types: tuple) -> pa.RecordBatch:
    plain = [[c, n, t.hexdigest(), k, x.hexdigest(), f] for c, n, t, k, x, f in done]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*plain), types)], names=names)


def read_back(pieces: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted pieces: conv_id, n_turns,
    turns_sha256 (role, line feed, text, line feed per turn), loss_chars and loss_sha256 (the
    texts under the loss spans, unescaped), formatted_chars."""
    rows = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "first_turn", "piece")
    return rows.mapInArrow(_digest, _DIGESTS)
