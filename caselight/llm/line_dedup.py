"""Removal of repeated multi-line passages with content-defined boundaries.

A rolling hash over the hashes of consecutive lines with words decides where a passage ends, so
that the same lines are cut alike wherever they stand: an insertion shifts no boundary beyond its
own surroundings, and blank lines shift none. Passages of two lines or more are looked up across the whole corpus by a 128-bit
hash; those found repeated are then compared byte by byte in blocks of the hash space, and every
occurrence but the earliest goes.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .rounds import answers, chunked, messages, note_of, rows_of, split_parts, two_rounds
from .wordhash import U64, combine

PASSAGES_PER_BLOCK = 2**18
BYTES_PER_BLOCK = 16 << 20


def _worded(lines: list[bytes]) -> list[int]:
    """Numbers of the lines with words."""
    return [i for i, x in enumerate(lines) if x.strip()]


def boundaries(lines: list[bytes], divisor: int, window: int, least: int, most: int) -> list[int]:
    """Ends of the passages of a text's lines.

    Only lines with words count: a passage ends behind one if the hash of the last ``window`` of
    them is 0 modulo ``divisor`` and the passage has ``least``, at ``most`` of them, or at the
    text's end. Blank lines belong to the passage behind them, at the text's end to the last.
    """
    at = _worded(lines)
    n = len(at)
    h = np.fromiter((xxhash.xxh3_64_intdigest(lines[i]) for i in at), U64, n)
    if n >= window:
        cut = np.flatnonzero(combine([h[i : n - window + 1 + i] for i in range(window)]) % U64(divisor) == 0) + window
    else:
        cut = np.empty(0, np.int64)
    ends, start = [], 0
    for end in [*cut.tolist(), n]:
        while end - start > most:
            start += most
            ends.append(start)
        if end - start >= least or (end == n and end > start):
            ends.append(end)
            start = end
    return [len(lines) if end == n else at[end - 1] + 1 for end in ends]


def passages(text: bytes | None, divisor: int = 3, window: int = 2, least: int = 2, most: int = 64) -> list[tuple[int, int, bytes]]:
    """(first line, lines, bytes) of the passages with words on two lines at least.

    Blank lines around a passage are among its lines, but not its bytes. A last line with words
    that is left alone forms a further passage with the one before it, so every text with words
    on two lines or more is covered wholly.
    """
    lines = text.split(b"\n") if text else []
    at = _worded(lines)
    out, start, done = [], 0, 0
    for end in boundaries(lines, divisor, window, least, most):
        first, done = done, bisect.bisect_left(at, end)
        if done - first == 1 and done == len(at) > 1:
            first -= 1
            start = at[first]
        if done - first > 1:
            out.append((start, end - start, b"\n".join(lines[at[first] : at[done - 1] + 1])))
        start = end
    return out


class _Passages:
    """Distinct passages of a chunk, each with its occurrences (row, first line, lines)."""

    def __init__(self, keys: np.ndarray, texts: list[bytes | None], shape: dict, blocks: int):
        found: dict[bytes, list[tuple[int, int, int]]] = {}
        for row, text in enumerate(texts):
            for start, n, data in passages(text, **shape):
                found.setdefault(data, []).append((row, start, n))
        entries = []
        for data, places in found.items():
            digest = xxhash.xxh3_128_digest(data)
            block = int.from_bytes(digest[:4], "big") * blocks >> 32
            first = min((int(keys[row]), start) for row, start, _ in places)
            entries.append((block, digest, data, places, first))
        entries.sort(key=lambda e: e[:3])
        self.entries = entries
        self.block = np.array([e[0] for e in entries], np.int64)


def remove_repeated_passages(
    docs: DataFrame, divisor: int = 3, window: int = 2, least: int = 2, most: int = 64, chunk_bytes: int = 8 << 20
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_lines, n_passages,
    n_removed_lines, kept_text.

    Lines are what ``\\n`` separates; n_passages counts the multi-line passages (words on two
    lines at least), and of each one only the occurrence with the smallest (doc_id, first line)
    stays. Blank lines before a passage, and those that end a text, go with it. Kept lines are joined by ``\\n``. A null text has no lines and kept_text null; an
    empty text has one empty line. A null doc_id comes before all others; rows with the same
    doc_id are one document, so equal places don't remove each other. An empty table gives no
    rows; other columns of ``docs`` are ignored.
    """
    chunks, total = chunked(docs, chunk_bytes)
    blocks = max(1, math.ceil(total / 256 / PASSAGES_PER_BLOCK), math.ceil(total / BYTES_PER_BLOCK))
    shape = {"divisor": divisor, "window": window, "least": least, "most": most}

    def read(table: pa.Table):
        ids, keys, texts = rows_of(table)
        return ids, keys, texts, _Passages(keys, texts, shape, blocks)

    def several(keys: np.ndarray, places: list) -> bool:
        return len({(int(keys[row]), start) for row, start, _ in places}) > 1

    def ask(chunk: int, table: pa.Table) -> pa.Table:
        _, keys, _, own = read(table)
        out = []
        for block, a, b in split_parts(own.block):
            digests = b"".join(e[1] for e in own.entries[a:b])
            own_twice = np.packbits([several(keys, e[3]) for e in own.entries[a:b]]).tobytes()
            out.append((block, chunk, block, b - a, digests + own_twice))
        return messages(out)

    def merge(block: int, table: pa.Table) -> pa.Table:
        count: dict[bytes, int] = {}
        asked = []
        for source, n, payload in zip(table["source"].to_pylist(), table["n"].to_pylist(), table["payload"].to_pylist(), strict=True):
            digests = [payload[i : i + 16] for i in range(0, 16 * n, 16)]
            twice = np.unpackbits(np.frombuffer(payload[16 * n :], np.uint8), count=n).tolist()
            asked.append((source, digests))
            for d, t in zip(digests, twice, strict=True):
                count[d] = count.get(d, 0) + 1 + t
        return messages([(s, s, block, len(ds), np.packbits([count[d] > 1 for d in ds]).tobytes()) for s, ds in asked])

    def ask_again(chunk: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        _, _, _, own = read(table)
        repeated = answers(replies)
        out = [(-1 - chunk, chunk, -1, len(repeated), np.packbits(repeated).tobytes())]
        at = np.flatnonzero(repeated)
        for block, a, b in split_parts(own.block[at]):
            part = [own.entries[i] for i in at[a:b].tolist()]
            firsts = np.array([e[4] for e in part], np.int64).tobytes()
            lengths = np.array([len(e[2]) for e in part], np.int64).tobytes()
            out.append((block, chunk, block, b - a, firsts + lengths + b"".join(e[2] for e in part)))
        return messages(out)

    def resolve(block: int, table: pa.Table) -> pa.Table:
        first: dict[bytes, tuple[int, int]] = {}
        asked = []
        for source, n, payload in zip(table["source"].to_pylist(), table["n"].to_pylist(), table["payload"].to_pylist(), strict=True):
            places = [tuple(x) for x in np.frombuffer(payload, np.int64, 2 * n).reshape(n, 2).tolist()]
            at, texts = 24 * n, []
            for length in np.frombuffer(payload, np.int64, n, 16 * n).tolist():
                texts.append(payload[at : at + length])
                at += length
            asked.append((source, places, texts))
            for place, data in zip(places, texts, strict=True):
                if data not in first or place < first[data]:
                    first[data] = place
        return messages([
            (s, s, block, len(places), np.packbits([first[t] < p for p, t in zip(places, texts, strict=True)]).tobytes())
            for s, places, texts in asked
        ])

    def finish(chunk: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, keys, texts, own = read(table)
        note, rest = note_of(replies)
        drop: dict[int, list[tuple[int, int]]] = {}
        if note is not None:
            repeated = np.unpackbits(np.frombuffer(note[1], np.uint8), count=note[0])
            for i, earlier in zip(np.flatnonzero(repeated).tolist(), answers(rest).tolist(), strict=True):
                *_, places, first = own.entries[i]
                for row, start, n in places:
                    if earlier or (int(keys[row]), start) > first:
                        drop.setdefault(row, []).append((start, n))
        n_passages = np.zeros(len(texts), np.int64)
        for *_, places, _ in own.entries:
            np.add.at(n_passages, [row for row, _, _ in places], 1)
        n_lines, removed, kept = [], [], []
        for row, text in enumerate(texts):
            lines = text.split(b"\n") if text is not None else []
            n_lines.append(len(lines))
            gone = np.zeros(len(lines), bool)
            for start, n in drop.get(row, ()):
                gone[start : start + n] = True
            removed.append(int(gone.sum()))
            kept.append(None if text is None else b"\n".join(x for x, g in zip(lines, gone.tolist(), strict=True) if not g) if removed[-1] else text)
        return pa.table({
            "doc_id": ids, "n_lines": pa.array(n_lines, pa.int64()), "n_passages": pa.array(n_passages),
            "n_removed_lines": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.binary()),
        })

    out = two_rounds(chunks, ask, merge, ask_again, resolve, finish, "doc_id long, n_lines long, n_passages long, n_removed_lines long, kept_text binary")
    return out.withColumn("kept_text", out["kept_text"].cast("string"))
