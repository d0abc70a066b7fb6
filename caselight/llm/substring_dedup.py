"""Removal of repeated word windows, with a count-min sketch before the exact grouping.

First round: each chunk of documents sends the cells of its partition sketch (two rows of
cells, occupied cells with a saturating count); blocks of cells sum the partition sketches and
answer which cells count two or more. The sketch is as wide as eight cells a window and spread
over the blocks, so it is never broadcast and doesn't fill up as the corpus grows. A sketch
only overestimates: a window with a cell below two occurs once. Second round: the windows
estimated repeated, once per chunk, go with a 128-bit hash and their earliest place to blocks
that group them exactly and answer where an earlier place exists.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .rounds import answers, chunked, messages, note_of, pack, rows_of, split_parts, two_rounds, unpack
from .wordhash import U64, WordHashes, mix, rolling

CELL_BITS = 25
WINDOWS_PER_BLOCK = 2**22
WINDOWS_PER_GROUP_BLOCK = 2**20
SKETCH_ROWS = 2
_SALTS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_HASHES = WordHashes()


class _Windows:
    """Hashes of all windows of a chunk, in the order of its rows."""

    def __init__(self, keys: np.ndarray, texts: list[bytes | None], size: int):
        per_doc = [_HASHES.of(t.split()) if t else np.empty(0, U64) for t in texts]
        self.size, self.doc_keys = size, keys
        self.lengths = np.array([len(h) for h in per_doc], np.int64)
        self.words = np.concatenate(per_doc) if per_doc else np.empty(0, U64)
        doc = np.repeat(np.arange(len(per_doc), dtype=np.int32), self.lengths)
        inside = doc[: len(doc) - size + 1] == doc[size - 1 :] if len(doc) >= size else np.empty(0, bool)
        self.at = np.flatnonzero(inside)  # place of each window among the words of the chunk
        self.doc = doc[self.at]
        self.hash = mix(rolling(self.words, size, 0x9FB21C651E98DF25)[self.at]) if len(self.at) else np.empty(0, U64)

    def cells(self, row: int, blocks: int) -> np.ndarray:
        """Block and cell of each window in a row of the sketch, as one integer."""
        x = mix(self.hash ^ U64(_SALTS[row]))
        block = ((x >> U64(40)) * U64(blocks)) >> U64(24)
        return block << U64(CELL_BITS) | x & U64(2**CELL_BITS - 1)

    def identities(self, chosen: np.ndarray, blocks: int):
        """The distinct windows among the chosen ones.

        Returns the group of each chosen window, whether it starts later than the earliest of
        its group, and per group: block, both hashes, doc key and start of the earliest.
        Groups are numbered by block, then by place.
        """
        h1 = self.hash[chosen]
        h2 = mix(rolling(mix(self.words ^ U64(_SALTS[1])), self.size, 0xC2B2AE3D27D4EB4F)[self.at[chosen]])
        first_word = np.cumsum(self.lengths) - self.lengths
        start = (self.at[chosen] - first_word[self.doc[chosen]]).astype(np.uint32)
        key = self.doc_keys[self.doc[chosen]]
        if len(np.unique(self.doc_keys)) == len(self.doc_keys):
            rank = np.arange(len(chosen))
        else:  # rows that repeat a doc_id: equal places must rank equal
            order = np.lexsort((start, key))
            new = np.ones(len(order), bool)
            new[1:] = (key[order][1:] != key[order][:-1]) | (start[order][1:] != start[order][:-1])
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum(new)
        order = np.lexsort((rank, h2, h1))
        new = np.ones(len(order), bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        heads = order[new]  # the earliest window of each group
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        later = rank > rank[heads][group]
        block = (((h1[heads] >> U64(40)) * U64(blocks)) >> U64(24)).astype(np.int64)
        place = np.lexsort((rank[heads], block))
        number = np.empty(len(place), np.int64)
        number[place] = np.arange(len(place))
        heads = heads[place]
        return number[group], later, block[place], h1[heads], h2[heads], key[heads], start[heads]


def remove_repeated_windows(docs: DataFrame, window: int = 20, chunk_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_text.

    A word goes if some run of ``window`` words that covers it occurs earlier: at a smaller
    (doc_id, start). Windows are judged on the input. Words are split at spaces and U+0009 to
    U+000D and compared unchanged; the kept ones are joined by one space. Null, empty and
    shorter texts keep all their words. A null doc_id comes before all others; rows with the
    same doc_id are the same document, so equal starts don't remove each other. An empty table
    gives no rows; other columns of ``docs`` are ignored.
    """
    chunks, total = chunked(docs, chunk_bytes)
    expected = max(1, total // 6)  # words; a shorter average only makes the blocks larger
    blocks = max(1, math.ceil(expected / WINDOWS_PER_BLOCK))
    group_blocks = max(1, math.ceil(expected / WINDOWS_PER_GROUP_BLOCK))
    cell_mask = U64(2**CELL_BITS - 1)

    def ask(chunk: int, table: pa.Table) -> pa.Table:
        _, keys, texts = rows_of(table)
        w = _Windows(keys, texts, window)
        out = []
        for row in range(SKETCH_ROWS):
            cells = np.sort(w.cells(row, blocks))
            new = np.ones(len(cells), bool)
            new[1:] = cells[1:] != cells[:-1]
            heads = np.flatnonzero(new)
            twice = np.diff(np.append(heads, len(cells))) > 1
            cells = cells[heads]
            for block, a, b in split_parts(cells >> U64(CELL_BITS)):
                own = (cells[a:b] & cell_mask).astype(np.uint32)
                steps = pack(np.diff(own, prepend=np.uint32(0)))
                dest = row * blocks + block
                bits = np.packbits(twice[a:b]).tobytes()
                out.append((dest, chunk, dest, b - a, len(bits).to_bytes(4, "little") + bits + steps))
        return messages(out)

    def merge(dest: int, table: pa.Table) -> pa.Table:
        seen, repeated, asked = np.zeros(2**CELL_BITS, bool), np.zeros(2**CELL_BITS, bool), []
        for source, n, payload in zip(table["source"].to_pylist(), table["n"].to_pylist(), table["payload"].to_pylist(), strict=True):
            k = int.from_bytes(payload[:4], "little")
            twice = np.unpackbits(np.frombuffer(payload[4 : 4 + k], np.uint8), count=n).astype(bool)
            cells = np.cumsum(unpack(payload[4 + k :], n, np.uint32)[0], dtype=np.uint32)
            repeated[cells[seen[cells] | twice]] = True
            seen[cells] = True
            asked.append((source, cells))
        return messages([(source, source, dest, len(cells), np.packbits(repeated[cells]).tobytes()) for source, cells in asked])

    def ask_again(chunk: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        _, keys, texts = rows_of(table)
        w = _Windows(keys, texts, window)
        if not len(w.hash):
            return messages([])
        maybe, bits, at = np.ones(len(w.hash), bool), answers(replies), 0
        for row in range(SKETCH_ROWS):
            cells = w.cells(row, blocks)
            order = np.argsort(cells)
            new = np.ones(len(order), bool)
            new[1:] = cells[order][1:] != cells[order][:-1]
            number = np.cumsum(new) - 1
            maybe[order] &= bits[at + number]
            at += int(number[-1]) + 1
        chosen = np.flatnonzero(maybe)
        out = [(-1 - chunk, chunk, -1, len(maybe), pack(np.packbits(maybe)))]
        if len(chosen):
            _, _, block, h1, h2, key, start = w.identities(chosen, group_blocks)
            for b, x, y in split_parts(block):
                steps = np.diff(key[x:y], prepend=np.int64(0))
                out.append((b, chunk, b, y - x, h1[x:y].tobytes() + h2[x:y].tobytes() + pack(steps, start[x:y])))
        return messages(out)

    def resolve(block: int, table: pa.Table) -> pa.Table:
        sources, sizes = table["source"].to_pylist(), table["n"].to_pylist()
        columns = [[], [], [], []]
        for n, payload in zip(sizes, table["payload"].to_pylist(), strict=True):
            steps, start = unpack(payload[16 * n :], n, np.int64, np.uint32)
            for column, part in zip(columns, (np.frombuffer(payload, U64, n), np.frombuffer(payload, U64, n, 8 * n), np.cumsum(steps), start), strict=True):
                column.append(part)
        h1, h2, key, start = map(np.concatenate, columns)
        order = np.lexsort((start, key, h2, h1))
        h1, h2, key, start = h1[order], h2[order], key[order], start[order]
        new = np.ones(len(order), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        earlier = np.empty(len(order), bool)
        earlier[order] = (key != key[head]) | (start != start[head])
        ends = np.cumsum(sizes).tolist()
        return messages([(s, s, block, n, np.packbits(earlier[e - n : e]).tobytes()) for s, n, e in zip(sources, sizes, ends, strict=True)])

    def finish(chunk: int, table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, keys, texts = rows_of(table)
        w = _Windows(keys, texts, window)
        gone = np.zeros(len(w.words) + 1, np.int32)
        note, rest = note_of(replies)
        if note is not None:
            maybe = np.unpackbits(unpack(note[1], (note[0] + 7) // 8, np.uint8)[0], count=note[0]).astype(bool)
            chosen = np.flatnonzero(maybe)
            if len(chosen):
                group, later, *_ = w.identities(chosen, group_blocks)
                starts = w.at[chosen[later | answers(rest)[group]]]
                gone[starts] += 1
                gone[starts + window] -= 1
        covered = np.cumsum(gone[:-1]) > 0
        kept, removed, at = [], [], 0
        for text, n in zip(texts, w.lengths.tolist(), strict=True):
            drop = covered[at : at + n]
            at += n
            removed.append(int(drop.sum()))
            words = text.split() if text else []
            if removed[-1]:
                words = [x for x, d in zip(words, drop.tolist(), strict=True) if not d]
            kept.append(b" ".join(words))
        return pa.table({"doc_id": ids, "n_words": pa.array(w.lengths), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.binary())})

    out = two_rounds(chunks, ask, merge, ask_again, resolve, finish, "doc_id long, n_words long, n_removed long, kept_text binary")
    return out.withColumn("kept_text", out["kept_text"].cast("string"))
