"""Two rounds of questions between chunks of documents and blocks of a hash space.

Some operators ask of every passage of every text whether the same passage occurs elsewhere.
Here documents are dealt once into chunks of bounded size. Each chunk sums up its own passages
and sends one compact message to each block of the hash space; a block answers what it has seen
from all chunks. A second round asks more about the passages that remain. Texts are shuffled
once (Spark reuses that exchange), and a passage that a third of all documents share is one
entry per chunk, never one per document. A lost executor costs a recomputation of its tasks;
nothing is kept outside Spark's own shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_bytes

MESSAGE = "dest long, source long, part int, n long, payload binary"
_FIELDS = pa.schema([("dest", pa.int64()), ("source", pa.int64()), ("part", pa.int32()), ("n", pa.int64()), ("payload", pa.binary())])
#: Key of a row without doc_id: it comes before all others.
NO_ID = -(2**63)


def chunked(docs: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text as bytes) and the bytes of all texts; about ``chunk_bytes`` each."""
    total = text_bytes(docs)
    n = max(1, math.ceil(total / chunk_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))), total


def rows_of(table: pa.Table) -> tuple[pa.Array, np.ndarray, list[bytes | None]]:
    """A chunk's doc_ids, the same as sort keys, and its texts, ordered by (doc_id, text):
    Spark doesn't promise the order of a group's rows, and each round must see the same."""
    ids, texts = table["doc_id"].combine_chunks(), table["text"].to_pylist()
    keys = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
    order = sorted(range(len(keys)), key=lambda i: (keys[i], texts[i] is not None, texts[i] or b""))
    return ids.take(pa.array(order, pa.int64())), keys[order], [texts[i] for i in order]


def messages(rows: list[tuple[int, int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, _FIELDS, strict=True)], schema=_FIELDS)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length as compressed byte planes."""
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays)
    return pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpack(data: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    planes = np.frombuffer(pa.decompress(data, n * sum(widths), "zstd"), np.uint8)
    out, at = [], 0
    for kind, w in zip(kinds, widths, strict=True):
        out.append(np.ascontiguousarray(planes[at : at + n * w].reshape(w, n).T).view(kind).ravel())
        at += n * w
    return out


def answers(table: pa.Table) -> np.ndarray:
    """The bits that came back to a chunk, in the order of the parts it had sent."""
    rows = sorted(zip(table["part"].to_pylist(), table["n"].to_pylist(), table["payload"].to_pylist(), strict=True))
    bits = [np.unpackbits(np.frombuffer(p, np.uint8), count=n) for _, n, p in rows]
    return np.concatenate(bits).astype(bool) if bits else np.empty(0, bool)


def split_parts(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, start, end) of the runs of a sorted array of part numbers."""
    heads = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist()] if len(part) else []
    return [(int(part[a]), a, b) for a, b in zip(heads, [*heads[1:], len(part)])]


def two_rounds(
    chunks: DataFrame,
    ask: Callable[[int, pa.Table], pa.Table],
    merge: Callable[[int, pa.Table], pa.Table],
    ask_again: Callable[[int, pa.Table, pa.Table], pa.Table],
    resolve: Callable[[int, pa.Table], pa.Table],
    finish: Callable[[int, pa.Table, pa.Table], pa.Table],
    schema: str,
) -> DataFrame:
    """chunks -> ask -> merge per block -> ask_again -> resolve per block -> finish.

    Messages of ``ask`` go to the block ``dest``, those of ``merge`` and ``resolve`` back to the
    chunk ``dest``. A message of ``ask_again`` with a negative dest is a note of the chunk to
    itself (dest = -1 - chunk), which ``finish`` gets with part -1.
    """

    def noted(dest: int, table: pa.Table) -> pa.Table:
        if dest >= 0:
            return resolve(dest, table)
        return table.set_column(0, "dest", table["source"])

    def one(f):
        return lambda key, table: f(key[0].as_py(), table)

    def two(f):
        return lambda key, left, right: f(key[0].as_py(), left, right)

    by_chunk = chunks.groupBy("chunk")
    first = by_chunk.applyInArrow(one(ask), MESSAGE)
    merged = first.groupBy("dest").applyInArrow(one(merge), MESSAGE)
    second = by_chunk.cogroup(merged.groupBy("dest")).applyInArrow(two(ask_again), MESSAGE)
    resolved = second.groupBy("dest").applyInArrow(one(noted), MESSAGE)
    return by_chunk.cogroup(resolved.groupBy("dest")).applyInArrow(two(finish), schema)


def note_of(table: pa.Table) -> tuple[tuple[int, bytes] | None, pa.Table]:
    """The note that a chunk left for itself, and the answers of the blocks."""
    own = table.filter(pa.compute.equal(table["part"], -1))
    rest = table.filter(pa.compute.not_equal(table["part"], -1))
    return ((own["n"][0].as_py(), own["payload"][0].as_py()) if own.num_rows else None), rest
