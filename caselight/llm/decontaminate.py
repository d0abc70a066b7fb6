"""Benchmark passages in training documents, through a distributed positional inverted index.

Index: each task deals its documents into chunks of bounded size and writes, per chunk and term,
the places of the term among the chunk's words, and per chunk its documents with their lengths.
The table lies in the shared folder, so a search can read it again, and executors can go.

Search: test items come in blocks of bounded size. Only the posting lists of a block's terms are
read; in every chunk the places of each phrase's rarest term are shifted to phrase starts and
intersected with the shifted lists of its other terms, rarest first. No pair of document and item
is formed unless the rarest term occurs, and documents are never moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .rounds import pack, unpack

#: A-Z lower-cased; ASCII other than letters and digits separates words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
INDEX = "chunk long, term binary, n long, places binary, doc_ids array<long>, lengths array<long>"
_SCHEMA = pa.schema([("chunk", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("places", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
_SHORT = 24  # lists of fewer places are stored as they are


def terms_of(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased."""
    return text.translate(_TABLE).split() if text else []


def _chunk_rows(chunk: int, ids: list, texts: list[bytes | None]) -> Iterator[pa.RecordBatch]:
    numbers: dict[bytes, int] = {}
    parts, lengths = [], []
    for text in texts:
        own = terms_of(text)
        lengths.append(len(own))
        parts.append(np.fromiter((numbers.setdefault(x, len(numbers)) for x in own), np.uint32, len(own)))
    term = np.concatenate(parts)
    order = np.argsort(term, kind="stable").astype(np.uint32)
    ends = np.cumsum(np.bincount(term, minlength=len(numbers))).tolist() if numbers else []
    places, counts, start = [], [], 0
    for end in ends:
        own = order[start:end]
        counts.append(end - start)
        places.append(own.tobytes() if end - start < _SHORT else pack(np.diff(own, prepend=np.uint32(0))))
        start = end
    names = list(numbers)
    yield pa.record_batch([[chunk], [None], [len(term)], [None], [ids], [lengths]], schema=_SCHEMA)
    for a in range(0, len(names), 20_000):
        part = slice(a, a + 20_000)
        k = len(names[part])
        yield pa.record_batch([[chunk] * k, names[part], counts[part], places[part], [None] * k, [None] * k], schema=_SCHEMA)


def _decode(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint32) if n < _SHORT else np.cumsum(unpack(data, n, np.uint32)[0], dtype=np.uint32)


def build_index(docs: DataFrame, chunk_bytes: int = 4 << 20) -> DataFrame:
    """The stored index of ``docs`` (doc_id, text): all terms of all texts.

    Columns: chunk; term, or null in the one row per chunk that lists its documents; n places;
    the places; doc_ids and lengths in words, in the order of the chunk's words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids.append(i)
                texts.append(text)
                size += len(text or b"") + 8
                if size >= chunk_bytes:
                    yield from _chunk_rows(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield from _chunk_rows(number, ids, texts)

    spark = docs.sparkSession
    path = shared_dir(spark, "positional-index")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


class _Chunk:
    """Posting lists of the wanted terms and documents of one chunk."""

    def __init__(self, table: pa.Table, numbers: dict[bytes, int]):
        lists: list[np.ndarray] = [np.empty(0, np.uint32)] * len(numbers)
        for term, n, places, ids, lengths in zip(*(table[c].to_pylist() for c in ("term", "n", "places", "doc_ids", "lengths")), strict=True):
            if term is None:
                self.ids, self.lengths = ids, np.array(lengths, np.int64)
            elif term in numbers:
                lists[numbers[term]] = _decode(places, n)
        self.ends = np.cumsum(self.lengths)
        self.count = np.array([len(x) for x in lists], np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.keys = np.concatenate([x.astype(np.int64) | i << 32 for i, x in enumerate(lists)]) if lists else np.empty(0, np.int64)

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the term in ``terms``, place) for all places of all terms."""
        n = self.count[terms]
        which = np.repeat(np.arange(len(terms)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + self.first[terms][which]
        return which, self.keys[at] & 0xFFFFFFFF

    def has(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        wanted = places | terms << 32
        at = np.searchsorted(self.keys, wanted)
        return (places >= 0) & (self.keys[np.minimum(at, len(self.keys) - 1)] == wanted)

    def near(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term occurs at a place from low to high."""
        at = np.searchsorted(self.keys, low | terms << 32)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= (high | terms << 32))

    def between(self, terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the term in ``terms``, place) for the places of each term from low to high."""
        first = np.searchsorted(self.keys, low | terms << 32)
        n = np.searchsorted(self.keys, high | terms << 32, side="right") - first
        which = np.repeat(np.arange(len(terms)), n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + first[which]
        return which, self.keys[at] & 0xFFFFFFFF

    def doc(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, side="right")


class _Phrases:
    """Distinct phrases of a block of items: term numbers, lengths, and the items of each."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int | None):
        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str | None]] = {}
        for name, own in items:
            ids = [self.numbers.setdefault(x, len(self.numbers)) for x in own]
            if size is None:  # the set of words
                found.setdefault(tuple(sorted(set(ids))), set()).add(name)
            else:
                k = min(size, len(ids))
                for j in range(len(ids) - k + 1):
                    found.setdefault(tuple(ids[j : j + k]), set()).add(name)
        width = max(map(len, found), default=1)
        self.length = np.array([len(p) for p in found], np.int64)
        self.terms = np.array([[*p, *[0] * (width - len(p))] for p in found], np.int64).reshape(len(found), width)
        self.names = [sorted(x, key=str) for x in found.values()]

    def by_rarity(self, chunk: _Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases whose terms all occur in the chunk; their terms' offsets, rarest first; how
        often the rarest occurs."""
        inside = np.arange(self.terms.shape[1]) < self.length[:, None]
        count = np.where(inside, chunk.count[self.terms], np.iinfo(np.int64).max)
        order = np.argsort(count, axis=1, kind="stable")
        rarest = np.take_along_axis(count, order[:, :1], 1)[:, 0]
        there = np.flatnonzero(rarest > 0)
        return there, order[there], rarest[there]


_HIT = "chunk long, at long, items array<string>, words array<int>"


def _report(chunk: int, c: _Chunk, phrases: _Phrases, phrase: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    """Per document with matches (phrase, start, end): its items and the words inside them."""
    doc = c.doc(start)
    steps = np.zeros(int(c.lengths.sum()) + 1, np.int64)
    np.add.at(steps, start, 1)
    np.add.at(steps, end, -1)
    words = np.flatnonzero(np.cumsum(steps) > 0)
    word_doc = c.doc(words)
    first = c.ends - c.lengths
    items: dict[int, set] = {}
    both = np.unique(np.stack([doc, phrase]), axis=1)
    for d, p in both.T.tolist():
        items.setdefault(d, set()).update(phrases.names[p])
    rows = sorted(items)
    cuts = np.searchsorted(word_doc, rows), np.searchsorted(word_doc, rows, side="right")
    return pa.table({
        "chunk": pa.array([chunk] * len(rows), pa.int64()), "at": pa.array(rows, pa.int64()),
        "items": pa.array([["" if x is None else x for x in items[d]] for d in rows], pa.list_(pa.string())),
        "words": pa.array([(words[a:b] - first[d]).astype(np.int32) for d, a, b in zip(rows, *cuts, strict=True)], pa.list_(pa.int32())),
    })


def _exact(phrases: _Phrases, c: _Chunk, most: int = 1_000_000):
    there, order, rarest = phrases.by_rarity(c)
    slabs = np.split(np.arange(len(there)), np.flatnonzero(np.diff(np.cumsum(rarest) // most)) + 1) if len(there) else []
    for slab in slabs:
        own, offsets = there[slab], order[slab]
        which, place = c.places(phrases.terms[own, offsets[:, 0]])
        start = place - offsets[which, 0]
        for k in range(1, phrases.terms.shape[1]):
            more = phrases.length[own[which]] > k
            offset = offsets[which, k]
            ok = ~more | c.has(phrases.terms[own[which], offset], start + offset)
            which, start = which[ok], start[ok]
        end = start + phrases.length[own[which]]
        ok = (start >= 0) & (c.doc(np.maximum(start, 0)) == c.doc(end - 1))
        yield own[which[ok]], start[ok], end[ok]


def _near(phrases: _Phrases, c: _Chunk, within: int, most: int = 1_000_000):
    """Places of the items' words around which the whole item occurs.

    They lie at most ``within`` words from an occurrence of the item's rarest word, and all its
    words at most twice as far: the rarest word only says where to look.
    """
    there, order, rarest = phrases.by_rarity(c)
    slabs = np.split(np.arange(len(there)), np.flatnonzero(np.diff(np.cumsum(rarest) // most)) + 1) if len(there) else []
    bounds = c.ends - c.lengths, c.ends - 1

    def around(place: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        doc = c.doc(place)
        return np.maximum(place - distance, bounds[0][doc]), np.minimum(place + distance, bounds[1][doc])

    def whole(phrase: np.ndarray, place: np.ndarray, distance: int) -> np.ndarray:
        low, high = around(place, distance)
        ok = np.ones(len(phrase), bool)
        for k in range(phrases.terms.shape[1]):
            more = np.flatnonzero(ok & (phrases.length[phrase] > k))
            ok[more] = c.near(phrases.terms[phrase[more], k], low[more], high[more])
        return ok

    for slab in slabs:
        own, offsets = there[slab], order[slab]
        which, place = c.places(phrases.terms[own, offsets[:, 0]])
        phrase = own[which]
        ok = whole(phrase, place, 2 * within)
        phrase, place = phrase[ok], place[ok]
        step = max(1, most // (2 * within + 1))  # distinct words have 2 * within + 1 places around one
        for a in range(0, len(phrase), step):
            part, low, high = phrase[a : a + step], *around(place[a : a + step], within)
            found = []
            for k in range(phrases.terms.shape[1]):
                at = np.flatnonzero(phrases.length[part] > k)
                which, near = c.between(phrases.terms[part[at], k], low[at], high[at])
                found.append(np.stack([part[at][which], near]))
            of, near = np.unique(np.concatenate(found, axis=1), axis=1)
            ok = whole(of, near, within)
            yield of[ok], near[ok], near[ok] + 1


def _matcher(phrases: _Phrases, size: int | None, within: int):
    def run(key, table):
        c = _Chunk(table, phrases.numbers)
        found = list(_exact(phrases, c) if size is not None else _near(phrases, c, within))
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 3
        return _report(key[0].as_py(), c, phrases, *parts)

    return run


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The test items, a bounded block at a time."""
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).where("text is not null")
    for name, text in rows.toLocalIterator():
        own = terms_of(bytes(text))
        if own:
            block.append((name, own))
            size += len(text)
            if size >= block_bytes:
                yield block
                block, size = [], 0
    if block:
        yield block


def _search(index: DataFrame, items: DataFrame, size: int | None, within: int, block_bytes: int) -> DataFrame:
    """Per document with a match: chunk, at, items, words (places inside matches)."""
    spark = index.sparkSession
    hits = spark.createDataFrame([], _HIT)
    for block in _blocks(items, block_bytes):
        phrases = _Phrases(block, size)

        # at most block_bytes of terms: a bounded side
        terms = spark.createDataFrame([(bytearray(t),) for t in phrases.numbers], "term binary")
        lists = index.where("term is not null").join(F.broadcast(terms), "term", "left_semi").select(index.columns)
        hits = hits.union(lists.union(index.where("term is null")).groupBy("chunk").applyInArrow(_matcher(phrases, size, within), _HIT))
    return hits.groupBy("chunk", "at").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"),
    )


def _per_document(index: DataFrame, hits: DataFrame) -> DataFrame:
    docs = index.where("term is null").select("chunk", F.posexplode(F.arrays_zip("doc_ids", "lengths")).alias("at", "doc"))
    docs = docs.select("chunk", F.col("at").cast("long").alias("at"), F.col("doc.doc_ids").alias("doc_id"), F.col("doc.lengths").alias("n_words"))
    return docs.join(hits, ["chunk", "at"], "left").select(
        "doc_id", "n_words",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("words", F.array().cast("array<int>")).alias("hit_words"),
    )


def phrase_matches(index: DataFrame, items: DataFrame, size: int = 10, block_bytes: int = 1 << 20) -> DataFrame:
    """One row per indexed document: doc_id, n_words, items (ids as sorted strings, of items with
    a phrase in the document), hit_words (places of the words inside any occurrence).

    A phrase is ``size`` consecutive words of an item (item_id, text); an item of fewer words is
    one phrase; null, empty and wordless items match nothing. A null item_id is reported as the
    empty string, items that repeat an item_id are one. Null and empty texts have no words;
    repeated rows and null doc_ids are documents of their own. Empty tables are fine.
    """
    return _per_document(index, _search(index, items, size, 0, block_bytes))


def proximity_matches(index: DataFrame, items: DataFrame, within: int = 30, block_bytes: int = 1 << 20) -> DataFrame:
    """As ``phrase_matches``, but an item matches around an occurrence of any of its words if
    every word of it occurs in that document at most ``within`` words away, in any order;
    hit_words are those occurrences. Only the document and the item decide."""
    return _per_document(index, _search(index, items, None, within, block_bytes))
