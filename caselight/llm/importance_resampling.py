"""Documents that resemble a target, drawn by importance weights of hashed word n-grams.

A text is lower-cased (A-Z), everything between words becomes one space, and one overlapped
regex scan gives the span of the run of up to ``ORDER`` words that starts at each word; it and
its beginnings are the features. Their CRC-32 modulo the number of buckets is counted per
document and stored, so that texts are read once. Bucket counts of corpus and target give each
bucket a gain, the gains of a document's features add up to its weight, and the highest weights
with Gumbel noise from a hash of the id are drawn: a sample without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir
from .rounds import pack, unpack
from .shared import kept_aside
from .wordhash import sub_batches

ORDER, BUCKETS, SEED = 3, 10_000, 42
#: A-Z lower-cased; ASCII other than letters and digits becomes a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPACE = 32
#: Bytes of text that are scanned together, words whose features are summed together.
BATCH_BYTES, BLOCK_WORDS = 1 << 20, 200_000
#: Spans of more bytes than this are summed one by one.
_LONG = 96
#: Ranges of the score within which drawn rows are ranked.
RANGES = 512


def run_pattern(order: int = ORDER) -> regex.Pattern:
    """Runs of up to ``order`` words, from the start of a word to the end of one."""
    word, more = rb"[^ \n]++", b""
    for _ in range(order - 1):
        more = rb"(?: " + word + more + rb")?+"
    return regex.compile(rb"(?<![^ \n])" + word + more + rb"(?![^ \n])")


def collapsed(text: bytes | None) -> bytes:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text, A-Z lower-cased, with single
    spaces between them."""
    return b" ".join(text.translate(_TABLE).split()) if text else b""


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (out >> 1)
    return out


_CRC = _crc_table()


def crc32_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans of ``data``: one byte of every span at a time."""
    order = np.argsort(start - end, kind="stable")  # longest first
    at, length = start[order], (end - start)[order]
    state = np.full(len(at), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-length, -_LONG))
    for i in range(long):
        state[i] = zlib.crc32(data[at[i] : at[i] + length[i]].tobytes()) ^ 0xFFFFFFFF
    at, rest = at[long:], state[long:]
    # how many spans are longer than 0, 1, 2, ... bytes
    active = len(at) - np.cumsum(np.bincount(length[long:])) if len(at) else []
    for step, n in enumerate(active):
        rest[:n] = _CRC[(rest[:n] ^ data[at[:n] + step]) & 255] ^ (rest[:n] >> 8)
    out = np.empty(len(state), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def features_of(texts: list[bytes], pattern: regex.Pattern, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of collapsed texts: number of the text and bucket, sorted, and how often."""
    filled = [(i, t) for i, t in enumerate(texts) if t]
    joined = b"\n".join([t for _, t in filled]) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(data <= _SPACE)  # behind each word
    owner = np.repeat(np.array([i for i, _ in filled], np.int64), [t.count(b" ") + 1 for _, t in filled])
    spans = (m.span() for m in pattern.finditer(joined, overlapped=True))
    keys, counts, done = [], [], 0
    while len(block := np.fromiter(chain.from_iterable(islice(spans, BLOCK_WORDS)), np.int64)):
        start, last = block[::2], block[1::2]
        word = done + np.arange(len(start))
        hashes, owners = [], []
        for k in range(order):  # the run's first k + 1 words, where it has so many
            end = ends[np.minimum(word + k, len(ends) - 1)]
            there = (end <= last) & (word + k < len(ends))
            hashes.append(crc32_of(data, start[there], end[there]))
            owners.append(owner[word[there]])
        key, n = np.unique(np.concatenate(owners) * buckets + np.concatenate(hashes) % buckets, return_counts=True)
        keys.append(key)
        counts.append(n)
        done += len(start)
    if not keys:
        return (np.empty(0, np.int64),) * 3
    key, group = np.unique(np.concatenate(keys), return_inverse=True)
    return key // buckets, key % buckets, np.bincount(group, np.concatenate(counts)).astype(np.int64)


def counted(docs: DataFrame, text: str = "text", key: str = "doc_id", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """The stored feature counts of all rows of ``docs``, a row per batch of texts.

    Columns: ids, n_words and n_features, distinct (buckets of each text), total and payload
    (the buckets of all texts, text by text, and their counts).
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"ids array<{kind}>, n_words array<long>, n_features array<long>, distinct array<long>, total long, payload binary"
    pattern = run_pattern(order)

    def batch_row(ids: pa.Array, raw: list[bytes | None]) -> pa.RecordBatch:
        texts = [collapsed(t) for t in raw]
        words = [t.count(b" ") + 1 if t else 0 for t in texts]
        owner, bucket, n = features_of(texts, pattern, order, buckets)
        sizes = np.bincount(owner, minlength=len(texts))
        features = np.bincount(owner, n, minlength=len(texts)).astype(np.int64)
        offsets = pa.array([0, len(texts)], pa.int32())
        return pa.record_batch({
            "ids": pa.ListArray.from_arrays(offsets, ids),
            **{name: pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for name, x in (("n_words", words), ("n_features", features), ("distinct", sizes))},
            "total": pa.array([len(bucket)], pa.int64()),
            "payload": pa.array([pack(bucket.astype(np.uint32), n.astype(np.uint32))], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.binary_length(batch["text"]).fill_null(0).to_pylist()
            for a, b in sub_batches([s + 16 for s in sizes], BATCH_BYTES):
                yield batch_row(batch["id"].slice(a, b - a), batch["text"].slice(a, b - a).to_pylist())

    path = shared_dir(docs.sparkSession, "ngram-counts")
    docs.select(F.col(key).alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, schema).write.parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def bucket_totals(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for size, payload in zip(batch["total"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                bucket, n = unpack(payload, size, np.uint32, np.uint32)
                np.add.at(total, bucket, n.astype(np.int64))
        found = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(found, pa.int64()), "n": pa.array(total[found], pa.int64())})

    own = counts.select("total", "payload").mapInArrow(run, "bucket long, n long")
    return own.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of all buckets from the bucket totals of corpus and target: thousandths of
    the log ratio of their shares, each bucket counted once more on both sides, rounded down."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").na.fill(0)
    whole = Window.partitionBy()  # one row per bucket
    sums = both.select("bucket", "s", "t", F.sum("s").over(whole).alias("of_s"), F.sum("t").over(whole).alias("of_t"))
    as_double = lambda c, more: F.col(c).cast("double") + more
    ratio = as_double("t", 1) * as_double("of_s", buckets) / (as_double("s", 1) * as_double("of_t", buckets))
    return sums.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of standard Gumbel noise from a hash of the id, rounded down; a null id is an
    id like others."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weighed(counts: DataFrame, gain: list[int]) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every text of ``counts``; ``gain`` by bucket."""
    by_bucket = np.array(gain, np.int64)
    kind = counts.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c].slice(i, 1).flatten() for c in ("ids", "n_words", "n_features", "distinct")}
                bucket, n = unpack(batch["payload"][i].as_py(), batch["total"][i].as_py(), np.uint32, np.uint32)
                until = np.concatenate([[0], np.cumsum(by_bucket[bucket] * n)])
                last = np.cumsum(row["distinct"].to_numpy())
                weight = until[last] - until[last - row["distinct"].to_numpy()]
                yield pa.record_batch({"doc_id": row["ids"], "n_words": row["n_words"], "n_features": row["n_features"], "weight": pa.array(weight, pa.int64())})

    return counts.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, least_words: int = 20, percent: int = 5, ranges: int = RANGES) -> DataFrame:
    """``rows`` (doc_id, n_words, score, ...) with rank: 1, 2, 3... by falling score, ties by
    doc_id, for the first ``percent`` percent, rounded down, of those with ``least_words`` words.

    Quantiles of the score cut the drawn rows into ranges of about even size; counts per range
    say at which rank each begins, and rows are put in order within their range only.
    """
    fit = F.col("n_words") >= least_words
    middle = [1 - percent / 100 * (i + 1) / ranges for i in range(ranges)]
    facts = rows.where(fit).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("score", middle, 100_000).alias("edges")).first()
    wanted = percent * facts["n"] // 100
    edges = sorted(set(facts["edges"] or []), reverse=True)  # at most as many as ranges
    place = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e > F.col("score"))) if edges else F.lit(0)
    placed = rows.select("*", F.when(fit, place).otherwise(F.lit(-1)).alias("_range"))
    sizes = placed.where("_range >= 0").groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect()
    before, offsets = 0, {}  # at most ranges + 1 rows
    for row in sizes:
        if before < wanted:
            offsets[row["_range"]] = before
        before += row["n"]
    last = max(offsets, default=-1)
    order = Window.partitionBy("_range").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), *[F.asc(c) for c in rows.columns if c not in ("score", "doc_id")])
    start = F.get(F.array(*[F.lit(offsets.get(i, 0)) for i in range(last + 1)]), F.col("_range")) if offsets else F.lit(0)
    inside = F.col("_range").between(0, last)
    number = (F.row_number().over(order) + start).cast("long")
    first = placed.where(inside).select(*rows.columns, F.when(number <= wanted, number).alias("rank"))
    return first.unionByName(placed.where(~inside).select(*rows.columns, F.lit(None).cast("long").alias("rank")))


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, order: int = ORDER,
    buckets: int = BUCKETS, seed: int = SEED, target_key: str = "item_id",
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_features, weight, score, rank.

    Bucket counts cover every text of ``docs`` and of ``target`` (``target_key``, text). Texts
    without words (null, empty, separators only) have no features and weight 0; documents with
    fewer than ``least_words`` words are never drawn, rank is null for all that are not drawn.
    Rows that repeat a doc_id share its noise and are rows of their own in the draw; equal scores
    rank by doc_id, a null one last, rows equal in everything are interchangeable. Without target
    texts all buckets gain by rarity alone; an empty table gives no rows. doc_id keeps its type;
    other columns are ignored.
    """
    counts = counted(docs, order=order, buckets=buckets)
    aim = counted(target, key=target_key, order=order, buckets=buckets)
    table = gains(bucket_totals(counts, buckets), bucket_totals(aim, buckets), buckets)
    gain = [r["gain"] for r in table.orderBy("bucket").collect()]  # one number per bucket
    rows = weighed(counts, gain)
    score = F.col("weight") + gumbel(F.col("doc_id"), seed)
    out = kept_aside(rows.select("doc_id", "n_words", "n_features", "weight", score.alias("score")))
    return ranked(out, least_words, percent)


def drawn_documents(docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id was drawn, with all their columns; rows without doc_id
    are not found again."""
    wanted = ranks.where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("doc_id")).distinct()
    return docs.join(wanted, "doc_id", "left_semi").select([F.col(f"`{c}`") for c in docs.columns])
