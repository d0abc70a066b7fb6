"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification, union-find.

1. One pass over the texts gives each document its number of shingles, a 128-bit digest of its
   shingle set and a 64-bit key per signature band. Equal sets are one node from here on (the
   smallest doc_id of the set), so groups of copies shrink before anything is shuffled by band.
2. In each band bucket every node is paired with the bucket's smallest node only, never with
   all others. Pairs are confirmed on the full shingle sets; confirmed links are merged.
3. What such stars can miss are links inside buckets whose nodes still lie in different
   groups. The nodes of these buckets are compared through their rarest shingles (prefix and
   position filter): two sets that reach the threshold must share one there, so nothing that
   shares a bucket is lost. These pairs are confirmed and merged in the same way.

With 32 bands of 4 slots a pair of similarity 0.8 shares no bucket with probability 5e-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import kept_aside, map_batches
from .superminhash import band_keys, signatures
from .wordhash import U64, WordHashes, combine, sub_batches

_HASHES = WordHashes()
#: Shingles that are signed at once; each needs a permutation of all slots.
SHINGLES = 40_000


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; A-Z are lower-cased.

    A text with fewer words than ``size`` has one shingle, its whole word sequence; a text
    without words, an empty text or None has none.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, U64)
    h = _HASHES.of(words)
    k = min(size, len(h))
    return np.unique(combine([h[i : len(h) - k + 1 + i] for i in range(k)], salt=k))


def _sketch(size: int, slots: int, rows: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, size) for t in batch["text"].to_pylist()]
        lengths = [len(s) for s in sets]
        keys = []
        for a, b in sub_batches(lengths, SHINGLES):
            owner = np.repeat(np.arange(b - a), lengths[a:b])
            keys.append(band_keys(signatures(np.concatenate(sets[a:b]), owner, b - a, slots), rows))
        n_bands = slots // rows
        flat = np.concatenate(keys).view(np.int64).ravel()
        offsets = np.arange(0, len(flat) + 1, n_bands, dtype=np.int32)
        return pa.record_batch({
            "doc_id": batch["doc_id"],
            "n_shingles": pa.array(lengths, pa.int64()),
            "digest": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            "bands": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
        })

    return run


def _sets(size: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, size) for t in batch["text"].to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        return pa.record_batch({
            "node": batch["node"],
            "shingles": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64))),
        })

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    first = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    second = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(second, "b").join(first, "a")
        .select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("total"))
        .where(100 * F.col("common") >= percent * (F.col("total") - F.col("common")))
        .select("a", "b").distinct()
    )


def _rare_shingle_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different labels that can reach the threshold, by prefix filter.

    ``nodes``: (node, label). Shingles are ordered by how many of these nodes have them. Two
    sets that reach the threshold share a shingle among the first n - ceil(t n) + 1 of each,
    and behind the shared place enough must be left for the overlap that the sizes demand.
    """
    n = F.size("shingles")
    own = sets.join(nodes, "node").select("node", "label", n.alias("n"), F.explode("shingles").alias("shingle"))
    spread = own.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    ordered = (
        own.join(spread, "shingle").groupBy("node", "label", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("ranked"))
    )
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    posted = ordered.select("node", "label", "n", F.posexplode(F.slice("ranked", 1, length.cast("int"))).alias("at", "x"))
    posted = posted.where("x.df > 1").select("node", "label", "n", "at", F.col("x.shingle").alias("shingle"))
    x, y = posted.alias("x"), posted.alias("y")
    overlap = percent / (100 + percent) * (F.col("x.n") + F.col("y.n")) - 1e-6
    left = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    fits = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & (left >= overlap)
    return x.join(y, fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, slots: int = 128, rows: int = 4
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents link when 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id reachable over links, the document's own included, and
    kept marks it. A document is its doc_id: rows that repeat a doc_id get the same component,
    which joins what any of them links to. Null, empty and blank texts have no shingles and
    link with nothing. A row without doc_id links with nothing either, its component_id is null
    and it is kept. An empty table gives no rows; other columns of ``docs`` are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sketch = kept_aside(map_batches(texts, _sketch(shingle, slots, rows), "doc_id long, n_shingles long, digest binary, bands array<long>"))
    known = sketch.where("doc_id is not null and digest is not null")
    # equal sets are one node, named by their smallest document
    equal = known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    own = known.select("doc_id", "digest").distinct().join(equal.select("digest", "node"), "digest").select("doc_id", "node")
    own = kept_aside(own)
    banded = equal.select("node", "n", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last")
    members = kept_aside(banded.join(buckets.select("key", "leader"), "key"))
    found = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    pairs = kept_aside(found)
    several = own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
    same_id = own.join(several, "doc_id").select("a", F.col("node").alias("b"))

    wanted = members.select("node").distinct()
    chosen = texts.join(wanted, texts["doc_id"] == wanted["node"]).select("node", "text")
    sets = kept_aside(map_batches(chosen, _sets(shingle), "node long, shingles array<long>"))
    links = kept_aside(_confirmed(pairs, sets, percent).union(same_id))
    label = components(links)

    labelled = members.select("key", "node").distinct().join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("size")).where("x < y and size > 2")
    open_nodes = kept_aside(labelled.join(mixed.select("key"), "key", "left_semi").select("node", "label").distinct())
    rest = _rare_shingle_pairs(open_nodes, sets, percent).join(pairs, ["a", "b"], "left_anti")
    more = kept_aside(_confirmed(rest, sets, percent))
    names = label.select(F.col("node").alias("x"), "label")
    more = (
        more.join(names, F.col("a") == F.col("x"), "left").select(F.coalesce("label", "a").alias("a"), "b")
        .join(names, F.col("b") == F.col("x"), "left").select("a", F.coalesce("label", "b").alias("b"))
    )
    higher = components(more).select(F.col("node").alias("label"), F.col("label").alias("top"))
    label = label.join(higher, "label", "left").select("node", F.coalesce("top", "label").alias("label")).union(
        # groups that were single nodes until now
        higher.join(label, higher["label"] == label["node"], "left_anti").select("label", "top")
    )
    grouped = own.join(label, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "node")).alias("component_id"))
    out = sketch.select("doc_id", "n_shingles").join(grouped, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
