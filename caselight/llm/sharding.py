"""Shards by jump consistent hashing, with column functions only.

The shard of a row follows from its key and the number of shards by arithmetic, without a table
of the ring; with one shard more, rows move into the new shard only. Places inside a shard come
from counts per hash range and a window inside each range, so a shard is never one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import all_columns, comparable, unused, without

#: Multiplier of the published algorithm's generator, and the steps taken before the rare rest.
MULTIPLIER, STEPS = 2862933555777941757, 40
RANGE_DIGITS = 3


def hash_key(column: Column) -> Column:
    """64 uniform bits of a value as decimal(20, 0); a null is a value like others."""
    text = F.coalesce(column.cast("string"), F.lit("null")).cast("binary")
    return F.conv(F.substring(F.md5(text), 1, 16), 16, 10).cast("decimal(20,0)")


def jump_hash(key: Column, shards: int, grown: int | None = None) -> Column:
    """struct(shard, grown): bucket of an unsigned 64-bit key (decimal) among ``shards``, and
    among ``grown`` >= shards of them.

    The key's generator gives a strictly rising sequence of buckets; the last one below the
    number of shards is taken. After ``STEPS`` jumps, far more than needed, the few keys that
    aren't through yet go on until the number of jumps that can't be exceeded.
    """
    grown = grown or shards
    if not 1 <= shards <= grown:
        raise ValueError("shards must be positive")
    start = F.struct(key.alias("k"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"))

    def step(s: Column, _: Column) -> Column:
        k = ((s["k"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")) % F.lit(str(2**64)).cast("decimal(20,0)")).cast("decimal(20,0)")
        # floor((b + 1) * 2 ** 31 / ((k >> 33) + 1)) in whole numbers
        jump = F.call_function("div", (s["j"] + 1) * F.lit(2**31), F.call_function("div", k, F.lit(2**33)).cast("long") + 1)
        on = F.struct(
            k.alias("k"), jump.alias("j"),
            F.when(jump < shards, jump).otherwise(s["shard"]).alias("shard"),
            F.when(jump < grown, jump).otherwise(s["grown"]).alias("grown"),
        )
        return F.when(s["j"] < grown, on).otherwise(s)

    out = F.aggregate(F.sequence(F.lit(1), F.lit(min(STEPS, grown))), start, step)
    if grown > STEPS:
        out = F.when(out["j"] < grown, F.aggregate(F.sequence(F.lit(STEPS + 1), F.lit(grown)), out, step)).otherwise(out)
    return F.struct(out["shard"].cast("int").alias("shard"), out["grown"].cast("int").alias("grown"))


def sharded(docs: DataFrame, shards: int) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) with size, text_crc32, law, shard, slot and
    grown_shard.

    size is the text's UTF-8 bytes plus 8; a null text has no bytes and the checksum of none, 0.
    The law is ``key``: doc_id and the number of shards decide the shard; grown_shard is the one
    among one shard more, either the same or the new one. A null doc_id is a value like others;
    rows with the same doc_id share a shard. Slots are 0, 1, ... in every shard, in the order of
    a hash of doc_id and text, the same in every run; identical rows are interchangeable. An
    empty table gives no rows. Columns of ``docs`` named like the new ones are replaced.
    """
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    docs = without(docs, new)
    jump, order, range_, offset, n = unused(docs, "_jump", "_order", "_range", "_offset", "_n")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(text))
    rows = docs.select(
        *all_columns(docs), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        jump_hash(hash_key(F.col("doc_id")), shards, shards + 1).alias(jump), F.md5(name.cast("binary")).alias(order),
    )
    rows = rows.select("*", F.col(jump)["shard"].alias("shard"), F.substring(order, 1, RANGE_DIGITS).alias(range_))
    counts = rows.groupBy("shard", range_).agg(F.count(F.lit(1)).alias(n))
    until = F.sum(n).over(Window.partitionBy("shard").orderBy(range_))
    offsets = counts.select("shard", range_, (until - F.col(n)).alias(offset))
    others = [comparable(docs, c).cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    inside = Window.partitionBy("shard", range_).orderBy(order, *others)
    rows = rows.join(offsets, ["shard", range_])
    slot = (F.col(offset) + F.row_number().over(inside) - 1).cast("long")
    return rows.select(*all_columns(docs), "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), F.col(jump)["grown"].alias("grown_shard"))


def write_shards(rows: DataFrame, path: str) -> None:
    """Sharded rows as Parquet, a folder per shard, each file's rows in slot order."""
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
