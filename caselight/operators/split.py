"""Splits by global time order without a global sort.

The rows at given positions of the order (created_at, ticket_id) are found by
narrowing: counts per day, per second of that day, per instant, then per identifier
prefix. Each step reads only the rows of the buckets found before, for all positions at
once, and brings a row per position to the driver. Every row is then compared with the cut
keys. Rows without a time come after all others, rows without an identifier after the
others of their time, so every row has its place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

_DAY, _SECOND = 86_400_000_000, 1_000_000
#: Identifiers are narrowed by this many further characters at a time.
PREFIX = 3
#: Stands for a missing identifier: behind every other one.
LAST_ID = "\U0010ffff"


@dataclass(frozen=True)
class CutKey:
    """The last row, in order, that still belongs to the head; ``micros`` is None in the
    rows without a time."""

    micros: int | None
    ticket_id: str

    def head(self, time: str = "created_at", ident: str = "ticket_id") -> Column:
        at, own = F.unix_micros(time), F.coalesce(F.col(ident), F.lit(LAST_ID))
        if self.micros is None:
            return at.isNotNull() | (own <= self.ticket_id)
        return F.coalesce((at < self.micros) | ((at == self.micros) & (own <= self.ticket_id)), F.lit(False))


def _narrow(rows: DataFrame, bucket: Column, ranks: dict[int, int]) -> dict[int, tuple]:
    """For each wanted position: its bucket, and its rank among the rows of the bucket.

    ``ranks`` gives the rank of a position within its group ``g`` of ``rows``; one job for all
    positions. The counts are combined before the shuffle, and the window runs over the
    distinct buckets of a group.
    """
    order = Window.partitionBy("g").orderBy(F.col("b").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(r).alias("r"), F.lit(k).alias("k")) for k, (g, r) in ranks.items()])
    counts = rows.groupBy("g", bucket.alias("b")).agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(order))
    inside = F.filter(wanted, lambda w: (w["g"] == F.col("g")) & (w["r"] > F.col("upto") - F.col("c")) & (w["r"] <= F.col("upto")))
    hits = counts.withColumn("hit", F.explode(inside)).select("hit.k", "b", (F.col("hit.r") - F.col("upto") + F.col("c")).alias("r"), "c")
    return {h["k"]: (h["b"], h["r"], h["c"]) for h in hits.collect()}  # one row per position


def cut_keys(df: DataFrame, ranks: list[int], time: str = "created_at",
             ident: str = "ticket_id", sort_rows: int = 100_000) -> list[CutKey | None]:
    """Keys of the rows at 1-based positions; None for a position before the first row.

    As soon as the buckets found hold at most ``sort_rows`` rows each, their rows are put in
    order instead of being narrowed further; that changes the number of passes only.
    """
    wanted = {k: (0, r) for k, r in enumerate(ranks) if r > 0}
    if not wanted:
        return [None] * len(ranks)
    rows = df.select(F.lit(0).alias("g"), F.col(time).alias("ts"), F.unix_micros(time).alias("at"),
                     F.coalesce(F.col(ident), F.lit(LAST_ID)).alias("id"))

    def step(rows: DataFrame, bucket: Column, wanted: dict) -> tuple[DataFrame, dict, dict]:
        """The rows of the buckets found, each (group, bucket) a group of the next step."""
        found = _narrow(rows, bucket, wanted)
        name = lambda g, b: f"{g}|{'none' if b is None else b}"
        groups = {key: n for n, key in enumerate(dict.fromkeys(name(wanted[k][0], h[0]) for k, h in found.items()))}
        table = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
        own = F.concat(F.col("g"), F.lit("|"), F.coalesce(bucket.cast("string"), F.lit("none")))
        inner = rows.withColumn("g", F.try_element_at(table, own)).filter(F.col("g").isNotNull())
        return inner, {k: (groups[name(wanted[k][0], h[0])], h[1]) for k, h in found.items()}, found

    def in_order() -> list[CutKey | None]:
        keys: list[CutKey | None] = [None] * len(ranks)
        for k, (g, r) in wanted.items():
            row = rows.filter(F.col("g") == g).orderBy(F.col("at").asc_nulls_last(), "id").offset(r - 1).limit(1).first()
            keys[k] = CutKey(row["at"], row["id"])
        return keys

    times: dict[int, int | None] = {}
    for width in (_DAY, _SECOND, 1):
        rows, wanted, found = step(rows, F.floor(F.col("at") / width).cast("long") if width > 1 else F.col("at"), wanted)
        spans = F.lit(False)
        for bucket in {h[0] for h in found.values()}:
            # ranges of the column itself, so that files can be skipped
            spans |= F.col("ts").isNull() if bucket is None else (
                (F.col("ts") >= F.timestamp_micros(F.lit(bucket * width))) & (F.col("ts") < F.timestamp_micros(F.lit((bucket + 1) * width))))
        rows = rows.filter(spans)
        if max(h[2] for h in found.values()) <= sort_rows:
            return in_order()
        times = {k: None if h[0] is None else h[0] * width for k, h in found.items()}
    idents: dict[int, str] = {}
    size = 0
    while wanted:
        size += PREFIX
        rows, wanted, found = step(rows, F.substring("id", 1, size), wanted)
        # a prefix shorter than asked for is the whole identifier; so is that of a single row
        idents |= {k: h[0] for k, h in found.items() if len(h[0]) < size}
        wanted = {k: w for k, w in wanted.items() if k not in idents}
    return [CutKey(times[k], idents[k]) if k in idents else None for k in range(len(ranks))]


def temporal_split(df: DataFrame, train_ratio: float = 0.70, val_ratio: float = 0.15) -> DataFrame:
    """Add ``data_split``: the oldest rows train, then val, the newest test."""
    n = df.count()
    train, val = cut_keys(df, [int(n * train_ratio), int(n * (train_ratio + val_ratio))])
    split = F.lit("test")
    if val:
        split = F.when(val.head(), "val").otherwise(split)
    if train:
        split = F.when(train.head(), "train").otherwise(split)
    return df.withColumn("data_split", split)


def split_report(df: DataFrame) -> DataFrame:
    return df.groupBy("data_split").agg(
        F.count("*").alias("n"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
    )


def head_and_tail(df: DataFrame, head_ratio: float = 0.9, tail_ratio: float = 0.1) -> DataFrame:
    """Keep the oldest and the newest share, marked by ``is_tail``."""
    n = df.count()
    head_end, before_tail = cut_keys(df, [int(n * head_ratio), n - int(n * tail_ratio)])
    in_head = head_end.head() if head_end else F.lit(False)
    in_tail = ~before_tail.head() if before_tail else F.lit(True)
    return df.withColumn("is_tail", in_tail).filter(F.col("is_tail") | in_head)
