"""Streaming jobs: scoring, rolling windows, deduplication, last-n state.

Every job takes a streaming DataFrame and writes Parquet below the shared folder,
with its checkpoint beside it. What a job adds up is written as sums per micro-batch under
the batch number, so a replayed batch replaces its own output; readers add the batches up, and
a row counts however late it arrives. Deduplication and last-n keep keyed state in RocksDB, so
a batch costs what it holds, not what came before. Hours can also be closed by a watermark:
late rows, which Spark then leaves out, are found and recounted from the log.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from caselight.operators.scale import top_n_per_group
from caselight.session import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROCKSDB_CONF = "spark.sql.streaming.stateStore.rocksdb"
WINDOWS = {
    "1h": ("1 hour", "1 hour"),
    "24h": ("24 hours", "1 hour"),
    "7d": ("7 days", "1 day"),
}


def open_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder or single file as a stream, with the schema of its files.

    The path is given as a pattern that matches only itself, because a stream takes a
    plain path for a folder.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    path = path.rstrip("/")
    path = f"{path[:-1]}[{path[-1]}]"
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def append_to(stream: DataFrame, base: str, available_now: bool = True):
    """Start an append query into ``base``/out."""
    writer = stream.writeStream.outputMode("append").format("parquet").option(
        "checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def run_append(stream: DataFrame, name: str) -> DataFrame:
    """Process what is available and return the appended table."""
    spark = stream.sparkSession
    base = shared_dir(spark, name)
    append_to(stream, base).awaitTermination()
    return read_out(spark, base, stream.schema)


def read_out(spark: SparkSession, base: str, schema) -> DataFrame:
    """What an append query has written; no rows if nothing has arrived yet."""
    try:
        return spark.read.schema(schema).parquet(f"{base}/out")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def batches_to(stream: DataFrame, base: str, rows: Callable[[DataFrame], DataFrame], available_now: bool = True):
    """Start a query that writes ``rows(batch)`` per micro-batch into a folder of its own."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows(batch).write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_batches(spark: SparkSession, base: str) -> DataFrame:
    """What all micro-batches wrote, with their number as ``batch``."""
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out/batch=*")


def summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The batches added up: every other column is a sum."""
    sums = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def run_sums(stream: DataFrame, name: str, keys: list[str], rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Process what is available; the sums of all batches."""
    spark = stream.sparkSession
    base = shared_dir(spark, name)
    batches_to(stream, base, rows).awaitTermination()
    return summed(read_batches(spark, base), keys)


def _hour_sums() -> list[Column]:
    return [F.count("*").alias("n"), F.sum("confidence").alias("confidence_sum"), F.count_if("was_corrected").alias("corrected")]


def hourly(rows: DataFrame, keys: list[str], time: str = "timestamp") -> DataFrame:
    """Count, confidence sums and corrected rows per hour and key; all additive.

    Rows without a time are summed under a NULL hour.
    """
    return rows.groupBy(F.date_trunc("hour", time).alias("hour"), *keys).agg(*_hour_sums())


def windowed(hours: DataFrame, window: str, keys: list[str]) -> DataFrame:
    """Rolling windows from hourly sums; only the small table is multiplied."""
    length, slide = WINDOWS[window]
    return (
        hours.groupBy(F.window("hour", length, slide).alias("w"), *keys)
        .agg(*[F.sum(c).alias(c) for c in ("n", "confidence_sum", "corrected")])
        .select(F.lit(window).alias("window"), F.col("w.start").alias("window_start"),
                *keys, "n", "confidence_sum", "corrected")
    )


def bin_counts(rows: DataFrame, edges: DataFrame, features: list[str], slide: str = "1 day",
               time: str = "created_at") -> DataFrame:
    """Counts per window, feature and bin against frozen reference edges.

    ``edges`` has one row (feature, edges) per listed feature. Bins are numbered from 1; bin 0
    holds what lies below the reference range and the bin behind the last what lies above, so
    no value is lost. A stability index is not additive but bin counts are; it is computed from
    them when read.
    """
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).try_cast("double").alias("value")) for f in features])
    values = rows.select(time, F.inline(cells)).filter(F.col("value").isNotNull())
    last = F.size("edges") - 1
    position = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    above = F.col("value") > F.get("edges", last)
    return (
        values.join(F.broadcast(edges), "feature")  # a row per listed feature
        .withColumn("bin", F.when(above, last + 1).otherwise(F.least(position, last)))
        .groupBy(F.window(time, slide).alias("w"), "feature", "bin").agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "feature", "bin", "n")
    )


def keep_state_on_disk(spark: SparkSession) -> None:
    """Keyed state of streams started from now on lies in RocksDB, beside the checkpoint. A batch
    writes its changes, not whole files of the state, and doesn't look up a key to count keys."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set(f"{ROCKSDB_CONF}.changelogCheckpointing.enabled", "true")
    spark.conf.set(f"{ROCKSDB_CONF}.trackTotalNumberOfRows", "false")


def deduplicated(stream: DataFrame, ident: str = "ticket_id", time: str = "created_at", delay: str | None = None) -> DataFrame:
    """Each identifier once, whatever its other columns say; of copies in a batch any one.

    Rows without an identifier are tickets of their own and all pass. Without ``delay`` an
    identifier is remembered for good. With it, it is remembered at least until the event time of
    the stream is so much later, and rows that arrive later than that are left out.
    """
    known = stream.filter(F.col(ident).isNotNull())
    if delay is None:
        once = known.dropDuplicates([ident])
    else:
        once = known.withWatermark(time, delay).dropDuplicatesWithinWatermark([ident])
    return once.union(stream.filter(F.col(ident).isNull()))


def run_dedup(stream: DataFrame, name: str, ident: str = "ticket_id", time: str = "created_at", delay: str | None = None) -> DataFrame:
    keep_state_on_disk(stream.sparkSession)
    return run_append(deduplicated(stream, ident, time, delay), name)


def closed_hours(log: DataFrame, keys: list[str], delay: str, time: str = "timestamp") -> DataFrame:
    """The sums of ``hourly`` per hour and key, once each, when the stream's event time is
    ``delay`` past the hour. Rows that come later are left out; ``recounted`` adds them."""
    rows = log.filter(F.col(time).isNotNull()).withWatermark(time, delay)
    sums = rows.groupBy(F.window(time, "1 hour").alias("w"), *keys).agg(*_hour_sums())
    return sums.select(F.col("w.start").alias("hour"), *keys, "n", "confidence_sum", "corrected")


def recounted(closed: DataFrame, log: DataFrame, keys: list[str], time: str = "timestamp") -> DataFrame:
    """Closed hours with what came late: the sums of the whole log for every hour and key up to
    the last closed hour whose count differs, and ``late``, the rows that were missing."""
    last = closed.agg(F.max("hour")).scalar()
    whole = hourly(log.filter(F.col(time).isNotNull()), keys, time).filter(F.col("hour") <= last)
    names = {c: f"_{c}" for c in ("hour", *keys)}
    had = closed.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("n").alias("_n"))
    same_cell = F.lit(True)
    for c, n in names.items():
        same_cell = same_cell & F.col(c).eqNullSafe(F.col(n))
    return whole.join(had, same_cell, "left").select(*whole.columns, (F.col("n") - F.coalesce("_n", F.lit(0))).alias("late"))


def scored(stream: DataFrame, score: Callable[[DataFrame], DataFrame], model_name: str,
           model_version: str, snapshot: Column,
           shadow: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Prediction-log rows of a ticket stream; a shadow model scores the same rows.

    ``score`` and ``shadow`` map tickets to the same rows plus predicted_category and
    confidence. Both run in one pass, so comparing them needs no stream join.
    """
    rows = score(stream)
    if shadow is not None:
        rows = shadow(rows.withColumnsRenamed({
            "predicted_category": "primary_category", "confidence": "primary_confidence"}))
        rows = rows.withColumnsRenamed({
            "predicted_category": "shadow_category", "confidence": "shadow_confidence"})
        rows = rows.withColumnsRenamed({
            "primary_category": "predicted_category", "primary_confidence": "confidence"})
        rows = rows.withColumn("agree", F.col("predicted_category").eqNullSafe(F.col("shadow_category")))
    extra = ["shadow_category", "shadow_confidence", "agree"] if shadow is not None else []
    return rows.select(
        "ticket_id", F.col("created_at").alias("timestamp"), "predicted_category", "confidence",
        F.lit(model_name).alias("model_name"), F.lit(model_version).alias("model_version"),
        snapshot.alias("feature_values"), *extra)


def model_score(prepare: Callable[[DataFrame], DataFrame], models: list[PipelineModel],
                label_col: str, confidence: Column) -> Callable[[DataFrame], DataFrame]:
    """A ``score`` function from fitted pipelines."""
    def score(df: DataFrame) -> DataFrame:
        cols = df.columns
        out = prepare(df)
        for m in models:
            out = m.transform(out)
        return out.select(*cols, F.col(label_col).alias("predicted_category"),
                          confidence.alias("confidence"))
    return score


class _Newest(StatefulProcessor):
    """The greatest n sort keys of a group as list state; passes on rows that are among them.

    No timer forgets them: with one, a stream over what is available would never end.
    """

    def __init__(self, n: int, by: list[str], kinds: str):
        self.n, self.by, self.kinds = n, by, kinds

    def init(self, handle) -> None:
        self.greatest = handle.getListState("greatest", self.kinds)

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows), ignore_index=True)
        order = lambda t: tuple((x is not None and x == x, x if x is not None and x == x else 0) for x in t)
        own = [tuple(r) for r in new[self.by].astype(object).itertuples(index=False)]
        both = [(tuple(t), -1) for t in self.greatest.get()] + [(t, i) for i, t in enumerate(own)]
        both = sorted(both, key=lambda x: order(x[0]), reverse=True)[: self.n]
        self.greatest.put([t for t, _ in both])
        yield new.iloc[sorted(i for _, i in both if i >= 0)].drop(columns=self.by + ["newest_salt"])

    def close(self) -> None:
        pass


def newest_candidates(
    stream: DataFrame, keys: list[str], newest: list[Column], n: int, ident: str = "ticket_id", salts: int = 8,
) -> DataFrame:
    """Rows of a stream that were among the newest ``n`` of their key when they arrived.

    ``newest`` are long or text columns, greatest first, nulls last, which order rows wholly. A
    key is dealt to ``salts`` groups, so a hot one isn't held by one task; the newest n of a
    key are among those of its groups.
    """
    names = [f"newest_by_{i}" for i in range(len(newest))]
    rows = stream.withColumns({a: c for a, c in zip(names, newest)}).withColumn("newest_salt", F.pmod(F.xxhash64(ident), F.lit(salts)).cast("int"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)
    return rows.groupBy(*keys, "newest_salt").transformWithStateInPandas(
        _Newest(n, names, kinds), stream.schema, outputMode="Append", timeMode="None")


def last_n_to(stream: DataFrame, base: str, keys: list[str], newest: list[Column], n: int, ident: str = "ticket_id") -> None:
    """Process what is available of a stream; continues behind the checkpoint below ``base``."""
    keep_state_on_disk(stream.sparkSession)
    append_to(newest_candidates(stream, keys, newest, n, ident), base).awaitTermination()


def read_last_n(spark: SparkSession, base: str, schema, keys: list[str], newest: list[Column], n: int) -> DataFrame:
    """The newest ``n`` rows per key of all that was passed on."""
    rows = read_out(spark, base, schema)
    return top_n_per_group(rows, keys, [F.desc(c) for c in newest], n).drop("rank")


def run_last_n(stream: DataFrame, name: str, keys: list[str], newest: list[Column], n: int = 1000) -> DataFrame:
    base = shared_dir(stream.sparkSession, name)
    last_n_to(stream, base, keys, newest, n)
    return read_last_n(stream.sparkSession, base, stream.schema, keys, newest, n)


def run_cycles(stream: DataFrame, name: str, cycle: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a monitoring job on every micro-batch and collect its rows in one table."""
    spark = stream.sparkSession
    base = shared_dir(spark, name)
    batches_to(stream, base, cycle).awaitTermination()
    return read_batches(spark, base)
