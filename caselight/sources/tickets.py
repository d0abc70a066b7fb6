"""Reading and writing ticket tables, logs and graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from caselight.functions.expr import same
from caselight.operators import graph
from caselight.operators.scale import quantiles, top_n_per_group
from caselight.schemas import PREDICTION_LOG, SYSTEM_EVENT, TICKET, TICKET_TYPES
from caselight.sources import versions

CORRUPT = "_corrupt_record"
#: Rows of a file at most.
MAX_RECORDS = 2_000_000


def read_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Tickets from JSON with the fixed schema.

    One JSON array per file cannot be split between tasks: land it once with
    ``append_tickets`` and run every job on the table. JSON Lines can be split. A record that
    can't be read, as a whole or in a field, has its text in ``_corrupt_record``;
    ``split_readable`` takes such records out.
    """
    schema = T.StructType([*TICKET.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT)
    return reader.option("multiLine", not lines).json(path)


def split_readable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable rows, rows whose record could not be read, with its text)."""
    if CORRUPT not in df.columns:
        return df, df.limit(0).withColumn(CORRUPT, F.lit(None).cast("string"))
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), df.filter(F.col(CORRUPT).isNotNull())


def conform(df: DataFrame) -> DataFrame:
    """Known columns cast to their types, absent ones typed NULL, others dropped."""
    return df.select(*[
        (F.col(n).cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n)
        for n, t in TICKET_TYPES.items()])


def append_tickets(df: DataFrame, path: str) -> None:
    """Append to the Parquet table, partitioned by creation date.

    Rows are rebalanced by date: run-time planning splits a busy date over tasks and lets
    quiet dates share one, so neither a hot date nor many small files arise.
    """
    out = conform(df).withColumn("ingested_at", F.coalesce("ingested_at", F.current_timestamp()))
    (out.withColumn("created_date", F.to_date("created_at"))
     .hint("rebalance", "created_date")
     .write.option("maxRecordsPerFile", MAX_RECORDS).mode("append").partitionBy("created_date").parquet(path))


def read_tickets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def latest_tickets(tickets: DataFrame, n: int = 10_000) -> DataFrame:
    """The newest n tickets; a top-k, not a sort."""
    return tickets.orderBy(F.desc("created_at"), F.desc("ticket_id")).limit(n)


def append_features(features: DataFrame, path: str) -> None:
    features.withColumn("computed_at", F.current_timestamp()).write.mode("append").parquet(path)


_GRAPH = {
    "product_issues": graph.product_issues,
    "issue_solutions": graph.issue_solutions,
    "error_code_mapping": graph.error_code_mapping,
}


def replace_graph_tables(tickets: DataFrame, base: str) -> None:
    """A new version of the three edge tables; their keys are unique by construction. Readers
    see the version before until all three are written."""
    versions.replace_tables(tickets.sparkSession, f"{base}/graph", {name: build(tickets) for name, build in _GRAPH.items()})


def read_graph_tables(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(versions.read_tables(spark, f"{base}/graph", list(_GRAPH)))


def _typed(df: DataFrame, schema) -> DataFrame:
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields])


def append_predictions(df: DataFrame, path: str) -> None:
    _typed(df, PREDICTION_LOG).write.mode("append").parquet(path)


def append_events(df: DataFrame, path: str) -> None:
    _typed(df, SYSTEM_EVENT).withColumn(
        "status", F.coalesce("status", F.lit("success"))).write.mode("append").parquet(path)


def feedback_rows(df: DataFrame) -> DataFrame:
    """Feedback with the echo whether the category was corrected."""
    return df.withColumn("category_corrected", F.col("corrected_category").isNotNull())


def append_feedback(df: DataFrame, path: str) -> None:
    feedback_rows(df).write.mode("append").parquet(path)


def event_rollup(events: DataFrame) -> DataFrame:
    """Count, error rate and latency percentiles per event type and component."""
    keys = ["event_type", "component"]
    facts = events.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg((F.coalesce("status", F.lit("success")) != "success").cast("int")).alias("error_rate"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
    )
    cuts = quantiles(events, keys, F.col("latency_ms"), [0.5, 0.95]).select(
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.get("quantiles", F.lit(0)).alias("p50_latency_ms"),
        F.get("quantiles", F.lit(1)).alias("p95_latency_ms"))
    cond = same([F.col(k) for k in keys], [F.col(f"_{k}") for k in keys])
    return facts.join(cuts, cond, "left").drop(*[f"_{k}" for k in keys])


def active_models(versions: DataFrame) -> DataFrame:
    """The newest version of every model."""
    return top_n_per_group(
        versions, ["model_name"], [F.desc("trained_at"), F.desc("version")], 1).drop("rank")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def feature_snapshot() -> Column:
    """The inputs logged with every prediction."""
    return F.create_map(
        F.lit("product"), F.col("product"), F.lit("customer_tier"), F.col("customer_tier"),
        F.lit("priority"), F.col("priority"),
        F.lit("ticket_text_length"), F.length("description").cast("string"))
