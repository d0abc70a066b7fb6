"""Batch jobs that run several operators over stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caselight.operators import bm25, features, fusion, lifecycle, quality, split
from caselight.session import kept_aside
from caselight.sources import tickets as store


def ingest(raw: DataFrame, base: str, on_fail: str = "warn", contract: bool = False) -> DataFrame:
    """Check, split, derive features, store, index and rebuild the edge tables.

    Tickets are written once and every later step reads the written table. Records that could
    not be read, and with ``contract`` rows that break the input contract, go to
    ``quarantine`` with the reason. Returns the summary rows (kind, name, n); what is counted
    as total and as quarantine adds up to the input.
    """
    spark = raw.sparkSession
    given = raw.columns
    raw, unreadable = store.split_readable(raw)
    bad = unreadable.withColumn("reason", F.lit("unreadable"))
    if contract:
        raw, broken = quality.split_valid(raw)
        raw = raw.select([c for c in given if c in raw.columns])
        broken = broken.withColumn("reason", F.array_join("reasons", "; ")).drop("reasons")
        bad = bad.unionByName(broken, allowMissingColumns=True)
    bad.write.mode("overwrite").parquet(f"{base}/quarantine")
    checks = kept_aside(quality.dataset_checks(raw))
    quality.enforce(checks, on_fail)
    store.append_tickets(split.temporal_split(raw), f"{base}/tickets")
    tickets = store.read_tickets(spark, f"{base}/tickets")
    store.append_features(features.ticket_features(tickets), f"{base}/features")
    store.replace_graph_tables(tickets, base)
    index = bm25.build_index(fusion.resolved(tickets), f"{base}/bm25")
    _, vectors = fusion.build_vectors(tickets, f"{base}/vectors")
    tables = dict(zip(("product_issues", "issue_solutions", "error_code_mapping"),
                      store.read_graph_tables(spark, base)))
    tables["features"] = spark.read.parquet(f"{base}/features")
    tables["vectors"] = vectors
    out = quality.ingest_summary(tickets).unionByName(checks.select(
        F.lit("check").alias("kind"), F.col("check").alias("name"), F.col("passed").cast("long").alias("n")))
    quarantined = spark.read.parquet(f"{base}/quarantine").groupBy("reason").agg(F.count("*").alias("n"))
    out = out.unionByName(quarantined.select(F.lit("quarantine").alias("kind"), F.col("reason").alias("name"), "n"))
    for name, table in tables.items():
        out = out.unionByName(table.agg(F.count("*").alias("n")).select(
            F.lit("table").alias("kind"), F.lit(name).alias("name"), "n"))
    return out.unionByName(index.categories(spark).agg(F.sum("n").alias("n")).select(
        F.lit("table").alias("kind"), F.lit("indexed").alias("name"), "n"))


def answer(spark: SparkSession, queries: DataFrame, base: str, top_k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(results, graph context) of a table of tickets, from what ``ingest`` wrote."""
    tickets = store.read_tickets(spark, f"{base}/tickets")
    encoder, vectors = fusion.read_vectors(spark, f"{base}/vectors")
    index = bm25.load_index(spark, f"{base}/bm25")
    results = fusion.hybrid_retrieve(queries, tickets, index, encoder, vectors, top_k)
    return results, fusion.stored_context(queries, *store.read_graph_tables(spark, base), top_k=top_k)


def monitor(signals: DataFrame, predictions: DataFrame, shadow: DataFrame, base: str, as_of: Column,
            last_retrain_at: Column, corrections: Column) -> DataFrame:
    """Store signals, decision and metrics of one monitoring cycle; return the report."""
    spark = signals.sparkSession
    signals.withColumn("detected_at", as_of).write.mode("append").parquet(f"{base}/signals")
    kept = spark.read.parquet(f"{base}/signals").filter(F.col("detected_at") == as_of)
    decision = lifecycle.retrain_decision(kept, as_of, last_retrain_at, corrections)
    decision.withColumn("decided_at", as_of).write.mode("append").parquet(f"{base}/decisions")
    report = lifecycle.monitoring_report(kept, decision, shadow, predictions)
    lifecycle.metric_snapshot(
        report, ["n_signals", "n_severe", "mean_confidence"], as_of
    ).write.mode("append").parquet(f"{base}/metrics")
    return report
