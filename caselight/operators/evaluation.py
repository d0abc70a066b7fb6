"""Class weights, F1 from confusion counts, and ensemble routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    all_rows = counts.agg(F.sum("n")).scalar()
    classes = counts.agg(F.count("*")).scalar()
    return counts.withColumn("weight", all_rows / (classes * F.col("n")))


def per_class_f1(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """(class, support, predicted, hits, f1) from counts per (label, prediction)."""
    pairs = df.groupBy(F.col(label).alias("t"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    both = F.array(
        F.struct(F.col("t").alias("class"), F.col("n").alias("s"), F.lit(0).cast("long").alias("q"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("h")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("s"), F.col("n").alias("q"),
                 F.lit(0).cast("long").alias("h")),
    )
    rows = pairs.select(F.inline(both)).groupBy("class").agg(
        F.sum("s").alias("support"), F.sum("q").alias("predicted"), F.sum("h").alias("hits"))
    return rows.withColumn(
        "f1", F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0)))


def weighted_f1(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """F1 of the classes weighted by their support, one row."""
    f1 = per_class_f1(df, label, prediction)
    return f1.agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def top_class(probabilities: Column) -> Column:
    """Class of the largest probability, ties by name."""
    best = F.array_max(F.map_values(probabilities))
    names = F.transform(
        F.filter(F.map_entries(probabilities), lambda e: e["value"] == best), lambda e: e["key"])
    return F.array_min(names)


def route(primary: DataFrame, second: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Average both models' class probabilities where the primary is unsure.

    Inputs are (ticket_id, probabilities map<string,double>).
    """
    joined = primary.select("ticket_id", F.col("probabilities").alias("a")).join(
        second.select("ticket_id", F.col("probabilities").alias("b")), "ticket_id", "left")
    sure = F.array_max(F.map_values("a")) >= threshold
    mean = F.map_zip_with(
        "a", "b", lambda _, x, y: (F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))) / 2)
    mixed = F.when(sure | F.col("b").isNull(), F.col("a")).otherwise(mean)
    return joined.withColumn("probabilities", mixed).select(
        "ticket_id", top_class(F.col("probabilities")).alias("predicted_category"),
        F.array_max(F.map_values("probabilities")).alias("confidence"),
        (~(sure | F.col("b").isNull())).alias("ensembled"), "probabilities")
