"""Mergeable sketches per day: quantiles and distinct counts of any window without its rows.

A day's sketches are small columns of a table; windows, and a frozen reference, are merges of
days. Quantiles come from KLL sketches, distinct counts from HyperLogLog sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caselight.functions.expr import number

#: Sizes of the sketches. A quantile's rank is off by about 0.55 % at this size, a distinct
#: count by 1.6 % (one standard deviation); the bounds hold with room for merges.
KLL_SIZE, HLL_BITS = 800, 12
RANK_ERROR, DISTINCT_ERROR = 0.01, 0.06


def daily_sketches(tickets: DataFrame, features: list[str], time: str = "created_at") -> DataFrame:
    """(day, feature, n, kll, hll) of the numeric features: one scan, combined before the shuffle.

    Rows without a time are sketched under a NULL day; null values and values that are no
    numbers don't count.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), number(f).alias("value")) for f in features])
    rows = tickets.select(F.to_date(time).alias("day"), F.inline(cells)).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.groupBy("day", "feature").agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double("value", F.lit(KLL_SIZE)).alias("kll"),
        F.hll_sketch_agg(F.col("value").cast("string"), F.lit(HLL_BITS)).alias("hll"))


def merged(sketches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The sketches of several days as one per feature (or per ``keys``)."""
    return sketches.groupBy(*(keys or ["feature"])).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("kll").alias("kll"), F.hll_union_agg("hll").alias("hll"))


def sketched_quantiles(sketches: DataFrame, probs: list[float], name: str = "edges") -> DataFrame:
    """The merged sketches with their quantiles at ``probs`` as an array."""
    at = F.array(*[F.lit(float(p)) for p in probs])
    return sketches.withColumn(name, F.kll_sketch_get_quantile_double("kll", at))


def sketched_edges(sketches: DataFrame, n_bins: int = 10) -> DataFrame:
    """(feature, edges): reference edges for ``drift.psi_bins`` from merged sketches."""
    out = sketched_quantiles(sketches, [i / n_bins for i in range(n_bins + 1)])
    return out.select("feature", F.array_distinct("edges").alias("edges"))


def sketched_distinct(sketches: DataFrame) -> DataFrame:
    """(feature, n, distinct) from merged sketches."""
    return sketches.select("feature", "n", F.hll_sketch_estimate("hll").alias("distinct"))


def sketch_errors(tickets: DataFrame, sketches: DataFrame, features: list[str], probs: list[float]) -> DataFrame:
    """(feature, rank_error, distinct_error): merged sketches beside the exact figures.

    The rank of a quantile is off by what its probability lies outside the shares of values
    below it and up to it; the largest of all ``probs`` is reported.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), number(f).alias("value")) for f in features])
    cuts = F.broadcast(sketched_quantiles(sketches, probs, "cuts").select("feature", "cuts"))  # a row per listed feature
    rows = tickets.select(F.inline(cells)).filter(F.col("value").isNotNull() & ~F.isnan("value")).join(cuts, "feature")
    share = lambda below: F.avg(below.cast("int"))
    facts = rows.groupBy("feature").agg(
        F.countDistinct("value").alias("exact"),
        *[share(F.col("value") < F.get("cuts", F.lit(i))).alias(f"low{i}") for i in range(len(probs))],
        *[share(F.col("value") <= F.get("cuts", F.lit(i))).alias(f"high{i}") for i in range(len(probs))])
    off: list[Column] = [F.greatest(F.lit(0.0), F.col(f"low{i}") - p, p - F.col(f"high{i}")) for i, p in enumerate(probs)]
    return facts.join(sketched_distinct(sketches), "feature").select(
        "feature", F.greatest(F.lit(0.0), *off).alias("rank_error"),
        (F.abs(F.col("distinct") - F.col("exact")) / F.col("exact")).alias("distinct_error"))
