"""Quality of retrieval results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caselight.functions.text import ERROR_CODE
from caselight.operators.scale import quantiles, top_n_per_group
from caselight.session import kept_aside

# ---- fixed values: weights and patterns -----------------------------------------
# alternatives of plain words stand as lists, in their order: they are looked up, not matched
WEIGHTS = {
    "relevance": 0.30, "success": 0.25, "satisfaction": 0.10,
    "completeness": 0.20, "specificity": 0.15,
}
ACTION_WORDS = [
    "config", "setting", "parameter", "update", "change", "set", "increase", "decrease"]
OUTCOME_WORDS = ["resolved", "fixed", "working", "confirmed"]
FILE_SUFFIX = r"\.(yaml|json|conf|py|js|xml|ini)"
VERSION_WORDS = ["version", "upgrade", "patch"]
VERSION_NUMBER = r"v\p{Nd}"
TOOL_WORDS = ["command", "script", "query", "api", "endpoint"]
# ---------------------------------------------------------------------------------


def _any_of(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def _share(step: float, conditions: list[Column]) -> Column:
    total = sum((F.when(c, F.lit(step)).otherwise(0.0) for c in conditions), F.lit(0.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), total))


def with_quality(pairs: DataFrame) -> DataFrame:
    """Add five dimensions and their weighted sum to (ticket, result) rows.

    The ticket's columns are ``query_category`` and ``query_product``; the result has
    the payload columns. Two missing values count as a match.
    """
    category = F.col("query_category").eqNullSafe(F.col("category"))
    product = F.col("query_product").eqNullSafe(F.col("product"))
    pairs = pairs.withColumn("_text", F.coalesce("resolution", F.lit("")))
    pairs = pairs.withColumn("_low", F.lower("_text"))
    text, low = F.col("_text"), F.col("_low")
    complete = [F.length(text) > 50, F.length(text) > 150, text.rlike(r"\p{Nd}"),
                _any_of(low, ACTION_WORDS), _any_of(low, OUTCOME_WORDS)]
    specific = [text.rlike(ERROR_CODE), low.rlike(FILE_SUFFIX),
                _any_of(low, VERSION_WORDS) | low.rlike(VERSION_NUMBER), _any_of(low, TOOL_WORDS)]
    dims = {
        "relevance": F.when(category & product, 1.0).when(category, 0.7)
        .when(product, 0.3).otherwise(0.1),
        "success": F.when(F.col("resolution_helpful"), 1.0)
        .when(~F.col("resolution_helpful"), 0.2).otherwise(0.5),
        "satisfaction": F.coalesce(
            F.least(F.lit(1.0), F.col("satisfaction_score") / 5.0), F.lit(0.5)),
        "completeness": _share(0.2, complete),
        "specificity": _share(0.25, specific),
    }
    pairs = pairs.withColumns(dims).drop("_text", "_low")
    total = sum((F.col(d) * w for d, w in WEIGHTS.items()), F.lit(0.0))
    return pairs.withColumn("quality_score", total)


def rank_by_quality(pairs: DataFrame, top_k: int) -> DataFrame:
    """Results of every query, best quality first."""
    return top_n_per_group(
        with_quality(pairs), ["query_id"], [F.desc("quality_score"), F.asc("ticket_id")], top_k)


def quality_metrics(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Count, mean, median, lower quartile and low / high shares, overall or per key."""
    keys = keys or []
    q = F.col("quality_score")
    scored = kept_aside(scored.select(*keys, "quality_score"))  # texts are scored once
    facts = scored.filter(q.isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n_results_scored"),
        F.avg(q).alias("mean_quality"),
        F.avg((q < 0.3).cast("int")).alias("low_quality_rate"),
        F.avg((q >= 0.7).cast("int")).alias("high_quality_rate"),
    )
    cuts = quantiles(scored, keys, q, [0.5, 0.25])
    if keys:
        cuts = cuts.select(*[F.col(k).alias(f"_{k}") for k in keys], "quantiles")
        cond = F.lit(True)
        for k in keys:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = facts.join(cuts, cond)
    else:
        out = facts.withColumn("quantiles", cuts.scalar())
    return out.select(
        *keys, "n_results_scored", "mean_quality",
        F.get("quantiles", F.lit(0)).alias("median_quality"),
        F.get("quantiles", F.lit(1)).alias("p25_quality"),
        "low_quality_rate", "high_quality_rate")
