"""Feature rows per ticket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from caselight.functions.text import error_codes, word_count
from caselight.schemas import with_columns

_INPUTS = [
    "subject", "description", "contains_error_code", "contains_stack_trace", "customer_id",
    "product", "satisfaction_score", "escalated", "resolution_time_hours", "created_at",
    "product_version_age_days",
]


def ticket_features(tickets: DataFrame) -> DataFrame:
    """The 18 feature columns.

    Texts become numbers before any shuffle. Customer and product aggregates are
    combined map-side and joined to narrow rows; run-time planning picks the kind of join.
    """
    t = with_columns(tickets, _INPUTS)
    by_customer = (
        t.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
            F.count("ticket_id").alias("c_count"),
            F.avg("satisfaction_score").alias("c_sat"),
            F.avg(F.col("escalated").cast("int")).alias("c_esc"))
    )
    by_product = (
        t.filter(F.col("product").isNotNull()).groupBy("product").agg(
            F.avg("resolution_time_hours").alias("p_hours"),
            F.count("ticket_id").alias("p_count"))
    )
    hour, day = F.hour("created_at"), F.weekday("created_at")
    narrow = t.select(
        "ticket_id", "customer_id", "product",
        F.coalesce(F.length("subject"), F.lit(0)).alias("subject_length"),
        F.coalesce(F.length("description"), F.lit(0)).alias("description_length"),
        word_count("description").alias("word_count"),
        F.coalesce("contains_error_code", F.lit(False)).alias("has_error_code"),
        F.coalesce("contains_stack_trace", F.lit(False)).alias("has_stack_trace"),
        F.size(error_codes("description")).alias("error_code_count"),
        hour.alias("hour_of_day"),
        day.alias("day_of_week"),
        (day >= 5).alias("is_weekend"),
        ((hour < 8) | (hour > 18)).alias("is_after_hours"),
        F.coalesce("product_version_age_days", F.lit(90)).alias("days_since_product_update"),
    )
    joined = narrow.join(by_customer, "customer_id", "left").join(
        by_product, "product", "left")
    return joined.select(
        "ticket_id", "subject_length", "description_length",
        (F.col("subject_length") + F.col("description_length")).alias("combined_text_length"),
        "word_count", "has_error_code", "has_stack_trace", "error_code_count",
        F.coalesce("c_count", F.lit(0)).cast("int").alias("customer_ticket_count_30d"),
        F.coalesce("c_sat", F.lit(3.5)).alias("customer_avg_satisfaction"),
        F.coalesce("c_esc", F.lit(0.0)).alias("customer_escalation_rate"),
        F.coalesce("p_hours", F.lit(24.0)).alias("product_avg_resolution_hrs"),
        F.coalesce("p_count", F.lit(0)).cast("int").alias("product_ticket_volume_7d"),
        "hour_of_day", "day_of_week", "is_weekend", "is_after_hours",
        "days_since_product_update",
    )


TRAILING = {
    "customer_ticket_count_30d": ("customer_id", 30),
    "product_ticket_volume_7d": ("product", 7),
}


def trailing_features(tickets: DataFrame, spec: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """Per ticket: earlier tickets of the same key in the last days, per feature.

    Counts rows with second in [t - days, t - 1]. That is C(t) - C(t - days), with
    C(x) the key's rows before second x, and C(x) is a running total over whole hours
    plus the rows of x's hour. No task holds more than one hour of one key, so a hot
    key needs no window of its own. All features go through the same shuffles.
    """
    spec = spec or TRAILING
    second = F.floor(F.unix_micros("created_at") / 1_000_000).cast("long")

    def cell(name: str, key: str, at: Column, row: int, sign: int) -> Column:
        return F.struct(
            F.lit(name).alias("_f"), F.col(key).alias("_k"), at.alias("_x"),
            F.lit(row).alias("_row"), F.lit(sign).alias("_sign"))

    cells = [
        c for name, (key, days) in spec.items()
        for c in (cell(name, key, second, 1, 1), cell(name, key, second - days * 86400, 0, -1))]
    probes = tickets.select("ticket_id", F.inline(F.array(*cells))).filter(
        F.col("_k").isNotNull()).withColumn("_h", F.floor(F.col("_x") / 3600).cast("long"))

    within = Window.partitionBy("_f", "_k", "_h").orderBy("_x").rangeBetween(
        Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("_f", "_k").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    hours = (
        probes.groupBy("_f", "_k", "_h").agg(F.sum("_row").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    share = F.col("_sign") * (F.col("_before") + F.col("_in_hour"))
    counts = (
        probes.withColumn("_in_hour", F.coalesce(F.sum("_row").over(within), F.lit(0)))
        .join(hours, ["_f", "_k", "_h"])
        .groupBy("ticket_id")
        .agg(*[F.sum(F.when(F.col("_f") == name, share)).alias(name) for name in spec])
    )
    return tickets.select("ticket_id").join(counts, "ticket_id", "left").na.fill(0, list(spec))
