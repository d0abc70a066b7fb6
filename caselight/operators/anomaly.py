"""Volume spikes, sentiment drift and new issue types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from caselight.functions.expr import whole_days
from caselight.operators.split import head_and_tail
from caselight.schemas import (
    SENTIMENT_SCORE, SENTIMENT_SCORE_OTHER, lookup, severity_rank,
)

Z_THRESHOLD = 2.0
EWMA_SPAN = 30
ANOMALY_COLUMNS = [
    "anomaly_type", "severity", "description", "dimensions", "metric_value", "threshold",
]


def volume_statistics(tickets: DataFrame, group_cols: list[str], recent_days: int = 7) -> DataFrame:
    """Daily rate of the last days against the daily baseline, per group.

    Tickets are counted once per group and day; everything else runs on that small
    table, the newest time being a scalar subquery.
    """
    cutoff = tickets.agg(F.max("created_at")).scalar() - F.make_dt_interval(days=F.lit(recent_days))
    known = tickets
    for c in group_cols:
        known = known.filter(F.col(c).isNotNull())
    recent = F.col("is_recent")
    days = known.groupBy(
        *group_cols, F.to_date("created_at").alias("day"),
        (F.col("created_at") >= cutoff).alias("is_recent"),
    ).agg(F.count("*").alias("n"))
    newest = tickets.filter(F.col("created_at") >= cutoff)
    span = newest.agg(whole_days(F.max("created_at"), F.min("created_at"))).scalar()
    out = days.groupBy(*group_cols).agg(
        F.sum(F.when(recent, F.col("n"))).alias("recent_count"),
        F.avg(F.when(~recent, F.col("n"))).alias("mean_daily"),
        F.stddev_samp(F.when(~recent, F.col("n"))).alias("std"),
    ).withColumn("std_daily", F.coalesce("std", F.lit(1.0)))
    out = out.withColumn(
        "recent_daily", F.col("recent_count") / F.greatest(F.lit(1), span))
    gap = F.col("recent_daily") - F.col("mean_daily")
    z = (
        F.when(F.col("std_daily") > 0, F.try_divide(gap, F.col("std_daily")))
        .when(gap > 0, F.lit(float("inf"))).when(gap < 0, F.lit(float("-inf")))
    )
    return out.filter(F.col("recent_count").isNotNull() & F.col("mean_daily").isNotNull()).withColumn(
        "z", z).drop("std")


def volume_anomalies(
    tickets: DataFrame, group_cols: list[str] | None = None, z: float = Z_THRESHOLD
) -> DataFrame:
    cols = group_cols or ["product", "category"]
    hits = volume_statistics(tickets, cols).filter(F.col("z") > z)
    return hits.select(
        *cols, "recent_daily", "mean_daily", "std_daily", "z",
        F.when(F.col("z") > 3, "critical").otherwise("warning").alias("severity"),
        (F.col("mean_daily") + z * F.col("std_daily")).alias("threshold"))


def ewma_last(df: DataFrame, key: str, value: str, span: int = EWMA_SPAN) -> DataFrame:
    """Last value of the adjusted exponentially weighted mean, per key, in time order.

    With decay d the weighted sum of a run of rows is S = sum(x * d ** newer rows in the run),
    and runs combine as S_new + d ** n_new * S_old. All rows take part: by second, then by
    hour, then by key, so no window holds more than one second's rows, one hour's seconds or
    one key's hours. Rows without a time count as the newest ones, ties go by ticket_id.
    """
    decay = 1 - 2 / (span + 1)
    power = lambda n: F.pow(F.lit(decay), n)

    def combined(runs: DataFrame, keys: list[str], step: str) -> DataFrame:
        newer = Window.partitionBy(*keys).orderBy(F.col(step).desc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        shifted = runs.withColumn("s", F.col("s") * power(F.coalesce(F.sum("n").over(newer), F.lit(0))))
        return shifted.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))

    second = F.floor(F.unix_micros("created_at") / 1_000_000)
    rows = df.select(key, "created_at", "ticket_id", F.col(value).alias("x"), second.alias("second"))
    order = Window.partitionBy(key, "second").orderBy(F.col("created_at").desc_nulls_first(), F.desc("ticket_id"))
    rows = rows.withColumn("s", F.col("x") * power(F.row_number().over(order) - 1))
    seconds = rows.groupBy(key, "second").agg(F.count("*").alias("n"), F.sum("s").alias("s"))
    hours = combined(seconds.withColumn("hour", F.floor(F.col("second") / 3600)), [key, "hour"], "second")
    total = combined(hours, [key], "hour")
    weights = (1 - power(F.col("n"))) / (1 - decay)
    return total.select(key, (F.col("s") / weights).alias("ewma"))


def sentiment_statistics(tickets: DataFrame, key: str = "product", min_rows: int = 50) -> DataFrame:
    scored = tickets.filter(F.col(key).isNotNull()).withColumn(
        "score",
        F.coalesce(lookup(SENTIMENT_SCORE, F.col("customer_sentiment")), F.lit(SENTIMENT_SCORE_OTHER)))
    stats = scored.groupBy(key).agg(
        F.count("*").alias("n"), F.avg("score").alias("mean"),
        F.stddev_samp("score").alias("std")).filter(F.col("n") >= min_rows)
    out = stats.join(ewma_last(scored, key, "score"), key).withColumn(
        "std", F.greatest(F.col("std"), F.lit(0.1)))
    return out.withColumn("z", (F.col("ewma") - F.col("mean")) / F.col("std"))


def sentiment_drift(tickets: DataFrame, key: str = "product", z: float = Z_THRESHOLD,
                    min_rows: int = 50) -> DataFrame:
    hits = sentiment_statistics(tickets, key, min_rows).filter(F.col("z") < -z)
    return hits.select(
        key, "ewma", "mean", "std", "z",
        F.when(F.col("z") > -3, "warning").otherwise("critical").alias("severity"),
        (F.col("mean") - z * F.col("std")).alias("threshold"))


def issue_shares(tickets: DataFrame) -> DataFrame:
    """Share of each category per product in the newest 10 % and the oldest 90 %."""
    marked = head_and_tail(tickets).filter(F.col("product").isNotNull() & F.col("category").isNotNull())
    tail = F.col("is_tail")
    counts = marked.groupBy("product", "category").agg(
        F.count_if(tail).alias("recent"), F.count_if(~tail).alias("hist"))
    totals = counts.groupBy("product").agg(
        F.sum("recent").alias("recent_all"), F.sum("hist").alias("hist_all"))
    return counts.join(totals, "product").select(
        "product", "category",
        F.try_divide(F.col("recent"), F.col("recent_all")).alias("recent_share"),
        F.coalesce(F.try_divide(F.col("hist"), F.col("hist_all")), F.lit(0.0)).alias("hist_share"))


def new_issue_types(
    tickets: DataFrame, min_recent: float = 0.05, max_hist: float = 0.01
) -> DataFrame:
    """Categories rare or absent before and frequent now, per product."""
    return issue_shares(tickets).filter(
        (F.col("recent_share") > min_recent) & (F.col("hist_share") < max_hist))


def all_anomalies(tickets: DataFrame, group_cols: list[str] | None = None, z: float = Z_THRESHOLD,
                  mood_z: float = Z_THRESHOLD, min_rows: int = 50, min_recent: float = 0.05,
                  max_hist: float = 0.01) -> DataFrame:
    """Findings of the three detectors in one table, most severe first.

    The defaults are the specification's rules: groups (product, category), z above 2, moods of
    at least 50 tickets, shares of 5 % recently and 1 % before.
    """
    group_cols = group_cols or ["product", "category"]
    volume = volume_anomalies(tickets, group_cols, z).select(
        F.lit("volume_spike").alias("anomaly_type"), "severity",
        F.format_string("Volume: %.1f/day vs baseline %.1f/day (z=%.2f)",
                        "recent_daily", "mean_daily", "z").alias("description"),
        F.create_map(*[x for c in group_cols for x in (F.lit(c), F.col(c))]).alias("dimensions"),
        F.col("recent_daily").alias("metric_value"), "threshold")
    new = new_issue_types(tickets, min_recent, max_hist).select(
        F.lit("new_issue_type").alias("anomaly_type"), F.lit("info").alias("severity"),
        F.format_string("'%s' emerging for %s: %.1f%%", "category", "product",
                        F.col("recent_share") * 100).alias("description"),
        F.create_map(F.lit("product"), "product", F.lit("category"), "category").alias("dimensions"),
        F.col("recent_share").alias("metric_value"), F.lit(min_recent).alias("threshold"))
    mood = sentiment_drift(tickets, "product", mood_z, min_rows).select(
        F.lit("sentiment_drift").alias("anomaly_type"), "severity",
        F.format_string("Sentiment drift %s: EWMA=%.2f vs mean=%.2f (z=%.2f)",
                        "product", "ewma", "mean", "z").alias("description"),
        F.create_map(F.lit("product"), "product").alias("dimensions"),
        F.col("ewma").alias("metric_value"), "threshold")
    found = volume.unionByName(new).unionByName(mood)
    return found.select(*ANOMALY_COLUMNS).orderBy(
        severity_rank(F.col("severity")), "anomaly_type", "description")
