"""Agent, resolution-time and satisfaction reports."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from caselight.functions.expr import flag, number, same
from caselight.operators.scale import first_by_time, quantiles
from caselight.schemas import with_columns

_AGENT_INPUTS = [
    "agent_id", "category", "resolution_time_hours", "satisfaction_score", "escalated",
    "resolution_helpful", "response_count", "agent_experience_months", "agent_specialization",
    "created_at",
]

DRIVER_FEATURES = [
    "resolution_time_hours", "resolution_attempts", "transferred_count", "response_count",
    "escalated", "resolution_helpful", "agent_experience_months", "is_enterprise",
    "is_critical", "first_contact_resolution",
]

# ---- fixed values: texts of the driver report -----------------------------------
DRIVER_TEXT = {
    "resolution_helpful": "Helpful resolutions strongly drive satisfaction",
    "first_contact_resolution": "Resolving in ≤2 interactions increases satisfaction",
    "escalated": "Escalation reduces satisfaction (perceived severity/frustration)",
    "transferred_count": "Each transfer reduces satisfaction",
    "agent_experience_months": "More experienced agents achieve higher satisfaction",
    "resolution_attempts": "Multiple attempts reduce satisfaction",
    "response_count": "More back-and-forth reduces satisfaction",
    "is_enterprise": "Enterprise customers may have higher/lower expectations",
    "is_critical": "Critical issues have lower baseline satisfaction",
}
HOURS_TEXT = {
    True: "Faster resolutions increase satisfaction",
    False: "Unexpected: longer resolutions correlate with higher satisfaction",
}
# ---------------------------------------------------------------------------------


def agent_performance(tickets: DataFrame) -> DataFrame:
    """Measures, score and primary category per agent.

    Plain measures and the earliest values come from one hash aggregate, the median
    from the distributed quantile, the mode from counts.
    """
    t = with_columns(tickets, _AGENT_INPUTS).filter(F.col("agent_id").isNotNull())
    base = first_by_time(t, ["agent_id"], {
        "experience_months": F.col("agent_experience_months"),
        "specialization": F.col("agent_specialization"),
    }, [
        F.count("ticket_id").alias("ticket_count"),
        F.avg("resolution_time_hours").alias("avg_resolution_hours"),
        F.avg("satisfaction_score").alias("avg_satisfaction"),
        F.count("satisfaction_score").alias("satisfaction_count"),
        F.avg(F.col("escalated").cast("int")).alias("escalation_rate"),
        F.avg(F.col("resolution_helpful").cast("int")).alias("resolution_helpful_rate"),
        F.avg("response_count").alias("avg_response_count"),
        F.avg((number("response_count", 3) <= 2).cast("int")).alias("fcr_rate"),
    ])
    median = quantiles(t, ["agent_id"], F.col("resolution_time_hours"), [0.5]).select(
        "agent_id", F.get("quantiles", F.lit(0)).alias("median_resolution_hours"))
    counts = t.filter(F.col("category").isNotNull()).groupBy("agent_id", "category").agg(
        F.count("*").alias("n"))
    top = counts.groupBy("agent_id").agg(F.max("n").alias("top"))
    mode = counts.join(top, "agent_id").filter(F.col("n") == F.col("top")).groupBy("agent_id").agg(
        F.min("category").alias("primary_category"))
    score = (
        F.coalesce("avg_satisfaction", F.lit(3.0)) / 5.0 * 0.3
        + F.coalesce("resolution_helpful_rate", F.lit(0.5)) * 0.25
        + F.coalesce("fcr_rate", F.lit(0.5)) * 0.2
        + (1 - F.coalesce("escalation_rate", F.lit(0.1))) * 0.15
        + (1 - F.greatest(F.lit(0.0), F.least(
            F.lit(1.0), F.coalesce("avg_resolution_hours", F.lit(24.0)) / 48))) * 0.1
    )
    out = base.withColumn("perf_score", score)
    for extra in (median, mode):
        out = out.join(extra, "agent_id", "left")
    return out


def agent_report(agents: DataFrame, head: int = 50, edge: int = 5) -> DataFrame:
    """Rows (section, position, agent_id, value): means, leading, top and bottom agents."""
    best = [F.desc("perf_score"), F.asc("agent_id")]
    worst = [F.asc("perf_score"), F.desc("agent_id")]

    def ranked(order, n: int, section: str) -> DataFrame:
        # the window sees the n rows the limit leaves
        rows = agents.orderBy(*order).limit(n)
        return rows.select(
            F.lit(section).alias("section"),
            F.row_number().over(Window.orderBy(*best)).alias("position"),
            "agent_id", F.col("perf_score").alias("value"))

    means = agents.agg(
        F.avg("avg_resolution_hours").alias("avg_resolution_hours"),
        F.avg("avg_satisfaction").alias("avg_satisfaction"),
        F.avg("fcr_rate").alias("avg_fcr_rate"), F.count("*").cast("double").alias("n_agents"))
    cells = F.array(*[
        F.struct(F.lit("summary").alias("section"), F.lit(i + 1).alias("position"),
                 F.lit(m).alias("agent_id"), F.col(m).alias("value"))
        for i, m in enumerate(["avg_resolution_hours", "avg_satisfaction", "avg_fcr_rate", "n_agents"])])
    return (
        means.select(F.inline(cells))
        .unionByName(ranked(best, head, "agents"))
        .unionByName(ranked(best, edge, "top_performers"))
        .unionByName(ranked(worst, edge, "needs_coaching"))
    )


def resolution_time_stats(tickets: DataFrame) -> DataFrame:
    """Count, mean, median and 95th percentile of hours per product and category."""
    keys = ["product", "category"]
    t = tickets.filter(F.col("resolution_time_hours").isNotNull())
    facts = t.groupBy(*keys).agg(
        F.count("*").alias("ticket_count"), F.avg("resolution_time_hours").alias("avg_hours"))
    cuts = quantiles(t, keys, F.col("resolution_time_hours"), [0.5, 0.95]).select(
        F.col("product").alias("_p"), F.col("category").alias("_c"),
        F.get("quantiles", F.lit(0)).alias("median_hours"),
        F.get("quantiles", F.lit(1)).alias("p95_hours"))
    joined = facts.join(
        cuts, same([F.col(k) for k in keys], [F.col("_p"), F.col("_c")]))
    return joined.drop("_p", "_c").orderBy(F.desc("avg_hours"), *keys)


def satisfaction_summary(tickets: DataFrame) -> DataFrame:
    s = F.col("satisfaction_score")
    return tickets.agg(
        F.count(s).alias("n_tickets"),
        F.count_if(s >= 4).alias("n_satisfied"),
        F.avg((s >= 4).cast("int")).alias("satisfaction_rate"))


def driver_matrix(tickets: DataFrame) -> DataFrame:
    """The ten driver features and the 0/1 target of scored tickets."""
    t = with_columns(tickets, [
        "resolution_time_hours", "resolution_attempts", "transferred_count", "response_count",
        "escalated", "resolution_helpful", "agent_experience_months", "customer_tier", "priority",
    ]).filter(F.col("satisfaction_score").isNotNull())
    responses = number("response_count", 1)
    return t.select(
        "ticket_id",
        number("resolution_time_hours", 24).alias("resolution_time_hours"),
        number("resolution_attempts", 1).alias("resolution_attempts"),
        number("transferred_count", 0).alias("transferred_count"),
        responses.alias("response_count"),
        flag("escalated").alias("escalated"),
        flag("resolution_helpful").alias("resolution_helpful"),
        number("agent_experience_months", 12).alias("agent_experience_months"),
        flag(F.col("customer_tier") == "enterprise").alias("is_enterprise"),
        flag(F.col("priority") == "critical").alias("is_critical"),
        (responses <= 2).cast("int").alias("first_contact_resolution"),
        (F.col("satisfaction_score") >= 4).cast("int").alias("satisfied"),
    )


def standardised(df: DataFrame, cols: list[str]) -> DataFrame:
    """Each column minus its mean over its population deviation; constant ones become 0."""
    stats = df.agg(F.struct(*[
        f for c in cols for f in (
            F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))]).alias("s")).scalar()
    df = df.withColumn("_s", stats)
    return df.withColumns({
        c: (F.col(c) - F.col(f"_s.{c}_m"))
        / F.when(F.col(f"_s.{c}_s") > 0, F.col(f"_s.{c}_s")).otherwise(1.0)
        for c in cols}).drop("_s")


def satisfaction_drivers(tickets: DataFrame, min_rows: int = 100) -> DataFrame:
    """Standardised logistic coefficients, largest first, with rate and ranking quality.

    Spark minimises the mean loss, so the usual unit penalty on the summed loss is a
    penalty of 1 / n here.
    """
    spark = tickets.sparkSession
    schema = ("feature string, coefficient double, direction string, interpretation string, "
              "satisfaction_rate double, model_auc double, n_tickets long")
    rows = standardised(driver_matrix(tickets), DRIVER_FEATURES).select(
        array_to_vector(F.array(*[F.col(c).cast("double") for c in DRIVER_FEATURES])).alias("features"),
        F.col("satisfied").cast("double").alias("label")).persist()
    facts = rows.agg(F.count("*").alias("n"), F.avg("label").alias("rate")).first()
    if facts.n < min_rows:
        rows.unpersist()
        return spark.createDataFrame([], schema)
    model = LogisticRegression(
        maxIter=500, regParam=1.0 / facts.n, elasticNetParam=0.0, standardization=False, tol=1e-8,
    ).fit(rows)
    auc = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0).evaluate(model.transform(rows))
    rows.unpersist()
    coefficients = [float(c) for c in model.coefficients]
    out = []
    for name, c in zip(DRIVER_FEATURES, coefficients):
        text = HOURS_TEXT[c < 0] if name == "resolution_time_hours" else DRIVER_TEXT[name]
        out.append((name, c, "positive" if c > 0 else "negative", text,
                    float(facts.rate), float(auc), facts.n))
    return spark.createDataFrame(out, schema).orderBy(F.desc(F.abs("coefficient")), "feature")
