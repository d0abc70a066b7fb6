"""From signals to decisions: retraining, training sets, model gate, shadow runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from caselight.functions.expr import ratio, whole_days
from caselight.operators.evaluation import weighted_f1
from caselight.operators.scale import top_n_per_group


@dataclass(frozen=True)
class RetrainingPolicy:
    """Fixed defaults of the decision rules."""

    max_days_without_retrain: int = 7
    min_severe_signals: int = 2
    min_new_labels: int = 200
    recent_days: int = 30
    min_f1_gain: float = 0.005
    shadow_hours: int = 24
    shadow_predictions: int = 100


def retrain_decision(signals: DataFrame, as_of: Column, last_retrain_at: Column,
                     corrections: Column, policy: RetrainingPolicy = RetrainingPolicy()) -> DataFrame:
    """One row (should_retrain, trigger, reason); the first matching rule wins."""
    severe = F.col("severity") == "severe"
    label = (F.col("signal_type") == "label_drift") & F.col("severity").isin("moderate", "severe")
    facts = signals.agg(
        F.count_if(severe).alias("n_severe"), F.count_if(label).alias("n_label"),
    ).withColumns({
        "days": whole_days(as_of, last_retrain_at), "corrections": corrections,
    })
    scheduled = F.coalesce(F.col("days") >= policy.max_days_without_retrain, F.lit(False))
    drift = F.col("n_severe") >= policy.min_severe_signals
    feedback = F.coalesce(
        (F.col("corrections") >= policy.min_new_labels) & (F.col("n_label") > 0), F.lit(False))
    return facts.select(
        (scheduled | drift | feedback).alias("should_retrain"),
        F.when(scheduled, "scheduled").when(drift, "drift").when(feedback, "feedback")
        .otherwise("manual").alias("trigger"),
        F.when(scheduled, F.format_string(
            f"Scheduled: %d days since last retrain (max={policy.max_days_without_retrain})", "days"))
        .when(drift, F.format_string("Multiple severe drift signals: %d", "n_severe"))
        .when(feedback, F.format_string(
            "%d corrections available, correction rate elevated", "corrections"))
        .otherwise("No retraining trigger met").alias("reason"),
    )


def latest_corrections(corrections: DataFrame) -> DataFrame:
    """The last correction of every ticket (ticket_id, corrected, corrected_at)."""
    return corrections.filter(F.col("corrected").isNotNull()).groupBy("ticket_id").agg(
        F.max(F.struct("corrected_at", "corrected")).alias("last")).select("ticket_id", "last.corrected")


def override_labels(tickets: DataFrame, corrections: DataFrame, label: str = "category") -> DataFrame:
    cols = tickets.columns
    return tickets.join(latest_corrections(corrections), "ticket_id", "left").withColumn(
        label, F.coalesce("corrected", label)).select(*cols)


def training_set(original: DataFrame, corrections: DataFrame, recent: DataFrame,
                 strategy: str = "augment", as_of: Column | None = None,
                 policy: RetrainingPolicy = RetrainingPolicy()) -> DataFrame:
    """"augment": original rows with corrected labels plus unseen tickets.
    "recent_only": tickets of the last days with corrected labels."""
    if strategy == "augment":
        unseen = recent.join(original.select("ticket_id"), "ticket_id", "left_anti")
        return override_labels(original, corrections).unionByName(unseen, allowMissingColumns=True)
    if strategy == "recent_only":
        if as_of is None:
            raise ValueError("recent_only needs as_of")
        since = as_of - F.make_dt_interval(days=F.lit(policy.recent_days))
        return override_labels(recent.filter(F.col("created_at") >= since), corrections)
    raise ValueError(f"Unknown strategy: {strategy}")


def model_gate(validation: DataFrame, label: str, old_prediction: str, new_prediction: str,
               policy: RetrainingPolicy = RetrainingPolicy()) -> DataFrame:
    """Compare two prediction columns on the same rows; deploy on enough gain."""
    old = weighted_f1(validation, label, old_prediction).select(F.col("weighted_f1").alias("old_f1"))
    new = weighted_f1(validation, label, new_prediction).scalar()
    out = old.withColumn("new_f1", new).withColumn("improvement", F.col("new_f1") - F.col("old_f1"))
    return out.withColumn("should_deploy", F.col("improvement") >= policy.min_f1_gain)


def attach_labels(log: DataFrame, labels: DataFrame) -> DataFrame:
    """Every log row of a ticket gets the ticket's latest true label."""
    latest = labels.groupBy("ticket_id").agg(
        F.max(F.struct("labelled_at", F.col("true_category").alias("_true"))).alias("last")
    ).select("ticket_id", "last._true")
    return log.drop("true_category", "was_corrected").join(latest, "ticket_id", "left").withColumns({
        "true_category": F.col("_true"),
        "was_corrected": F.coalesce(F.col("predicted_category") != F.col("_true"), F.lit(False)),
    }).drop("_true")


def latest_predictions(log: DataFrame) -> DataFrame:
    """The last log row of every ticket (ticket_id, predicted_category, confidence); without a
    ``timestamp`` the greatest row."""
    order = [c for c in ("timestamp", "predicted_category", "confidence") if c in log.columns]
    return log.groupBy("ticket_id").agg(
        F.max(F.struct(*order)).alias("last")
    ).select("ticket_id", "last.predicted_category", "last.confidence")


def shadow_report(primary: DataFrame, shadow: DataFrame, started_at: Column, as_of: Column,
                  policy: RetrainingPolicy = RetrainingPolicy()) -> DataFrame:
    """Agreement and confidence of a shadow model on the tickets both scored.

    A ticket that was scored several times counts once, with its latest prediction on
    each side.
    """
    p = latest_predictions(primary).select("ticket_id", F.col("predicted_category").alias("p_cat"), F.col("confidence").alias("p_conf"))
    s = latest_predictions(shadow).select("ticket_id", F.col("predicted_category").alias("s_cat"), F.col("confidence").alias("s_conf"))
    facts = p.join(s, "ticket_id").agg(
        F.count("*").alias("n_predictions"),
        F.avg(F.col("p_cat").eqNullSafe(F.col("s_cat")).cast("int")).alias("agreement_rate"),
        F.avg("p_conf").alias("primary_mean_confidence"),
        F.avg("s_conf").alias("shadow_mean_confidence"),
    )
    hours = (F.unix_micros(as_of) - F.unix_micros(started_at)) / F.lit(3_600_000_000)
    facts = facts.withColumn("hours_running", hours).withColumn(
        "confidence_delta", F.col("shadow_mean_confidence") - F.col("primary_mean_confidence"))
    ready = (
        (F.col("n_predictions") >= policy.shadow_predictions)
        & (F.col("hours_running") >= policy.shadow_hours)
        & (F.col("confidence_delta") >= 0)
    )
    return facts.withColumn(
        "status", F.when(F.col("n_predictions") > 0, "running").otherwise("no_data")
    ).withColumn("ready_for_promotion", F.coalesce(ready, F.lit(False)))


def correction_rate(feedback: DataFrame, as_of: Column, window_days: int = 7) -> DataFrame:
    since = as_of - F.make_dt_interval(days=F.lit(window_days))
    rows = feedback.filter(F.col("feedback_at") >= since).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("corrected_category").isNotNull()).alias("corrected"),
        F.count_if("resolution_accepted").alias("accepted"),
        F.count_if(~F.col("resolution_accepted")).alias("rejected"),
    )
    return rows.select(
        F.lit(window_days).alias("window_days"), "total",
        ratio(F.col("corrected"), F.col("total")).alias("correction_rate"),
        ratio(F.col("accepted"), F.col("accepted") + F.col("rejected")).alias("acceptance_rate"))


def metric_snapshot(values: DataFrame, metrics: list[str], as_of: Column,
                    dimensions: Column | None = None) -> DataFrame:
    """One-row facts as (metric_name, metric_value, dimensions, snapshot_at) rows."""
    dims = dimensions if dimensions is not None else F.create_map().cast("map<string,string>")
    cells = F.array(*[
        F.struct(F.lit(m).alias("metric_name"), F.col(m).cast("double").alias("metric_value"))
        for m in metrics])
    return values.select(F.inline(cells)).withColumns({"dimensions": dims, "snapshot_at": as_of})


def recent_predictions(log: DataFrame, n: int = 1000) -> DataFrame:
    """The newest ``n`` log rows of every model."""
    return top_n_per_group(log, ["model_name"], [F.desc("timestamp"), F.desc("ticket_id")], n).drop("rank")


def monitoring_report(signals: DataFrame, decision: DataFrame, shadow: DataFrame,
                      predictions: DataFrame) -> DataFrame:
    """One row: counts of signals, mean confidence, decision and shadow state."""
    facts = signals.agg(
        F.count("*").alias("n_signals"),
        F.count_if(F.col("severity") == "severe").alias("n_severe"),
        F.count_if(F.col("severity") == "moderate").alias("n_moderate"),
        F.count_if(F.col("severity") == "minor").alias("n_minor"))
    recent = predictions.agg(F.struct(F.count("*").alias("n"), F.avg("confidence").alias("c"))).scalar()
    chosen = decision.select(F.struct("should_retrain", "trigger", "reason")).scalar()
    run = shadow.select(F.struct("status", "agreement_rate", "ready_for_promotion")).scalar()
    return facts.withColumns({"_r": recent, "_d": chosen, "_s": run}).select(
        "n_signals", "n_severe", "n_moderate", "n_minor",
        F.col("_r.n").alias("n_recent_predictions"), F.col("_r.c").alias("mean_confidence"),
        "_d.should_retrain", "_d.trigger", "_d.reason",
        F.col("_s.status").alias("shadow_status"),
        F.col("_s.agreement_rate").alias("shadow_agreement"),
        F.col("_s.ready_for_promotion").alias("shadow_ready"))
