"""Feature, prediction, confidence and label drift.

Every detector returns rows of the common signal schema; statistics that a report
needs in full (edges, counts, new values) are DataFrames of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caselight.functions.expr import ladder, number, ratio
from caselight.operators.scale import quantiles
from caselight.schemas import (
    CONFIDENCE_STEPS, CORRECTION_STEPS, DRIFT_CATEGORIES, DRIFT_FEATURES, PSI_STEPS,
    SIGNAL_COLUMNS, severity_rank,
)

PSI_EPS = 1e-6
MIN_REFERENCE, MIN_CURRENT = 50, 10

ACTIONS = {
    "feature": "Check the feature's source; a changed upstream feed may need no retraining.",
    "new_values": "New categorical values; the model probably needs retraining.",
    "prediction": "Compare with feature drift; if the features moved too, this is expected.",
    "confidence": "If it lasts over a day, retrain; look for the product or category behind it.",
    "label": "Retrain with corrected labels, first for the most confused categories.",
}


def _signal(kind: str, severity: Column, metric: Column, current, reference, threshold,
            description: Column, dimensions: Column, action: str) -> list[Column]:
    return [
        F.lit(kind).alias("signal_type"), severity.alias("severity"), metric.alias("metric_name"),
        current.cast("double").alias("current_value"),
        reference.cast("double").alias("reference_value"),
        threshold.cast("double").alias("threshold"), description.alias("description"),
        dimensions.cast("map<string,string>").alias("dimensions"),
        F.lit(action).alias("recommended_action"),
    ]


def _long(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value) rows of the numeric features, one scan for all of them."""
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), number(f).alias("value")) for f in features])
    return df.select(F.inline(cells)).filter(F.col("value").isNotNull())


def psi_bins(reference: DataFrame, current: DataFrame, features: list[str],
             n_bins: int = 10, open_ended: bool = False, edges: DataFrame | None = None) -> DataFrame:
    """(feature, n_ref, n_cur, bins array<struct<ref, cur>>) over the reference deciles, or over
    ``edges`` (feature, edges) frozen before, such as those of stored sketches.

    All features of both sides are counted in one aggregate against a table of edges
    with one row per feature; a feature's bins then fit in one row. Bins are [a, b), the
    last one closed; values outside the reference range are dropped unless
    ``open_ended``. Empty bins are kept.
    """
    ref, cur = _long(reference, features), _long(current, features)
    probs = [i / n_bins for i in range(n_bins + 1)]
    if edges is None:
        edges = quantiles(ref, ["feature"], F.col("value"), probs, "edges", few_groups=True)
    edges = edges.withColumn("edges", F.array_distinct("edges"))
    if open_ended:
        inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
        edges = edges.withColumn("edges", F.concat(
            F.array(F.lit(float("-inf"))), inner, F.array(F.lit(float("inf")))))
    # one row per listed feature
    edges = F.broadcast(edges.withColumn("last", F.size("edges") - 1))

    both = ref.withColumn("is_ref", F.lit(True)).unionByName(cur.withColumn("is_ref", F.lit(False)))
    position = sum(
        (F.coalesce((F.get("edges", F.lit(i)) <= F.col("value")).cast("int"), F.lit(0))
         for i in range(n_bins + 1)), F.lit(0))
    inside = F.col("value").between(F.get("edges", F.lit(0)), F.get("edges", F.col("last")))
    counts = (
        both.join(edges, "feature")
        .withColumn("bin", F.when(inside & (F.col("last") > 0), F.least(position, F.col("last")))
                    .otherwise(0))
        .groupBy("feature", "last", "bin").agg(
            F.count_if("is_ref").alias("ref"), F.count_if(~F.col("is_ref")).alias("cur"))
    )
    packed = counts.groupBy("feature", "last").agg(
        F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"),
        F.map_from_entries(F.collect_list(F.struct("bin", F.struct("ref", "cur")))).alias("m"))
    zero = F.struct(F.lit(0).cast("long").alias("ref"), F.lit(0).cast("long").alias("cur"))
    filled = F.transform(
        F.sequence(F.lit(1), F.col("last")),
        lambda i: F.coalesce(F.try_element_at("m", i), zero))
    return packed.select(
        "feature", "n_ref", "n_cur",
        F.when(F.col("last") > 0, filled).otherwise(F.slice(F.array(zero), 1, 0)).alias("bins"))


def psi_table(reference: DataFrame, current: DataFrame, features: list[str] | None = None,
              n_bins: int = 10, open_ended: bool = False, edges: DataFrame | None = None) -> DataFrame:
    """(feature, psi, n_ref, n_cur); a constant reference has no bins and psi 0."""
    features = features or [
        f for f in DRIFT_FEATURES if f in reference.columns and f in current.columns]
    rows = psi_bins(reference, current, features, n_bins, open_ended, edges)
    total = lambda side: F.aggregate(
        "bins", F.lit(0).cast("long"), lambda acc, b: acc + b[side]) + PSI_EPS * F.size("bins")
    rows = rows.withColumns({"ref_all": total("ref"), "cur_all": total("cur")})

    def term(b: Column) -> Column:
        p = (b["ref"] + PSI_EPS) / F.col("ref_all")
        q = (b["cur"] + PSI_EPS) / F.col("cur_all")
        return (q - p) * F.log(q / p)

    psi = F.aggregate("bins", F.lit(0.0), lambda acc, b: acc + term(b))
    return rows.select("feature", psi.alias("psi"), "n_ref", "n_cur")


def feature_drift(reference: DataFrame, current: DataFrame,
                  features: list[str] | None = None) -> DataFrame:
    severity = ladder(F.col("psi"), PSI_STEPS)
    rows = psi_table(reference, current, features).filter(
        (F.col("n_ref") >= MIN_REFERENCE) & (F.col("n_cur") >= MIN_CURRENT)
    ).withColumn("severity", severity).filter(F.col("severity").isNotNull())
    return rows.select(*_signal(
        "feature_drift", F.col("severity"), F.concat(F.lit("psi_"), "feature"),
        F.col("psi"), F.lit(0.0), F.lit(0.2),
        F.format_string("Feature '%s' PSI=%.3f (%s)", "feature", "psi", "severity"),
        F.create_map(F.lit("feature"), "feature"), ACTIONS["feature"]))


def _values(df: DataFrame, cols: list[str]) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.inline(cells)).filter(F.col("value").isNotNull()).groupBy(
        "feature", "value").agg(F.count("*").alias("n"))


def new_values(reference: DataFrame, current: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """All values of the current rows the reference does not have, with their counts."""
    cols = cols or [c for c in DRIFT_CATEGORIES if c in reference.columns and c in current.columns]
    return _values(current, cols).join(
        _values(reference, cols).select("feature", "value"), ["feature", "value"], "left_anti")


def value_shares(reference: DataFrame, current: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Both distributions side by side, a missing value having share 0, and the
    Jensen-Shannon term of each value (their sum per feature is the divergence)."""
    cols = cols or [c for c in DRIFT_CATEGORIES if c in reference.columns and c in current.columns]

    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = _values(df, cols)
        total = counts.groupBy("feature").agg(F.sum("n").alias("total"))
        return counts.join(total, "feature").select(
            "feature", "value", (F.col("n") / F.col("total")).alias(name))

    both = shares(reference, "ref_share").join(
        shares(current, "cur_share"), ["feature", "value"], "full_outer").na.fill(
        0.0, ["ref_share", "cur_share"])
    p, q = F.col("ref_share"), F.col("cur_share")
    m = (p + q) / 2
    half = lambda x: F.when(x > 0, x * F.log(x / m) / 2).otherwise(0.0)
    return both.withColumn("js_term", half(p) + half(q))


def category_drift(reference: DataFrame, current: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One moderate signal per feature with new values; ``new_values`` lists them all."""
    rows = new_values(reference, current, cols).groupBy("feature").agg(
        F.count("*").alias("k"), F.sum("n").alias("rows"))
    return rows.select(*_signal(
        "feature_drift", F.lit("moderate"), F.concat(F.lit("new_categories_"), "feature"),
        F.col("k"), F.lit(0.0), F.lit(0.0),
        F.format_string("New values in '%s': %d values in %d tickets", "feature", "k", "rows"),
        F.create_map(F.lit("feature"), "feature", F.lit("n_values"), F.col("k").cast("string")),
        ACTIONS["new_values"]))


def distribution(df: DataFrame, col: str, name: str = "share") -> DataFrame:
    """Normalised value counts, NULL excluded."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("category")).agg(
        F.count("*").alias("n"))
    return counts.select("category", (F.col("n") / counts.agg(F.sum("n")).scalar()).alias(name))


def prediction_shift(reference: DataFrame, predictions: DataFrame, col: str = "predicted_category",
                     min_rows: int = 20) -> DataFrame:
    """Reference distribution (category, share) against current predictions."""
    counts = predictions.filter(F.col(col).isNotNull()).groupBy(
        F.col(col).alias("category")).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    ref = reference.select("category", F.col("share").alias("ref_prop"))
    out = ref.join(counts, "category", "left").withColumn("total", total).filter(
        F.col("total") >= min_rows)
    out = out.withColumn("cur_prop", F.coalesce("n", F.lit(0)) / F.col("total"))
    change = F.abs(F.col("cur_prop") - F.col("ref_prop")) / F.greatest("ref_prop", F.lit(0.01))
    return out.select("category", "ref_prop", "cur_prop", change.alias("rel_change"))


def prediction_drift(reference: DataFrame, predictions: DataFrame,
                     col: str = "predicted_category") -> DataFrame:
    rows = prediction_shift(reference, predictions, col).filter(F.col("rel_change") > 0.5)
    return rows.select(*_signal(
        "prediction_drift", F.when(F.col("rel_change") > 1.0, "severe").otherwise("moderate"),
        F.concat(F.lit("pred_dist_"), "category"), F.col("cur_prop"), F.col("ref_prop"),
        F.col("ref_prop") * 1.5,
        F.format_string("'%s' shifted: %.1f%% -> %.1f%% (%.0f%% change)", "category",
                        F.col("ref_prop") * 100, F.col("cur_prop") * 100, F.col("rel_change") * 100),
        F.create_map(F.lit("category"), "category"), ACTIONS["prediction"]))


def confidence_drift(reference_confidence: float | Column, predictions: DataFrame,
                     col: str = "confidence", window_label: str = "24h", min_rows: int = 10) -> DataFrame:
    ref = F.lit(reference_confidence) if isinstance(reference_confidence, (int, float)) else reference_confidence
    rows = predictions.agg(F.avg(col).alias("mean"), F.count(col).alias("n")).withColumn("ref", ref)
    drop = F.col("ref") - F.col("mean")
    rows = rows.withColumn("severity", ladder(drop, CONFIDENCE_STEPS)).filter(
        (F.col("n") >= min_rows) & F.col("severity").isNotNull())
    return rows.select(*_signal(
        "confidence_drift", F.col("severity"), F.lit(f"mean_confidence_{window_label}"),
        F.col("mean"), F.col("ref"), F.col("ref") - 0.10,
        F.format_string("Mean confidence dropped: %.3f -> %.3f (by %.3f)", "ref", "mean", drop),
        F.create_map().cast("map<string,string>"), ACTIONS["confidence"]))


def labelled(log: DataFrame, as_of: Column, window_hours: int = 168) -> DataFrame:
    since = as_of - F.make_dt_interval(hours=F.lit(window_hours))
    return log.filter(F.col("true_category").isNotNull() & (F.col("timestamp") >= since))


def confusions(rows: DataFrame, top: int = 5) -> DataFrame:
    """Most frequent corrected pairs, ties by name."""
    return (
        rows.filter("was_corrected").groupBy("predicted_category", "true_category")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "predicted_category", "true_category").limit(top)
    )


def label_drift(log: DataFrame, as_of: Column, window_hours: int = 168, min_rows: int = 20) -> DataFrame:
    rows = labelled(log, as_of, window_hours)
    facts = rows.agg(F.count("*").alias("total"), F.count_if("was_corrected").alias("corrected"))
    facts = facts.withColumn("rate", ratio(F.col("corrected"), F.col("total")))
    facts = facts.withColumn("severity", ladder(F.col("rate"), CORRECTION_STEPS)).filter(
        (F.col("total") >= min_rows) & F.col("severity").isNotNull())
    # five rows at most
    top = confusions(rows).agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws(" → ", "predicted_category", "true_category"), F.col("n").cast("string")))))
    return facts.withColumn("dims", top.scalar()).select(*_signal(
        "label_drift", F.col("severity"), F.lit("correction_rate_7d"), F.col("rate"), F.lit(0.0),
        F.lit(0.20),
        F.format_string(f"Correction rate: %.1f%% (%d/%d in {window_hours}h)",
                        F.col("rate") * 100, "corrected", "total"),
        F.col("dims"), ACTIONS["label"]))


def all_drift(reference: DataFrame, current: DataFrame, reference_distribution: DataFrame,
              predictions: DataFrame, reference_confidence, log: DataFrame, as_of: Column) -> DataFrame:
    """Signals of every detector, most severe first."""
    found = (
        feature_drift(reference, current)
        .unionByName(category_drift(reference, current))
        .unionByName(prediction_drift(reference_distribution, predictions))
        .unionByName(confidence_drift(reference_confidence, predictions))
        .unionByName(label_drift(log, as_of))
    )
    return found.select(*SIGNAL_COLUMNS).orderBy(
        severity_rank(F.col("severity")), "signal_type", "metric_name")
