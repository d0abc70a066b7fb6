"""Anomalies, drift and lifecycle decisions."""

import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from caselight.operators import anomaly, drift, lifecycle
from caselight.schemas import SIGNAL_COLUMNS

T0 = datetime(2024, 1, 1)


def now():
    return F.lit("2024-02-01 00:00:00").cast("timestamp")


def tickets(spark, rows):
    return spark.createDataFrame(rows, "ticket_id string, created_at timestamp, product string, category string")


def volume_rows(per_day, product="P", category="A", start=0):
    return [(f"{product}{category}{d}-{i}", T0 + timedelta(days=start + d, minutes=i), product, category)
            for d, n in enumerate(per_day) for i in range(n)]


def test_volume_spike(spark):
    # the last ticket is of day 14, so the baseline ends early on day 7
    rows = volume_rows([2, 4, 2, 4, 2, 4, 2, 4] + [20] * 7)
    rows += volume_rows([5] * 15, "Q")                 # no deviation: 35 in 6 days exceed the mean
    rows += volume_rows([9] * 3, "R", start=12)        # no baseline
    rows += volume_rows([3], "S") + volume_rows([30] * 2, "S", start=12)  # one baseline day
    got = {r["product"]: r for r in anomaly.volume_anomalies(tickets(spark, rows)).collect()}
    assert set(got) == {"P", "Q", "S"} and math.isinf(got["Q"].z)
    assert got["P"].severity == "critical" and got["S"].std_daily == 1.0
    stats = {r["product"]: r for r in anomaly.volume_statistics(tickets(spark, rows), ["product"]).collect()}
    assert "R" not in stats


def test_zero_deviation_above_mean_is_infinite(spark):
    rows = volume_rows([5] * 9 + [6] * 8)
    got = anomaly.volume_anomalies(tickets(spark, rows)).collect()
    assert len(got) == 1 and math.isinf(got[0].z)


def test_short_recent_span_counts_as_a_day(spark):
    rows = volume_rows([2, 3, 2, 3]) + volume_rows([4], start=30)
    got = anomaly.volume_statistics(tickets(spark, rows), ["product", "category"]).first()
    assert got.recent_daily == 4.0


def test_no_baseline_no_finding(spark):
    assert anomaly.volume_anomalies(tickets(spark, volume_rows([3, 3]))).count() == 0


@pytest.mark.parametrize("n", [1, 20, 700, 2000])
def test_ewma_equals_pandas(spark, n):
    rng = np.random.default_rng(n)
    xs = rng.choice([1.0, 2.0, 2.5, 3.0, 3.5, 5.0], n)
    rows = [(f"{i:05d}", T0 + timedelta(minutes=int(i)), "P", float(x)) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "ticket_id string, created_at timestamp, product string, x double").repartition(5)
    got = anomaly.ewma_last(df, "product", "x").first().ewma
    assert got == pytest.approx(pd.Series(xs).ewm(span=30).mean().iloc[-1], rel=1e-12)


def test_sentiment_drift(spark):
    def rows(p, old, new, n_old, n_new):
        return [(f"{p}{i}", T0 + timedelta(minutes=i), p, old if i < n_old else new) for i in range(n_old + n_new)]
    data = rows("bad", "satisfied", "angry", 300, 25) + rows("few", "satisfied", "angry", 40, 9)
    data += rows("flat", "neutral", "neutral", 50, 0) + rows("odd", "unheard", None, 30, 30)
    df = spark.createDataFrame(data, "ticket_id string, created_at timestamp, product string, customer_sentiment string")
    got = {r["product"]: r for r in anomaly.sentiment_drift(df).collect()}
    assert set(got) == {"bad"} and got["bad"].z < -2
    stats = {r["product"]: r for r in anomaly.sentiment_statistics(df).collect()}
    assert set(stats) == {"bad", "flat", "odd"} and stats["flat"].std == 0.1 and stats["odd"].mean == 3.0


def test_new_issue_types(spark):
    # 900 old rows, 100 new ones; order of rows must not matter
    cats = ["A"] * 891 + ["rare"] * 9 + ["A"] * 84 + ["new"] * 6 + ["rare"] * 6 + ["five"] * 4
    rows = [(f"{i:04d}", T0 + timedelta(minutes=i), "P", c) for i, c in enumerate(cats)]
    rows = [(*r[:2], "Q" if i == 999 else "P", r[3]) for i, r in enumerate(rows)]
    df = tickets(spark, rows).repartition(7)
    got = {(r["product"], r.category) for r in anomaly.new_issue_types(df).collect()}
    # rare: 9 of 900 is exactly 1 %, so it is not new; Q has no history
    assert got == {("P", "new"), ("Q", "five")}


def test_all_anomalies_sorted(spark):
    rows = volume_rows([2, 4, 2, 4, 2, 4, 2, 4, 3] + [20] * 6) + volume_rows([15], "P", "new", 15)
    df = tickets(spark, rows).withColumn("customer_sentiment", F.lit("neutral"))
    got = anomaly.all_anomalies(df).collect()
    assert [r.severity for r in got] == sorted([r.severity for r in got], key=["critical", "warning", "info"].index)
    assert {r.anomaly_type for r in got} == {"volume_spike", "new_issue_type"}
    assert got[-1].dimensions == {"product": "P", "category": "new"}


def psi(spark, ref, cur, **kw):
    make = lambda xs: spark.createDataFrame([(float(x),) for x in xs], "x double")
    return drift.psi_table(make(ref), make(cur), ["x"], **kw).first().psi


def numpy_psi(ref, cur):
    edges = np.unique(np.percentile(ref, np.linspace(0, 100, 11)))
    r, c = (np.histogram(x, bins=edges)[0] for x in (ref, cur))
    r, c = ((x + 1e-6) / (x.sum() + 1e-6 * len(x)) for x in (r, c))
    return float(np.sum((c - r) * np.log(c / r)))


def test_psi_definition(spark):
    rng = np.random.default_rng(42)
    a, shifted = rng.normal(100, 15, 1000), rng.normal(120, 15, 1000)
    assert psi(spark, a, a) < 0.01
    for ref, cur in ((a, shifted), (shifted, a), (rng.normal(100, 10, 500), rng.normal(100, 30, 500)),
                     (rng.integers(0, 4, 300), rng.integers(0, 5, 200)), (np.arange(50), np.arange(40, 90))):
        assert psi(spark, ref, cur) == pytest.approx(numpy_psi(ref, cur), rel=1e-9)
    assert psi(spark, a, shifted) > 0.1
    assert psi(spark, [5.0] * 60, [5.0] * 20) == 0.0
    assert psi(spark, np.arange(50), np.arange(40, 90), open_ended=True) > psi(spark, np.arange(50), np.arange(50))


def test_feature_drift(spark):
    rng = np.random.default_rng(1)
    make = lambda mu, n: spark.createDataFrame(
        [(float(x), int(y)) for x, y in zip(rng.normal(mu, 50, n), rng.integers(0, 1000, n))],
        "ticket_text_length double, account_age_days int")
    ref = make(200, 1000)
    assert drift.feature_drift(ref, ref).count() == 0
    got = {r.metric_name: r for r in drift.feature_drift(ref, make(300, 200)).collect()}
    assert got["psi_ticket_text_length"].severity in ("moderate", "severe")
    assert drift.feature_drift(ref, make(300, 9)).count() == 0


def test_text_numbers_are_coerced(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,), ("3",)], "affected_users string")
    assert drift.psi_table(df, df, ["affected_users"]).first().n_ref == 2


def test_new_values(make):
    ref = make([("A",), ("B",), ("C",)] * 20, "product string")
    cur = make([("A",), ("B",), ("D",), (None,)] * 5, "product string")
    assert [tuple(r) for r in drift.new_values(ref, cur).collect()] == [("product", "D", 5)]
    sig = drift.category_drift(ref, cur).first()
    assert sig.metric_name == "new_categories_product" and sig.severity == "moderate" and sig.current_value == 1


def test_prediction_drift(make):
    ref = make([("Tech", .35), ("Billing", .15), ("Feature", .12)], "category string, share double")
    def preds(**n):
        return make([(c,) for c, k in n.items() for _ in range(k)], "predicted_category string")
    assert drift.prediction_drift(ref, preds(Tech=35, Billing=15, Feature=12, Other=38)).count() == 0
    got = {r.metric_name: r for r in drift.prediction_drift(ref, preds(Tech=80, Billing=10, Other=10)).collect()}
    assert got["pred_dist_Tech"].severity == "severe" and got["pred_dist_Feature"].current_value == 0.0
    assert drift.prediction_drift(ref, preds(Tech=19)).count() == 0


def test_confidence_drift(make):
    conf = lambda xs: make([(x,) for x in xs], "confidence double")
    assert drift.confidence_drift(.85, conf([.84, .86, .83, .87] * 25)).count() == 0
    assert drift.confidence_drift(.85, conf([.65, .63, .68, .62] * 25)).first().severity == "severe"
    assert drift.confidence_drift(.85, conf([.1] * 9)).count() == 0


def log(spark, n, wrong, age_hours=1):
    at = datetime(2024, 2, 1) - timedelta(hours=age_hours)
    return spark.createDataFrame(
        [(str(i), at, "A", "B" if i < wrong else "A", i < wrong) for i in range(n)],
        "ticket_id string, timestamp timestamp, predicted_category string, true_category string, was_corrected boolean")


@pytest.mark.parametrize("n, wrong, age, severity", [
    (100, 9, 1, None), (100, 10, 1, "minor"), (100, 20, 1, "moderate"), (100, 30, 1, "severe"),
    (19, 19, 1, None), (100, 50, 169, None)])
def test_label_drift(spark, n, wrong, age, severity):
    got = drift.label_drift(log(spark, n, wrong, age), now()).collect()
    assert [r.severity for r in got] == ([severity] if severity else [])
    if got:
        assert got[0].dimensions == {"A → B": str(wrong)}


def signals(spark, *rows):
    df = spark.createDataFrame([(t, s) for t, s in rows], "signal_type string, severity string")
    for c in SIGNAL_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None))
    return df


@pytest.mark.parametrize("rows, days, corrections, want", [
    ([], 0, 0, (False, "manual")), ([], 10, 0, (True, "scheduled")), ([], None, 0, (False, "manual")),
    ([("feature_drift", "severe"), ("confidence_drift", "severe")], 1, 0, (True, "drift")),
    ([("feature_drift", "severe")], 1, 0, (False, "manual")),
    ([("label_drift", "moderate")], 1, 200, (True, "feedback")),
    ([("label_drift", "minor")], 1, 500, (False, "manual")),
    ([("label_drift", "severe")], 1, 199, (False, "manual")),
])
def test_retrain_decision(spark, rows, days, corrections, want):
    last = F.lit(None).cast("timestamp") if days is None else now() - F.make_dt_interval(days=F.lit(days))
    got = lifecycle.retrain_decision(signals(spark, *rows), now(), last, F.lit(corrections)).first()
    assert (got.should_retrain, got.trigger) == want


def test_training_sets(make):
    schema = "ticket_id string, created_at timestamp, category string"
    old = make([("1", T0, "A"), ("2", T0, "B")], schema)
    new = make([("2", T0, "B2"), ("3", datetime(2024, 1, 20), "C")], schema)
    corr = make([("1", "X", T0), ("1", "Y", T0 + timedelta(days=1)), ("9", "Z", T0), ("3", "W", T0)],
                "ticket_id string, corrected string, corrected_at timestamp")
    got = {r.ticket_id: r.category for r in lifecycle.training_set(old, corr, new).collect()}
    assert got == {"1": "Y", "2": "B", "3": "C"}
    got = {r.ticket_id: r.category for r in lifecycle.training_set(old, corr, new, "recent_only", now()).collect()}
    assert got == {"3": "W"}
    with pytest.raises(ValueError):
        lifecycle.training_set(old, corr, new, "weighted")


def test_shadow_report(make):
    empty = make([], "ticket_id string, predicted_category string, confidence double")
    assert lifecycle.shadow_report(empty, empty, now(), now()).first().status == "no_data"
    rows = make([(str(i), "A", 0.8) for i in range(50)], "ticket_id string, predicted_category string, confidence double")
    day_ago = now() - F.expr("INTERVAL 24 HOURS")
    r = lifecycle.shadow_report(rows, rows, day_ago, now()).first()
    assert (r.n_predictions, r.agreement_rate, r.hours_running, r.ready_for_promotion) == (50, 1.0, 24.0, False)
    many = make([(str(i), "A", 0.8) for i in range(100)], "ticket_id string, predicted_category string, confidence double")
    assert lifecycle.shadow_report(many, many, day_ago, now()).first().ready_for_promotion


def test_attach_labels_and_gate(make):
    log_rows = make([("1", "A", None, False), ("1", "B", None, False), ("2", "A", None, False)],
                    "ticket_id string, predicted_category string, true_category string, was_corrected boolean")
    labels = make([("1", "A", T0), ("1", "B", T0 + timedelta(hours=1))],
                  "ticket_id string, true_category string, labelled_at timestamp")
    got = sorted((r.ticket_id, r.predicted_category, r.true_category, r.was_corrected)
                 for r in lifecycle.attach_labels(log_rows, labels).collect())
    assert got == [("1", "A", "B", True), ("1", "B", "B", False), ("2", "A", None, False)]
    val = make([("a", "a", "a"), ("b", "a", "b")], "y string, old string, new string")
    gate = lifecycle.model_gate(val, "y", "old", "new").first()
    assert gate.new_f1 == 1.0 and gate.should_deploy
    assert not lifecycle.model_gate(val, "y", "new", "new").first().should_deploy


def test_correction_rate(make):
    rows = make([("A", True, datetime(2024, 1, 30)), (None, False, datetime(2024, 1, 31)),
                 (None, None, datetime(2024, 1, 31)), ("A", True, datetime(2024, 1, 1))],
                "corrected_category string, resolution_accepted boolean, feedback_at timestamp")
    r = lifecycle.correction_rate(rows, now()).first()
    assert (r.total, r.correction_rate, r.acceptance_rate) == (3, pytest.approx(1 / 3), 0.5)
    r = lifecycle.correction_rate(rows.limit(0), now()).first()
    assert (r.total, r.correction_rate, r.acceptance_rate) == (0, 0.0, 0.0)
