"""Quality checks, split, features, graph tables, sources."""

import bisect
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caselight.operators import features, graph, lifecycle, quality, split
from caselight.plans import batch
from caselight.session import shared_dir
from caselight.sources import tickets as store

DAY = datetime(2024, 1, 1)


def daily(spark, n=100):
    return spark.createDataFrame(
        [(f"T{i}", DAY + timedelta(days=i), "A" if i < 50 else "B", "x") for i in range(n)],
        "ticket_id string, created_at timestamp, category string, description string")


def test_split_is_ordered(spark):
    df = split.temporal_split(daily(spark).repartition(5))
    rep = {r.data_split: r for r in split.split_report(df).collect()}
    assert {k: r.n for k, r in rep.items()} == {"train": 70, "val": 15, "test": 15}
    assert rep["train"].last_at < rep["val"].first_at <= rep["val"].last_at < rep["test"].first_at


def test_head_and_tail_leave_the_gap(spark):
    got = split.head_and_tail(daily(spark, 15)).groupBy("is_tail").count().collect()
    assert {r.is_tail: r["count"] for r in got} == {False: 13, True: 1}


def test_checks(spark, make):
    good = {r.check: r.passed for r in quality.dataset_checks(daily(spark)).collect()}
    assert all(good.values()) and len(good) == 4
    bad = quality.dataset_checks(make([("a", None), ("a", "c")], "ticket_id string, category string"))
    got = {r.check: (r.passed, r.details) for r in bad.collect()}
    assert got["no_duplicate_ids"][0] is False and got["required_fields"][0] is False
    assert got["category_not_null"] == (False, "Null: 1")
    assert quality.check_summary(bad).first().asDict() == {"total": 4, "passed": 1, "failed": 3}
    assert len(quality.enforce(bad)) == 3
    with pytest.raises(ValueError):
        quality.enforce(bad, "raise")


def test_input_contract(make):
    df = make([("Test", "desc"), (None, "no subject"), ("x" * 501, ""), ("a", "y" * 10001)],
              "subject string, description string")
    valid, bad = quality.split_valid(df)
    row = valid.first()
    assert (row.affected_users, row.response_count, row.business_impact, row.ticket_text_length) == (1, 1, "medium", 4)
    assert sorted(tuple(r.reasons) for r in bad.collect()) == [
        ("description too long",), ("subject missing",), ("subject too long", "description empty")]


def test_ingest_summary(spark):
    got = {(r.kind, r["name"]): r.n for r in quality.ingest_summary(split.temporal_split(daily(spark))).collect()}
    assert got[("total", None)] == 100 and got[("split", "val")] == 15 and got[("category", "B")] == 50


def test_features_defaults_and_calendar(make):
    rows = [("1", None, None, None, None, "2024-01-06 07:59:00", None, None),   # Saturday
            ("2", "ab", "w1  w2 ERROR_A ERROR_A", "c", "p", "2024-01-07 08:00:00", 5, 2.0),
            ("3", "é", "one", "c", "p", "2024-01-08 18:30:00", None, 4.0),
            ("4", "", "", "d", "q", "2024-01-09 19:00:00", 2, None)]
    df = make(rows, "ticket_id string, subject string, description string, customer_id string, product string, "
                    "created_at string, satisfaction_score int, resolution_time_hours double"
              ).withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = {r.ticket_id: r for r in features.ticket_features(df).collect()}
    a, b, c, d = (got[i] for i in "1234")
    assert (a.subject_length, a.word_count, a.customer_ticket_count_30d) == (0, 0, 0)
    assert (a.customer_avg_satisfaction, a.product_avg_resolution_hrs, a.days_since_product_update) == (3.5, 24.0, 90)
    assert (b.word_count, b.error_code_count, b.combined_text_length) == (4, 2, 2 + 22)
    assert (b.customer_ticket_count_30d, b.customer_avg_satisfaction, b.product_avg_resolution_hrs) == (2, 5.0, 3.0)
    assert [x.is_weekend for x in (a, b, c, d)] == [True, True, False, False]
    assert [x.is_after_hours for x in (a, b, c, d)] == [True, False, False, True]
    assert (a.day_of_week, b.day_of_week, c.day_of_week) == (5, 6, 0)
    assert d.product_avg_resolution_hrs == 24.0 and d.customer_escalation_rate == 0.0


def test_trailing_counts_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(str(i), None if i % 17 == 0 else ("hot" if i % 2 else f"c{i % 5}"), f"p{i % 3}",
             1704067200 + rng.randrange(60 * 86400) // (1 if i % 3 else 3600) * (1 if i % 3 else 3600))
            for i in range(300)]
    df = spark.createDataFrame(rows, "ticket_id string, customer_id string, product string, s long").select(
        "ticket_id", "customer_id", "product", F.timestamp_seconds("s").alias("created_at"))
    times = defaultdict(list)
    for _, c, p, s in rows:
        times["c", c].append(s)
        times["p", p].append(s)
    for v in times.values():
        v.sort()

    def count(key, s, days):
        v = times[key]
        return bisect.bisect_left(v, s) - bisect.bisect_left(v, s - days * 86400)

    want = {i: (0 if c is None else count(("c", c), s, 30), count(("p", p), s, 7)) for i, c, p, s in rows}
    got = {r.ticket_id: (r.customer_ticket_count_30d, r.product_ticket_volume_7d)
           for r in features.trailing_features(df).collect()}
    assert got == want


@pytest.fixture
def graph_tickets(make):
    rows = [
        ("1", DAY, "P", "A", "R1", "x" * 600, True, 2.0, "ERROR_X ERROR_X ERROR_Y"),
        ("2", DAY, "P", "A", "R1", "later", False, 4.0, "ERROR_X"),
        ("3", DAY, None, "A", "R1", None, True, 6.0, "ERROR_X"),
        ("4", DAY - timedelta(days=1), "P", "A", None, "no code", None, None, "ERROR_X"),
        ("5", DAY, "Q", "B", "R2", "fix_setup now", None, 1.0, None),
    ]
    return make(rows, "ticket_id string, created_at timestamp, product string, category string, "
                      "resolution_code string, resolution string, resolution_helpful boolean, "
                      "resolution_time_hours double, error_logs string")


def test_graph_tables(graph_tickets):
    issues = {(r["product"], r.issue_type): (r.frequency, r.avg_resolution_hrs)
              for r in graph.product_issues(graph_tickets).collect()}
    assert issues == {("P", "A"): (3, 3.0), ("Q", "B"): (1, 1.0)}
    sol = {(r.issue_type, r.resolution_code): r for r in graph.issue_solutions(graph_tickets).collect()}
    assert set(sol) == {("A", "R1"), ("B", "R2")}
    a = sol["A", "R1"]
    assert (a.usage_count, a.success_rate, a.resolution_template) == (2, 0.5, "x" * 600)
    assert sol["B", "R2"].success_rate is None
    ec = {(r.error_code, r["product"]): r for r in graph.error_code_mapping(graph_tickets).collect()}
    assert set(ec) == {("ERROR_X", "P"), ("ERROR_Y", "P")}
    assert (ec["ERROR_X", "P"].occurrences, ec["ERROR_X", "P"].resolution_code) == (3, "R1")
    assert ec["ERROR_X", "P"].resolution_text == "no code"


def test_related_context(make, graph_tickets):
    sol = make([("A", f"R{i}", f"use set up {i}" if i == 3 else "t", None if i == 0 else i / 10, 1) for i in range(7)],
               "issue_type string, resolution_code string, resolution_template string, success_rate double, usage_count long")
    q = make([("q", "P", "A", "Set_Up", ["ERROR_X", "ERROR_Y", "ERROR_X"]), ("r", "P", "B", None, [])],
             "query_id string, product string, category string, subcategory string, error_codes array<string>")
    got = graph.related_context(q, graph.product_issues(graph_tickets), sol,
                                graph.error_code_mapping(graph_tickets)).collect()
    codes = {(r.kind, r["rank"]): r.code for r in got}
    # the unknown rate comes first of five, then R6..R3; R3 mentions the subcategory
    assert [codes["template", i] for i in range(1, 6)] == ["R6", "R5", "R3", "R4", "R0"]
    assert [codes["error_code", i] for i in (1, 2)] == ["ERROR_X", "ERROR_Y"]
    assert {r.query_id for r in got} == {"q"}


def test_json_array_and_store(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text('[{"ticket_id": "1", "created_at": "2024-01-01T10:00:00Z", "tags": ["a"], "escalated": true},'
                    ' {"ticket_id": "2", "created_at": "2024-01-02T10:00:00Z"}]')
    df = store.read_json(spark, str(path))
    assert df.count() == 2 and df.filter(F.col("ticket_id") == "1").first().tags == ["a"]
    base = shared_dir(spark, "test-store")
    store.append_tickets(df, base)
    store.append_tickets(df, base)
    back = store.read_tickets(spark, base)
    assert back.count() == 4 and "created_date" in back.columns
    assert [r.ticket_id for r in store.latest_tickets(back.dropDuplicates(["ticket_id"]), 1).collect()] == ["2"]


def test_graph_store_and_logs(spark, graph_tickets):
    base = shared_dir(spark, "test-graph")
    store.replace_graph_tables(graph_tickets, base)
    store.replace_graph_tables(graph_tickets, base)
    assert [t.count() for t in store.read_graph_tables(spark, base)] == [2, 2, 2]
    log = spark.createDataFrame([("1", "A", 0.5)], "ticket_id string, predicted_category string, confidence double")
    store.append_predictions(log, f"{base}/log")
    assert spark.read.parquet(f"{base}/log").first().was_corrected is None
    store.append_events(spark.createDataFrame([("e", "classification")], "event_id string, event_type string"), f"{base}/ev")
    assert spark.read.parquet(f"{base}/ev").first().status == "success"


def test_ingest_answer_and_monitor(spark, graph_tickets):
    base = shared_dir(spark, "test-jobs")
    raw = graph_tickets.withColumns({
        "subject": F.concat(F.lit("subject "), "ticket_id"), "description": F.lit("desc ERROR_X"),
        "satisfaction_score": F.lit(4)})
    got = {(r.kind, r["name"]): r.n for r in batch.ingest(raw, base).collect()}
    assert got["total", None] == 5 and got["check", "no_duplicate_ids"] == 1
    assert got["table", "features"] == 5 and got["table", "indexed"] == 4 == got["table", "vectors"]
    q = spark.createDataFrame(
        [("q", "subject 5", "fix_setup ERROR_X", "Q", "B", None, None, None)],
        "query_id string, subject string, description string, product string, predicted_category string, "
        "predicted_subcategory string, predicted_priority string, predicted_sentiment string")
    results, context = batch.answer(spark, q, base)
    assert [r.ticket_id for r in results.collect()] == ["5"]
    assert {(r.kind, r.code) for r in context.collect()} == {("template", "R2"), ("error_code", "ERROR_X")}
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    signals = spark.createDataFrame(
        [("feature_drift", "severe"), ("label_drift", "severe")], "signal_type string, severity string")
    log = spark.createDataFrame([("1", "A", 0.7)], "ticket_id string, predicted_category string, confidence double")
    shadow = lifecycle.shadow_report(log, log, now, now)
    rep = batch.monitor(signals, log, shadow, base, now, now, F.lit(0)).first()
    assert (rep.n_severe, rep.trigger, rep.n_recent_predictions, rep.shadow_status) == (2, "drift", 1, "running")
    assert spark.read.parquet(f"{base}/metrics").count() == 3


def test_unreadable_records_are_quarantined(spark, tmp_path):
    good = [f'{{"ticket_id": "{i}", "created_at": "2024-01-0{i}T00:00:00", "subject": "s", "description": "d"}}' for i in range(1, 6)]
    bad = ['{"ticket_id": "broken', '{"ticket_id": "7", "created_at": "no date"}', '{"ticket_id": "8", "satisfaction_score": "high"}']
    (tmp_path / "t.json").write_text("\n".join(good + bad))
    readable, unreadable = store.split_readable(store.read_json(spark, str(tmp_path / "t.json"), lines=True))
    assert sorted(r.ticket_id for r in readable.collect()) == ["1", "2", "3", "4", "5"]
    assert sorted(r["_corrupt_record"] for r in unreadable.collect()) == sorted(bad)
    whole, none = store.split_readable(daily(spark, 3))
    assert (whole.count(), none.count()) == (3, 0)
