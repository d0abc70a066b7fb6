"""Analytics, learning, evaluation, label correction and streams."""

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from caselight.operators import analytics, evaluation, learning, relabel, scale
from caselight.session import shared_dir
from caselight.streaming import jobs

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(7)
    rows = [(str(i), T0 + timedelta(hours=i), f"A{i % 10}", rng.choice([None, 1, 2, 3, 4, 5]),
             rng.expovariate(1 / 20), rng.randint(1, 3), rng.randint(0, 2), rng.randint(1, 6),
             rng.random() < .2, rng.choice([True, False, None]), rng.randint(1, 60),
             rng.choice(["enterprise", "free"]), rng.choice(["critical", "low"]), rng.choice("XYZ"), "net")
            for i in range(500)]
    return spark.createDataFrame(
        rows, "ticket_id string, created_at timestamp, agent_id string, satisfaction_score int, "
              "resolution_time_hours double, resolution_attempts int, transferred_count int, response_count int, "
              "escalated boolean, resolution_helpful boolean, agent_experience_months int, customer_tier string, "
              "priority string, category string, agent_specialization string").persist()


def test_agents(scored):
    agents = analytics.agent_performance(scored)
    rows = {r.agent_id: r for r in agents.collect()}
    assert len(rows) == 10
    mine = [r for r in scored.collect() if r.agent_id == "A3"]
    a = rows["A3"]
    assert a.ticket_count == 50 and a.experience_months == mine[0].agent_experience_months
    assert a.median_resolution_hours == pytest.approx(np.median([r.resolution_time_hours for r in mine]))
    cats = [r.category for r in mine]
    assert a.primary_category == min(set(cats), key=lambda c: (-cats.count(c), c))
    report = analytics.agent_report(agents).collect()
    ranked = sorted(rows, key=lambda k: (-rows[k].perf_score, k))
    pick = lambda s: [r.agent_id for r in sorted((r for r in report if r.section == s), key=lambda r: r.position)]
    assert pick("agents") == ranked and pick("top_performers") == ranked[:5] and pick("needs_coaching") == ranked[-5:]


def newton(x, y, steps=50):
    """Unit-penalised logistic regression on the summed loss, intercept free."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, pen = np.zeros(x1.shape[1]), np.eye(x1.shape[1])
    pen[-1, -1] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x1 @ w))
        w -= np.linalg.solve(x1.T @ (x1 * (p * (1 - p))[:, None]) + pen, x1.T @ (p - y) + pen @ w)
    return w[:-1]


def test_satisfaction_drivers(scored):
    got = {r.feature: r for r in analytics.satisfaction_drivers(scored).collect()}
    rows = analytics.driver_matrix(scored).collect()
    x = np.array([[float(r[f]) for f in analytics.DRIVER_FEATURES] for r in rows])
    y = np.array([r.satisfied for r in rows])
    sd = x.std(axis=0)
    want = newton((x - x.mean(axis=0)) / np.where(sd > 0, sd, 1), y)
    assert [got[f].coefficient for f in analytics.DRIVER_FEATURES] == pytest.approx(list(want), abs=1e-4)
    one = next(iter(got.values()))
    assert 0 < one.satisfaction_rate < 1 and 0.5 <= one.model_auc <= 1 and one.n_tickets == len(rows)
    assert analytics.satisfaction_drivers(scored.limit(50)).count() == 0


def test_f1(make):
    df = make(list(zip("ABCABC", "ABCACB")), "y string, p string")
    f1 = {r["class"]: r.f1 for r in evaluation.per_class_f1(df, "y", "p").collect()}
    assert f1 == {"A": 1.0, "B": 0.5, "C": 0.5}
    assert evaluation.weighted_f1(df, "y", "p").first().weighted_f1 == pytest.approx(2 / 3)
    odd = make([("A", "Z"), ("A", "A")], "y string, p string")
    assert evaluation.weighted_f1(odd, "y", "p").first().weighted_f1 == pytest.approx(2 / 3)


def test_class_weights(make):
    df = make([("a",)] * 3 + [("b",)], "y string")
    got = {r.y: r.weight for r in evaluation.class_weights(df, "y").collect()}
    assert got == {"a": pytest.approx(4 / 6), "b": 2.0}


def test_route(make):
    schema = "ticket_id string, probabilities map<string,double>"
    a = make([("1", {"x": .7, "y": .3}), ("2", {"x": .55, "y": .45}), ("3", {"x": .5, "y": .5})], schema)
    b = make([("1", {"x": .0, "y": 1.0}), ("2", {"x": .2, "y": .8})], schema)
    got = {r.ticket_id: r for r in evaluation.route(a, b).collect()}
    assert (got["1"].predicted_category, got["1"].ensembled) == ("x", False)
    assert (got["2"].predicted_category, got["2"].confidence) == ("y", pytest.approx(.625))
    assert (got["3"].predicted_category, got["3"].ensembled) == ("x", False)


@pytest.fixture(scope="module")
def labelled(spark):
    words = {"bill": "invoice payment refund", "tech": "crash error timeout"}
    rows = [(str(i), "s", words[c] + f" case {i % 7}", c, "low" if i % 3 else None, "p" + str(i % 2), T0 + timedelta(hours=i))
            for i in range(120) for c in [["bill", "tech"][i % 2]]]
    return spark.createDataFrame(rows, "ticket_id string, subject string, description string, category string, "
                                       "priority string, product string, created_at timestamp")


def test_classifier(spark, labelled):
    inputs = learning.classifier_inputs(labelled)
    feats = learning.fit_features(inputs)
    train = feats.transform(inputs).persist()
    models = {t: learning.fit_task(train, t, trees=5, depth=3) for t in ("category", "priority")}
    out = learning.predict(models, train)
    assert out.filter("pred_category = label_category").count() == 120
    row = out.first()
    assert set(row.prob_category) == {"bill", "tech"} and row.confidence == max(row.prob_category.values())
    assert {r.label_priority for r in out.select("label_priority").distinct().collect()} == {"low", "UNKNOWN"}
    path = shared_dir(spark, "test-model")
    models["category"].write().overwrite().save(path)
    loaded = {"category": PipelineModel.load(path)}
    assert learning.predict(loaded, train).filter("pred_category = label_category").count() == 120
    best = learning.feature_importance(models["category"], spark, 5).collect()
    assert best[0].feature.startswith("emb_") or best[0].feature == "product"
    codes = learning.category_codes(labelled)
    assert {r.product_code for r in learning.encoded_categories(labelled, codes).collect()} == {0, 1}
    new = learning.encoded_categories(labelled.withColumn("product", F.lit("new")), codes)
    assert {(r.product_code, r.region_code) for r in new.collect()} == {(-1, 0)}
    model, params, score = learning.search_task(train, train, "category", {"trees": [2], "depth": [1, 3]})
    assert score > 0.9 and params["trees"] == 2


@pytest.mark.parametrize("products", [40, 5000])
def test_fits_with_many_categories(spark, products):
    rows = spark.range(6000).select(
        F.col("id").cast("string").alias("ticket_id"), F.lit("s").alias("subject"), F.lit("text").alias("description"),
        F.concat(F.lit("p"), F.col("id") % products).alias("product"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("category"),
        (1.0 + F.col("id") % 5).alias("resolution_time_hours"), F.lit(T0).alias("created_at"))
    inputs = learning.classifier_inputs(rows)
    train = learning.fit_features(inputs).transform(inputs)
    assert learning.predict({"category": learning.fit_task(train, "category", trees=2, depth=2)}, train).count() == 6000
    assert learning.predict_hours(learning.fit_hours(rows, trees=2, depth=2), rows).count() == 6000


def test_hours(scored):
    model = learning.fit_hours(scored, trees=5)
    out = learning.predict_hours(model, scored)
    assert out.count() == 500
    assert out.filter("low_hours < 0.5 or abs(high_hours - 2 * predicted_hours) > 1e-9").count() == 0
    q = learning.hours_quality(out).first()
    assert q.n == 500 and q.mae_hours > 0 and q.r2 <= 1


ANSWERS = [
    ('```json\n{"subcategory": "corruption", "priority": "HIGH", "sentiment": "angry"}\n```', ("Corruption", "high", "angry", "success")),
    ('Sure: {"subcategory": "Billing", "priority": "low"} ok', (None, "low", None, "success")),
    ('{"subcategory": "Sync Error"}', ("Sync Error", None, None, "success")),
    ('{"subcategory": "Nope", "priority": "urgent", "sentiment": 3}', (None, None, None, "parse_fail")),
    ('{"subcategory": ', (None, None, None, "parse_fail")),
    ("['subcategory']", (None, None, None, "parse_fail")),
    ("", (None, None, None, "parse_fail")),
    (None, (None, None, None, "api_fail")),
    ('```{"priority": "medium"}```', (None, "medium", None, "success")),
]


@pytest.mark.parametrize("raw, want", ANSWERS)
def test_parse_answers(spark, raw, want):
    df = spark.createDataFrame([("1", "Data Issue", raw)], "ticket_id string, category string, raw string")
    r = relabel.parse_answers(df).first()
    assert (r.new_subcategory, r.new_priority, r.new_sentiment, r.status) == want


def test_relabel_resumes_and_applies(spark, make):
    tickets = make([(str(i), "Data Issue", "Old", "low", "neutral", None) for i in range(6)],
                   "ticket_id string, category string, subcategory string, priority string, "
                   "customer_sentiment string, subject string")
    done = make([("0",), ("1",)], "ticket_id string")

    def labeler(asked):
        def run(batches):
            for b in batches:
                b["raw"] = [json.dumps({"subcategory": "Validation", "priority": "low"}) for _ in b.ticket_id]
                yield b
        return asked.mapInPandas(run, "ticket_id string, category string, prompt string, raw string")

    out = relabel.label_tickets(tickets, done, labeler)
    assert {r.status: r.n for r in relabel.status_counts(out).collect()} == {"success": 4}
    fixed = relabel.apply_corrections(tickets, out)
    assert fixed.filter("subcategory = 'Validation'").count() == 4 and fixed.columns == tickets.columns
    assert {r.field: r.changed for r in relabel.change_counts(tickets, out).collect()} == {
        "subcategory": 4, "priority": 0, "sentiment": 0}
    sample = lambda: [r.ticket_id for r in relabel.spot_check(tickets, out, 3).orderBy("ticket_id").collect()]
    assert len(sample()) == 3 and sample() == sample()
    assert [r.ticket_id for r in relabel.first_tickets(tickets, 2).collect()] == ["0", "1"]


def test_prompt(make):
    df = make([("1", "Data Issue", "sub", "x" * 400, True, "why", [f"t{i}" for i in range(12)])],
              "ticket_id string, category string, subject string, resolution string, escalated boolean, "
              "escalation_reason string, tags array<string>")
    p = relabel.with_prompt(df).first().prompt
    assert "Subject: sub\nDescription: N/A\nCategory: Data Issue\nProduct: N/A" in p
    assert "Resolution: " + "x" * 400 + "\nEscalated: True\nEscalation reason: why\nTags: t0, t1" in p
    short = relabel.with_prompt(df, text_chars=relabel.SHORT_TEXTS, n_tags=relabel.SHORT_TAGS).first().prompt
    assert "Resolution: " + "x" * 300 + "\nEscalated" in short and "t9" in short and "t10" not in short
    assert "t11" in p and "Corruption, Data Loss, Import/Export" in p and "Error logs" not in p


@pytest.fixture(scope="module")
def stream_dir(spark):
    """Tickets in time order over four files, so that several micro-batches run."""
    base = shared_dir(spark, "test-stream")
    for part in range(4):
        rows = [(str(i), T0 + timedelta(minutes=10 * i), f"m{i % 2}", 0.5 + (i % 7) / 20, i % 5 == 0, float(i % 13))
                for i in range(part * 100, part * 100 + 100)]
        rows += rows[:5]
        spark.createDataFrame(rows, "ticket_id string, timestamp timestamp, model_name string, confidence double, "
                                    "was_corrected boolean, x double").coalesce(1).write.mode("append").parquet(base)
    return base


def test_windows_over_batches_equal_batch(spark, stream_dir):
    stream = jobs.open_stream(spark, stream_dir, 1)
    hours = jobs.run_sums(stream, "t-hours", ["hour", "model_name"], lambda r: jobs.hourly(r, ["model_name"]))
    for w, (length, slide) in jobs.WINDOWS.items():
        got = jobs.windowed(hours, w, ["model_name"])
        want = spark.read.parquet(stream_dir).groupBy(
            F.window("timestamp", length, slide).start.alias("window_start"), "model_name").agg(
            F.count("*").alias("n"), F.count_if("was_corrected").alias("corrected"))
        key = lambda d: sorted((r.window_start, r.model_name, r.n, r.corrected) for r in d.collect())
        assert key(got) == key(want)


def test_late_rows_are_counted(spark):
    """The newest file comes first, the oldest last."""
    base = shared_dir(spark, "test-late")
    for part in (3, 2, 0):
        rows = [(str(100 * part + i), T0 + timedelta(days=30 * part, minutes=i), "m", 0.5, False) for i in range(50)]
        spark.createDataFrame(rows, "ticket_id string, timestamp timestamp, model_name string, confidence double, "
                                    "was_corrected boolean").coalesce(1).write.mode("append").parquet(base)
    hours = jobs.run_sums(jobs.open_stream(spark, base, 1), "t-late", ["hour", "model_name"], lambda r: jobs.hourly(r, ["model_name"]))
    assert hours.agg(F.sum("n")).first()[0] == 150
    twice = jobs.open_stream(spark, base, 1)
    assert jobs.run_dedup(twice, "t-late-dedup", time="timestamp").count() == 150


def test_dedup_over_batches(spark, stream_dir):
    again = shared_dir(spark, "test-again")
    spark.read.parquet(stream_dir).union(spark.read.parquet(stream_dir)).repartition(5).write.parquet(again)
    got = jobs.run_dedup(jobs.open_stream(spark, again, 1), "t-dedup", time="timestamp").select("ticket_id")
    assert got.count() == 400 == got.distinct().count()


def test_dedup_of_missing_ids_and_other_times(spark):
    base = shared_dir(spark, "test-redelivered")
    schema = "ticket_id string, created_at timestamp"
    for day in range(3):
        rows = [("a", T0 + timedelta(days=9 * day)), (None, T0), (None, T0), (f"d{day}", None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base)
    got = sorted(str(r.ticket_id) for r in jobs.run_dedup(jobs.open_stream(spark, base, 1), "t-redelivered").collect())
    assert got == sorted(["a", "d0", "d1", "d2", *["None"] * 6])
    near = jobs.run_dedup(jobs.open_stream(spark, base, 1), "t-delay", delay="2 days").filter("ticket_id = 'a'")
    assert 1 <= near.count() <= 3  # remembered for two days at least, not for good


def test_late_rows_are_recounted(spark):
    base = shared_dir(spark, "test-closed")
    schema = "ticket_id string, timestamp timestamp, model_name string, confidence double, was_corrected boolean"
    for first in (0, 40, 5, 90):  # hours; the third file is late
        rows = [(f"{first}-{i}", T0 + timedelta(hours=first + i), "m", 0.5, i == 0) for i in range(10)] + [(f"{first}-x", None, "m", 0.5, False)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(base)
    log = spark.read.parquet(base)
    closed = jobs.run_append(jobs.closed_hours(jobs.open_stream(spark, base, 1), ["model_name"], "2 hours"), "t-closed")
    whole = {r.hour: r.n for r in jobs.hourly(log.filter("timestamp is not null"), ["model_name"]).collect()}
    had = {r.hour: r.n for r in closed.collect()}
    assert had and had != {h: whole[h] for h in had}
    out = {r.hour: r for r in jobs.recounted(closed, log, ["model_name"]).collect()}
    assert {h: r.n for h, r in out.items()} == {h: n for h, n in whole.items() if h <= max(had)}
    assert sum(r.late for r in out.values()) > 0 and all(r.n - r.late == had.get(h, 0) for h, r in out.items())


def test_last_n_over_batches(spark, stream_dir):
    newest = [F.unix_micros("timestamp"), F.col("ticket_id")]
    rows = sorted(spark.read.parquet(stream_dir).collect(), key=lambda r: (r.timestamp, r.ticket_id), reverse=True)
    want = [r.ticket_id for m in ("m0", "m1") for r in [x for x in rows if x.model_name == m][:30]]
    open_ = lambda path: jobs.open_stream(spark, path, 1).select("model_name", "ticket_id", "timestamp")
    got = jobs.run_last_n(open_(stream_dir), "t-last", ["model_name"], newest, 30).collect()
    assert sorted(r.ticket_id for r in got) == sorted(want)

    # two files, a restart from the checkpoint, two more files
    some, base = shared_dir(spark, "test-some"), shared_dir(spark, "t-restart")
    data = spark.read.parquet(stream_dir)
    for part in ((0, 2), (1, 3)):
        for p in part:
            near = F.col("ticket_id").cast("int").between(100 * p, 100 * p + 99)
            data.filter(near).coalesce(1).write.mode("append").parquet(some)
        jobs.last_n_to(open_(some), base, ["model_name"], newest, 30)
    again = jobs.read_last_n(spark, base, open_(some).schema, ["model_name"], newest, 30).collect()
    assert sorted(r.ticket_id for r in again) == sorted(want)


def test_binned_stream_and_cycles(spark, stream_dir):
    stream = jobs.open_stream(spark, stream_dir, 2)
    edges = spark.createDataFrame([("x", [0.0, 4.0, 8.0, 12.0])], "feature string, edges array<double>")
    got = jobs.run_sums(stream, "t-bins", ["window_start", "feature", "bin"],
                        lambda r: jobs.bin_counts(r, edges, ["x"], time="timestamp"))
    assert got.agg(F.sum("n")).first()[0] == 420
    assert {r.bin for r in got.collect()} == {1, 2, 3}
    narrow = spark.createDataFrame([("x", [2.0, 4.0, 8.0])], "feature string, edges array<double>")
    rows = jobs.bin_counts(spark.read.parquet(stream_dir), narrow, ["x"], time="timestamp").groupBy("bin").agg(F.sum("n").alias("n"))
    sizes = {r.bin: r.n for r in rows.collect()}
    assert set(sizes) == {0, 1, 2, 3} and sum(sizes.values()) == 420
    cycles = jobs.run_cycles(stream, "t-cycles", lambda b: b.agg(F.count("*").alias("n")))
    assert sorted(r.n for r in cycles.collect()) == [210, 210]


def test_shadow_scoring_on_a_stream(spark, stream_dir):
    stream = jobs.open_stream(spark, stream_dir).withColumnRenamed("timestamp", "created_at")
    say = lambda c, p: lambda df: df.withColumns({"predicted_category": F.lit(c), "confidence": F.lit(p)})
    log = jobs.scored(stream, say("A", .9), "m", "1", F.create_map(F.lit("x"), F.col("x").cast("string")), say("B", .8))
    row = jobs.run_append(log, "t-score").first()
    assert (row.predicted_category, row.confidence, row.shadow_category, row.agree) == ("A", .9, "B", False)


def test_forest_rows_are_not_dealt_by_class(spark, make):
    """One class or many: the rows stay in the parts they came in, with their class's weight."""
    from unittest import mock

    rows = [(str(i), "a" if i % 10 else "b", float(i % 7)) for i in range(400)]
    df = make(rows, "ticket_id string, label_priority string, x double").repartition(4)
    train = learning.kept_aside(learning.VectorAssembler(inputCols=["x"], outputCol="features").transform(df))
    given = []
    fit = learning.RandomForestClassifier.fit
    with mock.patch.object(learning.RandomForestClassifier, "fit", lambda self, d: given.append(d) or fit(self, d)):
        learning.fit_task(train, "priority", trees=2, depth=2)
    sizes = [r["count"] for r in given[0].groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 150
    weights = {r[0]: r[1] for r in given[0].select("label_priority", "weight").distinct().collect()}
    assert weights == {"a": 400 / (2 * 360), "b": 400 / (2 * 40)}


def test_counted_features_equal_those_of_the_text(spark, make):
    """Encoded from kept counts, rows have the same features and nothing wide beside them."""
    df = make([("1", "disk full", "the disk is full"), ("2", "login", "no login since today"), ("3", None, None)],
              "ticket_id string, subject string, description string")
    inputs = learning.classifier_inputs(df)
    plain = {r.ticket_id: r.features for r in learning.fit_features(inputs).transform(inputs).collect()}
    counted = learning.term_counts(inputs)
    model = learning.fit_counted(counted)
    out = learning.encode_counted(model, counted)
    assert {r.ticket_id: r.features for r in out.collect()} == plain
    assert {r.ticket_id: r.features for r in model.transform(inputs).collect()} == plain
    assert "_text" not in counted.columns and set(out.columns) == {"ticket_id", "features", *[f"label_{t}" for t in learning.CLASSIFIER_TASKS]}


def test_boosted_trees_are_fitted_to_even_parts(spark, scored, monkeypatch):
    """A file's single row group doesn't make one task do all passes."""
    given = []
    monkeypatch.setattr(learning, "dealt", lambda df: given.append(scale.dealt(df, 50)) or given[-1])
    learning.fit_hours(scored.coalesce(1), trees=1, depth=2)
    assert given[0].rdd.getNumPartitions() >= 8
    assert not {"ticket_id", "created_at"} & set(given[0].columns)


def test_large_chunk_is_written_by_several_tasks(spark, make, tmp_path, monkeypatch):
    monkeypatch.setattr(relabel, "PROMPTS_PER_PART", 20)
    rows = [(str(i), "Other", f"text {i}") for i in range(300)]
    tickets = make(rows, "ticket_id string, category string, description string")
    assert relabel.plan_labelling(tickets, str(tmp_path), 150) == 2
    asked = spark.read.parquet(f"{tmp_path}/asked")
    assert sorted(r.ticket_id for r in asked.select("ticket_id").collect()) == sorted(r[0] for r in rows)
    for chunk in ("0", "1"):
        assert len(list((tmp_path / "asked" / f"chunk={chunk}").glob("*.parquet"))) > 1


def test_events_of_large_batches_come_in_several_files(spark, tmp_path):
    from caselight.plans import bindings
    rows = spark.range(200).selectExpr("id as event_id", "timestamp'2024-01-02 00:00:00' + make_interval(0,0,0,0,id) as ts")
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    folder, each = bindings.event_files(spark, str(tmp_path), 4, 2, 40, file_rows=40)
    assert each == 3
    assert spark.read.parquet(folder).count() == 400 + sum(1 for i in range(200) if i % 50 and i < 24 * 6)
    assert bindings.event_files(spark, str(tmp_path))[1] == 1
