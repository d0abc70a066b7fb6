"""Registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caselight.functions import text as tx
from caselight.operators import (
    analytics, anomaly, bm25, drift, evaluation, features, fusion, graph, learning, lifecycle,
    quality, relabel, scoring, sketches, split, vector_index, vectors,
)
from caselight.operators.scale import dealt, top_n_per_group
from caselight.plans import bindings as b, batch as jobs_batch
from caselight.schemas import DRIFT_FEATURES
from caselight.session import kept_aside, shared_dir
from caselight.sources import tickets as store, versions
from caselight.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that results compare across engines."""
    return df.select(*[
        r6(f.name).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields])


def newest(df: DataFrame, col: str = "created_at") -> Column:
    return df.agg(F.max(col)).scalar()


def week_windows(df: DataFrame, col: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """Rows before and within the last seven days of the data."""
    cut = newest(df, col) - F.expr("INTERVAL 7 DAYS")
    return df.filter(F.col(col) < cut), df.filter(F.col(col) >= cut)


# ---- data quality ---------------------------------------------------------------

@register
def dq_report(spark, d):
    return quality.dataset_checks(b.tickets_d(spark, d)).withColumnRenamed("check", "check_name")


@register
def dq_summary(spark, d):
    return quality.check_summary(quality.dataset_checks(b.tickets_e(spark, d)))


@register
def quarantine(spark, d):
    return quality.input_contract(b.tickets_d(spark, d)).select(
        "ticket_id", "ticket_text_length", "affected_users", "response_count", "business_impact",
        (F.size("reasons") == 0).alias("valid"), F.array_join("reasons", "; ").alias("reasons"))


@register
def ingest_summary(spark, d):
    return quality.ingest_summary(split.temporal_split(b.tickets_o(spark, d)))


# ---- splits ---------------------------------------------------------------------

@register
def temporal_split(spark, d):
    return split.temporal_split(b.tickets_o(spark, d)).select("ticket_id", "data_split")


@register
def split_report(spark, d):
    return split.split_report(split.temporal_split(b.tickets_e(spark, d))).select(
        "data_split", "n", F.unix_micros("first_at").alias("first_us"),
        F.unix_micros("last_at").alias("last_us"))


# ---- features -------------------------------------------------------------------

@register
def ticket_features(spark, d):
    return rounded(features.ticket_features(b.tickets_d(spark, d)))


@register
def event_features(spark, d):
    return rounded(features.ticket_features(b.tickets_e(spark, d)))


@register
def features_trailing(spark, d):
    return features.trailing_features(b.tickets_e(spark, d))


@register
def scaled_features(spark, d):
    return rounded(learning.scaled_inputs(b.tickets_e(spark, d)))


@register
def encoded_categories(spark, d):
    """Codes of the older rows, some values left out, applied to the newest week."""
    older, newer = week_windows(b.tickets_e(spark, d))
    codes = learning.category_codes(older.filter("product <> 'P2' and channel <> 'email'"))
    return learning.encoded_categories(newer, codes)


@register
def ordered_encoding(spark, d):
    """Categories as the share of critical tickets before each ticket."""
    critical = (F.col("priority") == "critical").cast("int")
    return rounded(learning.ordered_encoding(b.tickets_e(spark, d), critical, ["product", "channel", "customer_tier"], weight=0.7))


# ---- text -----------------------------------------------------------------------

@register
def clean_ticket(spark, d):
    return tx.clean_tickets(b.tickets_d(spark, d)).select("ticket_id", "cleaned_text")


@register
def clean_page_ticket(spark, d):
    return tx.clean_tickets(b.tickets_p(spark, d)).select("ticket_id", "cleaned_text")


@register
def clean_resolution(spark, d):
    return tx.clean_resolution(b.tickets_d(spark, d)).select("ticket_id", "cleaned_resolution")


@register
def clean_page_resolution(spark, d):
    return tx.clean_resolution(b.tickets_p(spark, d)).select("ticket_id", "cleaned_resolution")


@register
def error_codes(spark, d):
    both = F.concat_ws(" ", "description", "error_logs")
    return b.tickets_d(spark, d).select(
        "ticket_id", F.size(tx.error_codes(both)).alias("n_codes"),
        F.array_join(tx.distinct_error_codes(both), ",").alias("codes"))


@register
def composed_texts(spark, d):
    t = tx.index_text(b.tickets_d(spark, d))
    return t.select(
        "ticket_id", F.md5("index_text").alias("index_md5"),
        F.md5(tx.embedding_text()).alias("embedding_md5"),
        F.md5(tx.classifier_text()).alias("classifier_md5"),
        F.length("index_text").alias("index_length"))


# ---- graph ----------------------------------------------------------------------

@register
def product_issues(spark, d):
    return rounded(graph.product_issues(b.tickets_d(spark, d)))


@register
def issue_solutions(spark, d):
    return rounded(graph.issue_solutions(b.tickets_d(spark, d)))


@register
def error_code_map(spark, d):
    return graph.error_code_mapping(b.tickets_d(spark, d))


@register
def graph_context(spark, d):
    return rounded(fusion.query_context(b.queries_b(spark, d), b.tickets_d(spark, d)))


# ---- keyword search -------------------------------------------------------------

def _index(spark, d) -> bm25.Bm25Index:
    return bm25.build_index(fusion.resolved(b.tickets_d(spark, d)))


def _keyword_queries(spark, d) -> DataFrame:
    return b.queries_b(spark, d).select(
        "query_id", F.concat_ws(" ", "subject", "description").alias("text"),
        F.col("predicted_category").alias("category"))


@register
def bm25_terms(spark, d):
    return rounded(_index(spark, d).terms(spark).select("term", "df", "idf"))


@register
def bm25_search(spark, d):
    return rounded(bm25.search(_index(spark, d), _keyword_queries(spark, d), 10))


@register
def bm25_search_all(spark, d):
    return rounded(bm25.search(_index(spark, d), _keyword_queries(spark, d), 10, use_category=False))


# ---- vector search --------------------------------------------------------------

def _category_queries(spark, d) -> DataFrame:
    return vectors.centroids(b.vectors_v(spark, d), "category").withColumns({
        "category": F.col("query_id"),
        "product": F.concat(F.lit("P"), (F.substring("query_id", 2, 9).cast("int") % 5).cast("string"))})


@register
def vector_topk(spark, d):
    return rounded(vectors.cosine_top_k(b.vectors_v(spark, d), _category_queries(spark, d), 10))


@register
def vector_topk_filtered(spark, d):
    return rounded(vectors.cosine_top_k(
        b.vectors_v(spark, d), _category_queries(spark, d), 10, ("category", "product")))


@register
def vector_topk_lsh(spark, d):
    """The index with the certain bound: nothing that a cell may hold is left out."""
    path = vector_index.build(b.vectors_v(spark, d))
    return rounded(vector_index.search(spark, path, _category_queries(spark, d), 10, bound=None))


@register
def vector_lsh_quality(spark, d):
    """Recall and compared vectors of the index beside the exact search."""
    v = b.vectors_v(spark, d)
    return rounded(vector_index.quality(v, vector_index.build(v), _category_queries(spark, d), 10))


@register
def vector_index_checks(spark, d):
    """What the index promises: nine of ten neighbours, at most a fifth of the vectors compared."""
    return vector_lsh_quality(spark, d).select(
        "query_id", (F.col("recall") >= 0.9).alias("found"), (F.col("candidate_share") <= 0.2).alias("few"),
        (F.col("candidates") >= 10).alias("enough"))


@register
def vector_count(spark, d):
    return b.vectors_v(spark, d).agg(F.count("*").alias("n"))


@register
def encode_texts(spark, d):
    _, table = fusion.build_vectors(b.tickets_d(spark, d))
    return table.select(
        "ticket_id", F.size("vector").alias("dimensions"),
        r6(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("norm"))


# ---- fusion ---------------------------------------------------------------------

def _ranked_lists(t: DataFrame) -> DataFrame:
    """Two lists of 20 per product: longest resolution and highest value."""
    def one(no: int, col: str) -> DataFrame:
        rows = t.select(F.col("product").alias("query_id"), "ticket_id", col)
        return top_n_per_group(rows, ["query_id"], [F.desc(col), F.asc("ticket_id")], 20).select(
            "query_id", "ticket_id", "rank", F.lit(no).alias("source_no"))

    return one(0, "resolution_time_hours").unionByName(one(1, "account_monthly_value"))


def _product_predictions(t: DataFrame) -> DataFrame:
    n = F.substring("product", 2, 9).cast("int")
    return t.select("product").distinct().select(
        F.col("product").alias("query_id"), b.pick(b.EVENT_TYPES, n).alias("predicted_category"),
        F.concat(F.lit("S"), (n % 3).cast("string")).alias("predicted_subcategory"),
        b.pick(b.PRIORITIES, n).alias("predicted_priority"),
        b.pick(b.MOODS, n).alias("predicted_sentiment"))


@register
def rrf_fusion(spark, d):
    return rounded(fusion.reciprocal_rank_fusion(_ranked_lists(b.tickets_e(spark, d))))


@register
def rerank(spark, d):
    t = b.tickets_e(spark, d)
    out = fusion.rerank(
        fusion.reciprocal_rank_fusion(_ranked_lists(t)), t, _product_predictions(t), 10)
    return rounded(out.select("query_id", "rank", "ticket_id", "rrf_score", "final_score"))


@register
def hybrid_retrieve(spark, d):
    t = b.tickets_d(spark, d)
    model, table = fusion.build_vectors(t)
    out = fusion.hybrid_retrieve(b.queries_b(spark, d), t, _index(spark, d), model, table, 5)
    return out.select("query_id", "rank", "ticket_id", "rrf_score", "final_score", "category",
                      "product", "resolution_code")


@register
def hybrid_keyword_only(spark, d):
    """The vector branch left out: results come from the keyword list alone."""
    t = b.tickets_d(spark, d)
    out = fusion.hybrid_retrieve(b.queries_b(spark, d), t, _index(spark, d), None, None, 5)
    return rounded(out.select("query_id", "rank", "ticket_id", "rrf_score", "final_score"))


@register
def hybrid_answer(spark, d):
    """Whole answers from stored edges: results, graph context, error codes and labels."""
    t, base = b.tickets_d(spark, d), shared_dir(spark, "answer-edges")
    store.replace_graph_tables(t, base)
    edges = store.read_graph_tables(spark, base)
    out = fusion.hybrid_answers(b.queries_b(spark, d), t, _index(spark, d), None, None, edges, 5)
    named = F.transform("graph_context", lambda c: F.concat_ws(":", c["kind"], c["code"]))
    return out.select(
        "query_id", F.array_join("results.ticket_id", ",").alias("results"), F.array_join(named, ",").alias("context"),
        F.array_join("metadata.error_codes", ",").alias("error_codes"), "metadata.predicted_category", "metadata.predicted_subcategory",
        "metadata.predicted_priority", "metadata.predicted_sentiment", "metadata.product")


# ---- quality of results ---------------------------------------------------------

def _pairs(spark, d) -> DataFrame:
    i = F.col("ticket_id").cast("long")
    return b.tickets_d(spark, d).withColumns({
        "query_id": F.concat(F.lit("q"), (i % 50).cast("string")),
        "query_category": b.pick(b.LANGS, i),
        "query_product": F.concat(F.lit("src"), ((i * 3) % 20).cast("string"))})


@register
def quality_score(spark, d):
    return rounded(scoring.with_quality(_pairs(spark, d)).select(
        "ticket_id", *scoring.WEIGHTS, "quality_score"))


@register
def quality_ranking(spark, d):
    return rounded(scoring.rank_by_quality(_pairs(spark, d), 5).select(
        "query_id", "rank", "ticket_id", "quality_score"))


@register
def quality_metrics(spark, d):
    return rounded(scoring.quality_metrics(scoring.with_quality(_pairs(spark, d))))


@register
def quality_by_category(spark, d):
    return rounded(scoring.quality_metrics(scoring.with_quality(_pairs(spark, d)), ["query_category"]))


# ---- anomalies ------------------------------------------------------------------

@register
def volume_statistics(spark, d):
    return rounded(anomaly.volume_statistics(b.tickets_e(spark, d), ["product", "category"]))


@register
def volume_anomalies(spark, d):
    return rounded(anomaly.volume_anomalies(b.tickets_a(spark, d)))


@register
def sentiment_statistics(spark, d):
    return rounded(anomaly.sentiment_statistics(b.tickets_e(spark, d)))


@register
def sentiment_drift(spark, d):
    return rounded(anomaly.sentiment_drift(b.tickets_a(spark, d), z=1.0))


@register
def issue_shares(spark, d):
    return rounded(anomaly.issue_shares(b.tickets_o(spark, d)))


@register
def new_issue_types(spark, d):
    return rounded(anomaly.new_issue_types(b.tickets_a(spark, d)))


@register
def all_anomalies(spark, d):
    found = anomaly.all_anomalies(b.tickets_a(spark, d), mood_z=1.0)
    return rounded(found.select(
        "anomaly_type", F.try_element_at("dimensions", F.lit("product")).alias("product"),
        F.try_element_at("dimensions", F.lit("category")).alias("category"),
        "severity", "metric_value", "threshold"))


# ---- drift ----------------------------------------------------------------------

@register
def psi_features(spark, d):
    return rounded(drift.psi_table(*week_windows(b.tickets_e(spark, d)),
                                   [*DRIFT_FEATURES, "resolution_time_hours"]))


@register
def sketch_bounds(spark, d):
    """Daily sketches written, read and merged over the older tickets: quantiles and distinct
    counts within their bounds, and edges from them that give about the exact index."""
    feats = [*DRIFT_FEATURES, "resolution_time_hours"]
    old, new = week_windows(b.tickets_e(spark, d))
    path = shared_dir(spark, "sketches")
    sketches.daily_sketches(old, feats).write.parquet(path)
    reference = kept_aside(sketches.merged(spark.read.parquet(path)))
    errors = sketches.sketch_errors(old, reference, feats, [i / 20 for i in range(21)])
    exact = drift.psi_table(old, new, feats).select("feature", F.col("psi").alias("exact_psi"))
    frozen = drift.psi_table(old, new, feats, edges=sketches.sketched_edges(reference))
    return errors.join(frozen, "feature").join(exact, "feature").select(
        "feature", (F.col("rank_error") <= sketches.RANK_ERROR).alias("quantiles_hold"),
        (F.col("distinct_error") <= sketches.DISTINCT_ERROR).alias("distinct_holds"),
        (F.abs(F.col("psi") - F.col("exact_psi")) <= 0.05).alias("index_holds"))


def signal_columns(df: DataFrame) -> DataFrame:
    return rounded(df.select(
        "signal_type", "severity", "metric_name", "current_value", "reference_value", "threshold"))


@register
def feature_drift(spark, d):
    return signal_columns(drift.feature_drift(*week_windows(b.tickets_e(spark, d))))


@register
def new_categories(spark, d):
    t = b.tickets_e(spark, d).withColumn("created_day", F.to_date("created_at").cast("string"))
    return drift.new_values(
        *week_windows(t), ["product", "customer_tier", "channel", "priority", "created_day"])


@register
def value_shares(spark, d):
    return rounded(drift.value_shares(*week_windows(b.tickets_e(spark, d))))


@register
def prediction_shift(spark, d):
    old, new = week_windows(b.pred_log(spark, d), "timestamp")
    return rounded(drift.prediction_shift(drift.distribution(old, "actual_category"), new))


@register
def prediction_drift(spark, d):
    """Against the orders' status distribution: everything moved."""
    ref = drift.distribution(b.tickets_o(spark, d), "category")
    return signal_columns(drift.prediction_drift(ref, b.pred_log(spark, d)))


@register
def confidence_drift(spark, d):
    return signal_columns(drift.confidence_drift(0.85, b.pred_log(spark, d)))


@register
def label_drift(spark, d):
    log = b.pred_log(spark, d)
    return signal_columns(drift.label_drift(log, newest(log, "timestamp")))


@register
def label_confusions(spark, d):
    log = b.pred_log(spark, d)
    return drift.confusions(drift.labelled(log, newest(log, "timestamp")))


def _all_signals(spark, d) -> DataFrame:
    t, log = b.tickets_e(spark, d), b.pred_log(spark, d)
    old, new = week_windows(t)
    old_log, new_log = week_windows(log, "timestamp")
    return drift.all_drift(old, new, drift.distribution(old_log, "predicted_category"), new_log,
                           0.85, log, newest(log, "timestamp"))


@register
def all_drift(spark, d):
    return signal_columns(_all_signals(spark, d))


# ---- lifecycle ------------------------------------------------------------------

def _corrected(spark, d) -> Column:
    return b.pred_log(spark, d).agg(F.count_if("was_corrected")).scalar()


@register
def retrain_decision(spark, d):
    t = b.tickets_e(spark, d)
    as_of = newest(t)
    return lifecycle.retrain_decision(
        _all_signals(spark, d), as_of, as_of - F.expr("INTERVAL 2 DAYS"), _corrected(spark, d))


@register
def retrain_scheduled(spark, d):
    t = b.tickets_e(spark, d)
    first = t.agg(F.min("created_at")).scalar()
    return lifecycle.retrain_decision(_all_signals(spark, d), newest(t), first, _corrected(spark, d))


@register
def train_augment(spark, d):
    t = b.tickets_e(spark, d)
    old, _ = week_windows(t)
    cut = newest(t) - F.expr("INTERVAL 10 DAYS")
    return lifecycle.training_set(
        old, b.corrections(spark, d), t.filter(F.col("created_at") >= cut)).select("ticket_id", "category")


@register
def train_recent(spark, d):
    t = b.tickets_e(spark, d)
    policy = lifecycle.RetrainingPolicy(recent_days=14)
    return lifecycle.training_set(
        t, b.corrections(spark, d), t, "recent_only", newest(t), policy).select("ticket_id", "category")


@register
def model_gate(spark, d):
    log = b.pred_log(spark, d).select("ticket_id", "actual_category", F.col("predicted_category").alias("old"))
    shadow = b.shadow_log(spark, d).select("ticket_id", F.col("predicted_category").alias("new"))
    return rounded(lifecycle.model_gate(log.join(shadow, "ticket_id"), "actual_category", "old", "new"))


def _shadow(spark, d) -> DataFrame:
    log = b.pred_log(spark, d)
    started = log.agg(F.min("timestamp")).scalar()
    return lifecycle.shadow_report(log, b.shadow_log(spark, d), started, newest(log, "timestamp"))


@register
def shadow_report(spark, d):
    return rounded(_shadow(spark, d))


@register
def correction_rate(spark, d):
    fb = b.feedback(spark, d)
    return rounded(lifecycle.correction_rate(fb, newest(fb, "feedback_at")))


@register
def monitoring_report(spark, d):
    log = b.pred_log(spark, d)
    as_of = newest(log, "timestamp")
    signals = _all_signals(spark, d)
    decision = lifecycle.retrain_decision(
        signals, as_of, as_of - F.expr("INTERVAL 2 DAYS"), F.lit(0))
    last = lifecycle.recent_predictions(log, 1000)
    return rounded(lifecycle.monitoring_report(signals, decision, _shadow(spark, d), last))


@register
def metric_snapshots(spark, d):
    t = b.tickets_e(spark, d)
    facts = analytics.satisfaction_summary(t)
    snap = lifecycle.metric_snapshot(
        facts, ["n_tickets", "n_satisfied", "satisfaction_rate"], newest(t))
    return rounded(snap.select(
        "metric_name", "metric_value", F.unix_micros("snapshot_at").alias("snapshot_us")))


# ---- analytics ------------------------------------------------------------------

@register
def agent_performance(spark, d):
    return rounded(analytics.agent_performance(b.tickets_e(spark, d)))


@register
def agent_report(spark, d):
    return rounded(analytics.agent_report(analytics.agent_performance(b.tickets_e(spark, d))))


@register
def resolution_time_stats(spark, d):
    return rounded(analytics.resolution_time_stats(b.tickets_e(spark, d)))


@register
def satisfaction_summary(spark, d):
    return rounded(analytics.satisfaction_summary(b.tickets_e(spark, d)))


@register
def driver_matrix(spark, d):
    return rounded(analytics.driver_matrix(b.tickets_e(spark, d)))


@register
def satisfaction_drivers(spark, d):
    return analytics.satisfaction_drivers(b.tickets_e(spark, d))


def _hours_model(spark, d):
    """A regressor of the older tickets, saved and loaded again."""
    path = shared_dir(spark, "hours-model")
    learning.fit_hours(week_windows(b.tickets_e(spark, d))[0]).write().overwrite().save(path)
    return learning.PipelineModel.load(path)


@register
def resolution_time_predict(spark, d):
    return learning.predict_hours(_hours_model(spark, d), b.tickets_e(spark, d))


@register
def resolution_time_model(spark, d):
    return learning.hours_quality(learning.predict_hours(_hours_model(spark, d), b.tickets_e(spark, d)))


# ---- classification -------------------------------------------------------------

@register
def class_weights(spark, d):
    return rounded(evaluation.class_weights(b.tickets_d(spark, d), "category"))


@register
def per_class_f1(spark, d):
    return rounded(evaluation.per_class_f1(b.pred_log(spark, d), "actual_category", "predicted_category"))


@register
def weighted_f1(spark, d):
    return rounded(evaluation.weighted_f1(b.pred_log(spark, d), "actual_category", "predicted_category"))


@register
def ensemble_route(spark, d):
    def probabilities(log: DataFrame) -> DataFrame:
        other = b.pick(b.EVENT_TYPES, F.length("ticket_id") + F.length("predicted_category"))
        rest = F.when(other != F.col("predicted_category"), other).otherwise("rest")
        return log.select("ticket_id", F.map_from_arrays(
            F.array("predicted_category", rest), F.array(F.col("confidence"), 1 - F.col("confidence"))
        ).alias("probabilities"))

    out = evaluation.route(probabilities(b.pred_log(spark, d)), probabilities(b.shadow_log(spark, d)))
    return rounded(out.drop("probabilities"))


def _split_features(spark, d):
    t = split.temporal_split(b.tickets_d(spark, d))
    counted = learning.term_counts(learning.classifier_inputs(t, ("data_split",)))
    parts = {s: counted.filter(F.col("data_split") == s) for s in ("train", "val", "test")}
    model = learning.fit_counted(parts["train"])
    return model, {s: learning.encode_counted(model, p) for s, p in parts.items()}


@register
def train_classify(spark, d):
    _, parts = _split_features(spark, d)
    models = {t: learning.fit_task(parts["train"], t) for t in learning.CLASSIFIER_TASKS}
    return learning.predict(models, parts["test"]).select(
        "ticket_id", *[f"pred_{t}" for t in models], "confidence")


@register
def model_comparison(spark, d):
    """Weighted F1 on the test split, per task and forest size."""
    _, parts = _split_features(spark, d)
    rows = None
    for name, params in (("small", {"trees": 10, "depth": 4}), ("large", {"trees": 30, "depth": 8})):
        models = {t: learning.fit_task(parts["train"], t, **params) for t in learning.CLASSIFIER_TASKS}
        scored = learning.predict(models, parts["test"])
        for t in models:
            row = evaluation.weighted_f1(scored, f"label_{t}", f"pred_{t}").select(
                F.lit(name).alias("model"), F.lit(t).alias("task"), "weighted_f1")
            rows = row if rows is None else rows.unionByName(row)
    return rows


@register
def feature_importance(spark, d):
    """Importances of all four tasks."""
    _, parts = _split_features(spark, d)
    rows = None
    for t in learning.CLASSIFIER_TASKS:
        own = learning.feature_importance(learning.fit_task(parts["train"], t), spark).withColumn("task", F.lit(t))
        rows = own if rows is None else rows.unionByName(own)
    return rows


@register
def model_search(spark, d):
    _, parts = _split_features(spark, d)
    _, params, score = learning.search_task(
        parts["train"], parts["val"], "category", {"trees": [10, 20], "depth": [4, 8]})
    return spark.range(1).select(
        F.lit(params["trees"]).alias("trees"), F.lit(params["depth"]).alias("depth"),
        F.lit(score).alias("validation_f1"))


# ---- label correction -----------------------------------------------------------

@register
def label_prompts(spark, d):
    t = relabel.with_columns(b.tickets_d(spark, d), [
        *relabel.ALWAYS.values(), "stack_trace", "feedback_text", "escalation_reason"])
    return relabel.with_prompt(t).select(
        "ticket_id", F.md5(relabel.prompt_fields(t)).alias("fields_md5"),
        (F.length("prompt") > F.length("description")).alias("has_text"))


@register
def parse_labels(spark, d):
    return relabel.parse_answers(b.answers(spark, d)).select(
        "ticket_id", "new_subcategory", "new_priority", "new_sentiment", "status")


@register
def label_status(spark, d):
    a = b.answers(spark, d)
    # half of the tickets were handled by an earlier run
    done = a.filter(F.col("category").isin("Data Issue", "Other")).select("ticket_id")
    raw = a.select("ticket_id", "raw")
    return relabel.status_counts(relabel.label_tickets(
        a.drop("raw"), done, lambda asked: asked.join(raw, "ticket_id")))


@register
def label_resumed(spark, d):
    """Labelling in chunks, ended after two, then continued to the end."""
    a, base = b.answers(spark, d), shared_dir(spark, "labelling")
    raw = a.select("ticket_id", "raw")
    labeler = lambda asked: asked.join(raw, "ticket_id")
    size = -(-a.count() // 5)
    relabel.label_in_chunks(a.drop("raw"), base, labeler, size, retries=1, most_chunks=2)
    return relabel.label_in_chunks(a.drop("raw"), base, labeler, size, retries=1)


@register
def apply_corrections(spark, d):
    a = b.answers(spark, d)
    return relabel.apply_corrections(a.drop("raw"), relabel.parse_answers(a))


@register
def label_change_stats(spark, d):
    a = b.answers(spark, d)
    return relabel.change_counts(a, relabel.parse_answers(a))


@register
def spot_check(spark, d):
    a = b.answers(spark, d)
    return relabel.spot_check(a, relabel.parse_answers(a), 200)


# ---- tables and logs ------------------------------------------------------------

@register
def latest_tickets(spark, d):
    return store.latest_tickets(b.tickets_e(spark, d), 500).select("ticket_id", "product", "category")


@register
def label_prediction_log(spark, d):
    labels = b.corrections(spark, d).filter(F.col("corrected").isNotNull()).select(
        "ticket_id", F.col("corrected").alias("true_category"), F.col("corrected_at").alias("labelled_at"))
    return lifecycle.attach_labels(b.pred_log(spark, d), labels).select(
        "ticket_id", "predicted_category", "true_category", "was_corrected")


@register
def feedback_log(spark, d):
    return store.feedback_rows(b.feedback(spark, d)).groupBy(
        "category_corrected", "resolution_accepted").agg(F.count("*").alias("n"))


@register
def event_rollup(spark, d):
    return rounded(store.event_rollup(b.system_events(spark, d)))


@register
def active_models(spark, d):
    """Every version recorded as a candidate, the newest of each model activated, read back."""
    path = shared_dir(spark, "models")
    given = b.model_versions(spark, d)
    versions.record_models(given, path, activate=False)
    versions.record_models(store.active_models(given), path)
    return versions.model_versions(spark, path).filter("is_active").select("model_name", "version")


@register
def ticket_store(spark, d):
    """Write the tickets as JSON, read them with the schema, append, read back."""
    base = shared_dir(spark, "store")
    store.write_json(b.tickets_e(spark, d), f"{base}/json")
    store.append_tickets(store.read_json(spark, f"{base}/json", lines=True), f"{base}/tickets")
    return rounded(store.read_tickets(spark, f"{base}/tickets").groupBy("category", "product").agg(
        F.count("*").alias("n"), F.avg("resolution_time_hours").alias("avg_hours"),
        F.min(F.unix_micros("created_at")).alias("first_us"),
        F.count_if("escalated").alias("escalated")))


@register
def graph_store(spark, d):
    """Replace the edge tables and read the first one back."""
    base = shared_dir(spark, "graph")
    store.replace_graph_tables(b.tickets_d(spark, d).limit(0), base)
    store.replace_graph_tables(b.tickets_d(spark, d), base)
    issues, solutions, mapping = store.read_graph_tables(spark, base)
    return issues.agg(F.count("*").alias("issues"), F.sum("frequency").alias("tickets")).withColumns({
        "solutions": solutions.agg(F.count("*")).scalar(),
        "uses": solutions.agg(F.sum("usage_count")).scalar(),
        "mappings": mapping.agg(F.count("*")).scalar(),
        "occurrences": mapping.agg(F.sum("occurrences")).scalar()})


@register
def ingest_job(spark, d):
    """The whole ingest: check, split, features, store, index, edges; its summary."""
    t = b.tickets_d(spark, d)
    return jobs_batch.ingest(t, shared_dir(spark, "ingest"))


# ---- streaming ------------------------------------------------------------------

def _event_stream(spark, d) -> DataFrame:
    b.use_utc(spark)
    return b.events_as_tickets(jobs.open_stream(spark, f"{d}/events.parquet"))


def _event_batches(spark, d, times: int = 1, shift_days: int = 0) -> DataFrame:
    """The events in several micro-batches, each over the whole time, so most rows are late."""
    files, each = b.event_files(spark, d, times=times, shift_days=shift_days)
    return b.events_as_tickets(jobs.open_stream(spark, files, each))


@register
def stream_windows(spark, d):
    """Hourly sums of a stream in one pass, and the three rolling windows from them."""
    keys = ["model_name"]
    hours = jobs.run_sums(b.log_of(_event_batches(spark, d)), "hours", ["hour", *keys], lambda r: jobs.hourly(r, keys))
    out = None
    for w in jobs.WINDOWS:
        rows = jobs.windowed(hours, w, keys)
        out = rows if out is None else out.unionByName(rows)
    return rounded(out.withColumn("window_start", F.unix_micros("window_start")))


@register
def stream_bins(spark, d):
    """Daily bin counts of two features against edges frozen from the first week."""
    t = b.tickets_e(spark, d)
    feats = ["resolution_time_hours", "account_monthly_value"]
    ref = t.filter(F.col("created_at") < F.lit("2024-01-08").cast("timestamp"))
    edges = drift.quantiles(
        drift._long(ref, feats), ["feature"], F.col("value"), [i / 10 for i in range(11)], "edges", few_groups=True)
    edges = kept_aside(edges.withColumn("edges", F.array_distinct("edges")))
    rows = jobs.run_sums(_event_batches(spark, d), "bins", ["window_start", "feature", "bin"],
                         lambda r: jobs.bin_counts(r, edges, feats))
    return rows.withColumn("window_start", F.unix_micros("window_start"))


@register
def stream_dedup(spark, d):
    """Every event delivered twice, the second time with another date, some in a late file once
    more; each ticket comes out once, and every row without an identifier."""
    stream = _event_batches(spark, d, times=2, shift_days=40)
    unnamed = F.col("ticket_id").cast("long") % 50 == 0
    rows = stream.select(F.when(~unnamed, F.col("ticket_id")).alias("ticket_id"), "created_at", "category", "product")
    return jobs.run_dedup(rows, "dedup").drop("created_at")


@register
def stream_hours(spark, d):
    """Hours closed by a watermark of a day, with the late rows of the later files recounted."""
    log = b.log_of(_event_batches(spark, d))
    closed = jobs.run_append(jobs.closed_hours(log, ["model_name"], "1 day"), "closed-hours")
    out = jobs.recounted(closed, b.pred_log(spark, d), ["model_name"])
    last_day = b.pred_log(spark, d).agg(F.max("timestamp")).scalar() - F.expr("INTERVAL 2 DAYS")
    return rounded(out.filter(F.col("hour") < last_day).select(
        F.unix_micros("hour").alias("hour_us"), "model_name", "n", "confidence_sum", "corrected"))


@register
def stream_last_n(spark, d):
    log = b.log_of(_event_batches(spark, d)).select("model_name", "ticket_id", "timestamp", "confidence")
    last = jobs.run_last_n(log, "last", ["model_name"], [F.unix_micros("timestamp"), F.col("ticket_id")], 1000)
    return rounded(last.select("model_name", "ticket_id", "confidence"))


@register
def stream_score(spark, d):
    """Primary and shadow forests of the older tickets on the stream of newer ones."""
    older, _ = week_windows(b.tickets_e(spark, d))
    counted = learning.term_counts(learning.classifier_inputs(dealt(older)))
    feats = learning.fit_counted(counted)
    train = learning.encode_counted(feats, counted)
    cut = older.agg(F.max("created_at")).first()[0]

    def model(trees: int, depth: int):
        fitted = learning.fit_task(train, "priority", trees=trees, depth=depth)

        best = F.array_max(learning.vector_to_array("_prob_priority"))
        return jobs.model_score(learning.scoring_inputs, [feats, fitted], "pred_priority", best)

    snapshot = F.create_map(F.lit("product"), "product", F.lit("priority"), "priority")
    stream = _event_stream(spark, d).filter(F.col("created_at") > F.lit(cut))
    log = jobs.scored(stream, model(10, 6), "forest", "1", snapshot, model(5, 3))
    return jobs.run_append(log, "score").select(
        "ticket_id", "predicted_category", "confidence", "shadow_category", "agree")


@register
def stream_monitoring(spark, d):
    """A monitoring cycle per micro-batch: confidence signals of the arriving log."""
    log = b.log_of(_event_stream(spark, d))
    return signal_columns(jobs.run_cycles(
        log, "cycles", lambda batch: drift.confidence_drift(0.85, batch)))
