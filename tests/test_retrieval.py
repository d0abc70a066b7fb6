"""Keyword and vector search, fusion, reranking and result quality."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselight.operators import bm25, fusion, scoring, vector_index, vectors

DOCS = [
    ("1", "database timeout error", "ERROR_TIMEOUT_429 on large sync", "increased timeout", ["database", "timeout"], "Tech"),
    ("2", "billing question", "need invoice for Q4", "sent invoice", ["billing"], "Billing"),
    ("3", "auth failure", "users cannot login", "reset tokens", ["auth"], "Tech"),
    ("4", "auth failure", "users cannot login again", "reset tokens", ["auth"], "Tech"),
]
DOC_SCHEMA = ("ticket_id string, subject string, description string, resolution string, "
              "tags array<string>, category string")


def okapi(query, docs):
    toks = [re.findall(r"\w+", " ".join([*d[1:4], *d[4]]).lower()) for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = Counter(t for ts in toks for t in set(ts))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    out = {}
    for d, ts in zip(docs, toks):
        tf = Counter(ts)
        out[d[0]] = sum(
            idf.get(t, 0) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(ts) / avg))
            for t in re.findall(r"\w+", query.lower()))
    return out


@pytest.fixture(scope="module")
def index(spark):
    return bm25.build_index(spark.createDataFrame(DOCS, DOC_SCHEMA), buckets=3)


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id string, text string, category string")


def test_search_scores(spark, index):
    text = "database timeout ERROR_TIMEOUT_429 users users"
    got = bm25.search(index, ask(spark, ("q", text, None))).collect()
    want = {k: v for k, v in okapi(text, DOCS).items() if v > 0}
    assert {r.ticket_id: pytest.approx(r.score) for r in got} == want
    assert min(got, key=lambda r: r["rank"]).ticket_id == "1"


def test_category_filter_and_its_fallback(spark, index):
    q = ask(spark, ("in", "again invoice timeout", "Billing"), ("none", "again invoice timeout", "Unknown"))
    got = {}
    for r in bm25.search(index, q).collect():
        got.setdefault(r.query_id, set()).add(r.ticket_id)
    assert got == {"in": {"2"}, "none": {"1", "2", "4"}}


def test_search_is_the_same_in_blocks(spark, index):
    q = ask(spark, ("a", "auth users login", None), ("b", "timeout invoice", "Tech"))
    rows = lambda **k: sorted((r.query_id, r.ticket_id, round(r.score, 9), r["rank"]) for r in bm25.search(index, q, 2, **k).collect())
    assert rows(query_bytes=150) == rows()       # several blocks


def test_index_opens_without_its_table(spark, index):
    q = ask(spark, ("a", "auth users login again", None))
    rows = lambda ix: [(r.ticket_id, r.score) for r in bm25.search(ix, q).orderBy("rank").collect()]
    want = rows(index)
    bm25.close_index(spark, index)
    again = bm25.load_index(spark, index.base)
    assert again == index and rows(again) == want
    plan = bm25.search(again, q)._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan


def test_cosine_top_k_equals_numpy(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(120, 8))
    m[50] = m[7]                                   # equal vectors tie by id
    rows = [(f"t{i:03d}", f"c{i % 3}", m[i].tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "ticket_id string, category string, vector array<double>").repartition(6)
    qs = [(f"q{j}", None if j == 0 else f"c{j % 3}", rng.normal(size=8).tolist()) for j in range(9)]
    q = spark.createDataFrame(qs, "query_id string, category string, vector array<double>")

    def want(filtered):
        out = {}
        for qid, c, v in qs:
            v = np.array(v) / np.linalg.norm(v)
            s = m @ v / np.linalg.norm(m, axis=1)
            ids = [i for i in range(120) if not filtered or c is None or rows[i][1] == c]
            ids.sort(key=lambda i: (-round(s[i], 9), rows[i][0]))
            out[qid] = [rows[i][0] for i in ids[:5]]
        return out

    def got(filters, **sizes):
        out = {}
        for r in vectors.cosine_top_k(df, q, 5, filters, **sizes).orderBy("query_id", "rank").collect():
            out.setdefault(r.query_id, []).append(r.ticket_id)
        return out

    assert got(()) == want(False) and got(("category",)) == want(True)
    assert got(("category",), chunk_rows=7, query_block=2) == want(True)
    assert got((), chunk_rows=7, query_block=2) == want(False)


def clustered(spark, n, seed=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, 16))
    rows = [(f"t{i}", (centre[i % 5] + 0.4 * rng.normal(size=16)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "ticket_id string, vector array<double>"), centre


def found(df):
    return sorted((r.query_id, r["rank"], r.ticket_id) for r in df.collect())


@pytest.mark.parametrize("bound", [None, 3.0])
def test_index_finds_the_nearest_and_compares_few(spark, monkeypatch, bound):
    df, centre = clustered(spark, 300)
    q = spark.createDataFrame([(f"q{j}", (centre[j] * (j + 1)).tolist()) for j in range(5)] + [("zero", [0.0] * 16), ("none", None)], "query_id string, vector array<double>")
    monkeypatch.setattr(vector_index, "PART_ROWS", 7)  # lists of several parts
    path = vector_index.build(df, cells=9)
    exact = vectors.cosine_top_k(df, q.where("vector is not null"), 10)
    got = vector_index.search(spark, path, q, 10, bound=bound)
    if bound is None:
        assert found(got) == found(exact)
    report = {r.query_id: r for r in vector_index.quality(df, path, q.where("query_id like 'q%'"), 10, bound=bound).collect()}
    assert min(r.recall for r in report.values()) >= 0.9
    assert all(10 <= r.candidates < 60 and r.candidate_share == r.candidates / 300 for r in report.values())


def test_index_of_copies_few_and_no_vectors(spark):
    schema = "ticket_id string, vector array<float>"
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<float>")
    for rows in ([], [("a", None)], [("a", [0.0, 1.0])], [(f"t{i:02}", [1.0, 1.0]) for i in range(40)] + [("x", [1.0, 0.0]), ("z", [0.0, 0.0])]):
        df = spark.createDataFrame(rows, schema)
        got = vector_index.search(spark, vector_index.build(df, cells=None if rows else 1), q, 5, bound=None)
        assert found(got) == found(vectors.cosine_top_k(df.where("vector is not null"), q, 5))


def test_missing_filter_values_of_vectors(make):
    df = make([("a", "C", [1.0, 0.0]), ("b", None, [1.0, 0.1]), ("c", "D", [1.0, 0.2])], "ticket_id string, category string, vector array<double>")
    q = make([("q", "C", [1.0, 0.0]), ("all", None, [1.0, 0.0])], "query_id string, category string, vector array<double>")
    assert found(vectors.cosine_top_k(df, q, 5, ("category",), chunk_rows=1)) == [("all", 1, "a"), ("all", 2, "b"), ("all", 3, "c"), ("q", 1, "a")]


def test_encoder_gives_unit_vectors(spark):
    df = spark.createDataFrame([("a", "disk full on node"), ("b", "disk full"), ("c", "invoice wrong")], "ticket_id string, text string")
    out = {r.ticket_id: np.array(r.vector) for r in vectors.encode(vectors.fit_encoder(df), df).collect()}
    assert all(len(v) == 384 and abs(np.linalg.norm(v) - 1) < 1e-5 for v in out.values())
    assert out["a"] @ out["b"] > out["a"] @ out["c"]


def ranked(make, rows):
    return make(rows, "query_id string, source_no int, rank int, ticket_id string")


def test_fusion(make):
    got = fusion.reciprocal_rank_fusion(ranked(make, [
        ("q", 0, 1, "A"), ("q", 0, 2, "B"), ("q", 1, 1, "B"), ("q", 1, 2, "A"), ("q", 1, 3, None), ("q", 1, 4, "")])).collect()
    assert {r.ticket_id: r.rrf_score for r in got} == {"A": 1 / 61 + 1 / 62, "B": pytest.approx(1 / 61 + 1 / 62)}
    assert min(got, key=lambda r: r.first_seen).ticket_id == "A"


@pytest.mark.parametrize("doc, pred, factor", [
    ((True, 5, "S", "C", "high"), ("C", "S", "critical", "angry"), 1.5 * 1.3 * 1.8 * (0.8 + 0.4 * 0.7) * 1.2 * 1.1),
    ((False, 3, "T", "C", "odd"), ("C", "S", "low", "neutral"), 1.1 * (0.8 + 0.4 * 0.5)),
    ((None, None, None, None, None), ("C", "S", "low", "frustrated"), 1.0),
    ((True, 4, "S", "D", None), ("C", None, None, None), 1.5 * 1.3),
])
def test_rerank_factors(make, doc, pred, factor):
    docs = make([("t", *doc)], "ticket_id string, resolution_helpful boolean, satisfaction_score int, "
                               "subcategory string, category string, priority string")
    preds = make([("q", *pred)], "query_id string, predicted_category string, predicted_subcategory string, "
                                 "predicted_priority string, predicted_sentiment string")
    fused = fusion.reciprocal_rank_fusion(ranked(make, [("q", 0, 1, "t")]))
    assert fusion.rerank(fused, docs, preds).first().final_score == pytest.approx(factor / 61)


def test_hybrid_uses_both_branches(spark, index):
    docs = spark.createDataFrame(DOCS, DOC_SCHEMA).withColumn("product", F.lit("P"))
    model, table = fusion.build_vectors(docs)
    q = spark.createDataFrame(
        [("q", "timeout", "database sync ERROR_TIMEOUT_429", "P", "Tech", None, None, None)],
        "query_id string, subject string, description string, product string, predicted_category string, "
        "predicted_subcategory string, predicted_priority string, predicted_sentiment string")
    both = fusion.hybrid_retrieve(q, docs, index, model, table, 5).collect()
    assert both[0].ticket_id == "1" and {r.ticket_id for r in both} == {"1", "3", "4"}
    assert fusion.hybrid_retrieve(q, docs, index, None, None).count() == 1
    assert fusion.hybrid_retrieve(q, docs, None, model, table).count() == 3
    with pytest.raises(ValueError):
        fusion.hybrid_retrieve(q, docs, None, None, None)


def test_whole_answers_with_any_encoder(spark, index):
    docs = spark.createDataFrame(DOCS, DOC_SCHEMA).withColumns({
        "product": F.lit("P"), "created_at": F.current_timestamp(), "resolution_code": F.lit("RC"), "resolution_helpful": F.lit(True),
        "resolution_time_hours": F.lit(1.0), "error_logs": F.lit("ERROR_TIMEOUT_429")})
    encoder = lambda df: df.withColumn("vector", F.array(F.length("text").cast("double"), F.lit(1.0)))
    same, table = fusion.build_vectors(docs, encoder=encoder)
    assert same is encoder
    q = spark.createDataFrame(
        [("q", "timeout", "database sync ERROR_TIMEOUT_429", "P", "Tech", "S", "high", None), ("none", "", "", None, "Unknown", None, None, None)],
        "query_id string, subject string, description string, product string, predicted_category string, "
        "predicted_subcategory string, predicted_priority string, predicted_sentiment string")
    got = {r.query_id: r for r in fusion.hybrid_answers(q, docs, index, encoder, table).collect()}
    assert [r["rank"] for r in got["q"].results] == [1, 2, 3] and {r.ticket_id for r in got["q"].results} == {"1", "3", "4"}
    assert {c.kind for c in got["q"].graph_context} == {"template", "error_code"}
    assert got["q"].metadata.error_codes == ["ERROR_TIMEOUT_429"] and got["q"].metadata.predicted_priority == "high"
    assert got["none"].graph_context == [] and got["none"].metadata.error_codes == []
    assert all(r.graph_context == [] for r in fusion.hybrid_answers(q, docs, index, None, None, use_graph=False).collect())


GOOD = "Updated the config parameter in settings.yaml to version 2.4, ran the api script; ERROR_DB_1 resolved and confirmed working. " * 2


def test_quality(make):
    df = make([
        ("q", "a", "Tech", "P", "Tech", "P", True, 5, GOOD), ("q", "b", "Tech", "P", "Bill", "Q", False, 1, "ok"),
        ("q", "c", None, "P", None, "Q", None, None, None)],
        "query_id string, ticket_id string, query_category string, query_product string, category string, "
        "product string, resolution_helpful boolean, satisfaction_score int, resolution string")
    got = {r.ticket_id: r for r in scoring.with_quality(df).collect()}
    assert got["a"].quality_score == pytest.approx(1.0) and got["b"].quality_score < 0.4
    assert got["c"].relevance == 0.7 and got["c"].success == 0.5 and got["c"].completeness == 0.1
    best = scoring.rank_by_quality(df, 2).orderBy("rank").collect()
    assert [r.ticket_id for r in best] == ["a", "c"]
    m = scoring.quality_metrics(scoring.with_quality(df)).first()
    scores = [r.quality_score for r in got.values()]
    assert m.n_results_scored == 3 and m.p25_quality == pytest.approx(np.percentile(scores, 25))
    assert m.high_quality_rate == pytest.approx(1 / 3)


def test_counted_postings_equal_grouped_words(spark, make, monkeypatch):
    """Words are counted without a row each; repeated tickets and missing ids meet over batches."""
    monkeypatch.setattr(bm25, "COUNTED_ROWS", 3)
    rows = [(None if i % 9 == 0 else str(i % 7), [None, "a", "b"][i % 3], "w%d x x y%d" % (i % 2, i % 5) if i % 11 else "") for i in range(120)]
    rows += [("7", "a", "x " * 50), ("7", "a", "x " * 50), ("8", None, None)]
    df = make(rows, "ticket_id string, category string, text string").repartition(3, "ticket_id")
    docs = bm25.tokenised(df)
    plan = bm25.counted_postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashAggregate" not in plan
    want = sorted(map(tuple, bm25.postings(docs).collect()), key=str)
    assert sorted(map(tuple, bm25.counted_postings(docs).collect()), key=str) == want
