"""Rank fusion, classification-aware reranking and hybrid retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from caselight.functions.text import clean_tickets, distinct_error_codes, index_text
from caselight.operators import bm25, graph, vectors
from caselight.operators.scale import top_n_per_group
from caselight.schemas import PRIORITY_ADJACENCY, PRIORITY_ADJACENCY_OTHER, lookup, with_columns
from caselight.session import shared_dir

PAYLOAD = [
    "category", "subcategory", "priority", "product", "resolution", "resolution_code",
    "resolution_helpful", "satisfaction_score", "subject",
]
RRF_K = 60


def reciprocal_rank_fusion(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """Fuse ranked lists (query_id, source_no, rank from 1, ticket_id).

    ``first_seen`` orders equal scores: list number first, then rank in it.
    """
    return (
        ranked.filter(F.length("ticket_id") > 0)
        .groupBy("query_id", "ticket_id")
        .agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf_score"),
             F.min(F.col("source_no").cast("long") * 1_000_000_000 + F.col("rank")).alias("first_seen"))
    )


def _adjacency(predicted: Column, actual: Column) -> Column:
    table = {f"{p}>{a}": v for p, row in PRIORITY_ADJACENCY.items() for a, v in row.items()}
    return F.coalesce(
        lookup(table, F.concat_ws(">", predicted, actual)), F.lit(PRIORITY_ADJACENCY_OTHER))


def rerank_score(score: Column) -> Column:
    """Boost by result quality and agreement with the predicted labels.

    Expects the payload columns and predicted_category / _subcategory / _priority /
    _sentiment.
    """
    def times(cond: Column, factor: float) -> Column:
        return F.when(cond, factor).otherwise(1.0)

    helpful = F.coalesce("resolution_helpful", F.lit(False))
    content = F.coalesce("satisfaction_score", F.lit(0)) >= 4
    subcategories = (F.length("predicted_subcategory") > 0) & (F.length("subcategory") > 0)
    by_subcategory = (
        F.when(subcategories & (F.col("subcategory") == F.col("predicted_subcategory")), 1.8)
        .when(subcategories & F.col("category").eqNullSafe(F.col("predicted_category")), 1.1)
        .otherwise(1.0)
    )
    priorities = (F.length("predicted_priority") > 0) & (F.length("priority") > 0)
    by_priority = F.when(
        priorities,
        0.8 + 0.4 * _adjacency(F.col("predicted_priority"), F.col("priority"))).otherwise(1.0)
    upset = F.coalesce(F.col("predicted_sentiment").isin("frustrated", "angry"), F.lit(False))
    return (
        score * times(helpful, 1.5) * times(content, 1.3) * by_subcategory * by_priority
        * times(upset & content, 1.2) * times(upset & helpful, 1.1)
    )


def rerank(fused: DataFrame, docs: DataFrame, predictions: DataFrame, top_k: int = 5) -> DataFrame:
    """Attach payload and predictions to the fused ids, score and keep the best.

    Only ids and scores were carried so far; the payload is joined to the few
    remaining rows.
    """
    docs = with_columns(docs, PAYLOAD)
    rows = docs.select("ticket_id", *PAYLOAD).join(
        fused, "ticket_id").join(predictions, "query_id")
    scored = rows.withColumn("final_score", rerank_score(F.col("rrf_score")))
    return top_n_per_group(
        scored, ["query_id"],
        [F.desc("final_score"), F.desc("rrf_score"), F.asc("first_seen"), F.asc("ticket_id")], top_k)


def resolved(tickets: DataFrame) -> DataFrame:
    return tickets.filter(F.length("resolution") > 0)


def build_vectors(
    tickets: DataFrame, path: str | None = None, encoder: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[vectors.Encoder, DataFrame]:
    """Encoder and vectors of the cleaned resolutions, with the filter columns.

    The vectors are written, so that a batch of queries reads them instead of cleaning and
    encoding the whole corpus again, and so is the default encoder, which is fitted to the
    texts. ``encoder``, a function that adds ``vector`` to rows with ``text``, takes its place.
    """
    spark = tickets.sparkSession
    path = path or shared_dir(spark, "vectors")
    texts = index_text(resolved(tickets), "text").select("ticket_id", "category", "product", "text")
    if encoder is None:
        model, rows = vectors.fit_and_encode(texts)
        model.write().overwrite().save(f"{path}/encoder")
    else:
        model, rows = encoder, vectors.encode(encoder, texts).drop("text")
    rows.write.mode("overwrite").parquet(f"{path}/vectors")
    return model, spark.read.parquet(f"{path}/vectors")


def read_vectors(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    return PipelineModel.load(f"{path}/encoder"), spark.read.parquet(f"{path}/vectors")


def hybrid_retrieve(
    queries: DataFrame, tickets: DataFrame, index: bm25.Bm25Index | None,
    encoder: vectors.Encoder | None, vector_table: DataFrame | None, top_k: int = 5,
) -> DataFrame:
    """Answer a table of tickets.

    ``queries``: query_id, subject, description, product and the predicted labels. The
    vector list uses cleaned text with category and product filter, the keyword list
    original text with category filter. A branch given as None adds no rows.
    """
    lists = None
    if encoder is not None and vector_table is not None:
        asked = clean_tickets(queries, "text").select(
            "query_id", "text", "product", F.col("predicted_category").alias("category"))
        found = vectors.cosine_top_k(
            vector_table, vectors.encode(encoder, asked), top_k * 2, ("category", "product"))
        lists = found.withColumn("source_no", F.lit(0))
    if index is not None:
        asked = queries.select(
            "query_id", F.concat_ws(" ", "subject", "description").alias("text"),
            F.col("predicted_category").alias("category"))
        found = bm25.search(index, asked, top_k * 2).withColumn("source_no", F.lit(1))
        lists = found if lists is None else lists.unionByName(found)
    if lists is None:
        raise ValueError("hybrid_retrieve needs at least one branch")
    predictions = queries.select(
        "query_id", "predicted_category", "predicted_subcategory", "predicted_priority",
        "predicted_sentiment")
    return rerank(reciprocal_rank_fusion(lists), tickets, predictions, top_k)


def stored_context(queries: DataFrame, issues: DataFrame, solutions: DataFrame,
                   mapping: DataFrame, top_k: int = 5) -> DataFrame:
    """Graph context of a table of tickets from the edge tables."""
    q = with_columns(queries, ["error_logs"]).select(
        "query_id", "product", F.col("predicted_category").alias("category"),
        F.col("predicted_subcategory").alias("subcategory"),
        distinct_error_codes(F.concat_ws(" ", "description", "error_logs")).alias("error_codes"))
    return graph.related_context(q, issues, solutions, mapping, top_k)


def query_context(queries: DataFrame, tickets: DataFrame, top_k: int = 5) -> DataFrame:
    """Graph context with edges taken from the tickets themselves."""
    return stored_context(
        queries, graph.product_issues(tickets), graph.issue_solutions(tickets),
        graph.error_code_mapping(tickets), top_k)


def hybrid_answers(
    queries: DataFrame, tickets: DataFrame, index: bm25.Bm25Index | None, encoder: vectors.Encoder | None,
    vector_table: DataFrame | None, graph_tables: tuple[DataFrame, DataFrame, DataFrame] | None = None,
    top_k: int = 5, use_graph: bool = True,
) -> DataFrame:
    """One row per query with everything an answer holds: query_id, results, graph_context and
    metadata.

    ``results`` are the best ``top_k`` of ``hybrid_retrieve`` with their payload, best first.
    ``graph_context`` has templates and error-code rows of the edge tables (``graph_tables``,
    or edges of the tickets); it is empty without ``use_graph``, and for a query without
    product or predicted category. ``metadata`` repeats the predicted labels and the product and
    lists the error codes of description and logs. A query that nothing answers has empty arrays.
    """
    found = hybrid_retrieve(queries, tickets, index, encoder, vector_table, top_k)
    kept = ["rank", "ticket_id", "rrf_score", "final_score", *PAYLOAD]
    results = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("results"))
    q = with_columns(queries, ["error_logs"])
    labels = ["predicted_category", "predicted_subcategory", "predicted_priority", "predicted_sentiment", "product"]
    codes = distinct_error_codes(F.concat_ws(" ", "description", "error_logs"))
    out = q.select("query_id", F.struct(*labels, codes.alias("error_codes")).alias("metadata")).join(results, "query_id", "left")
    context_type = "array<struct<kind:string,rank:int,code:string,text:string,score:double>>"
    if use_graph:
        asked = queries.filter((F.length("product") > 0) & (F.length("predicted_category") > 0))
        edges = graph_tables or (graph.product_issues(tickets), graph.issue_solutions(tickets), graph.error_code_mapping(tickets))
        rows = stored_context(asked, *edges, top_k=top_k)
        packed = F.array_sort(F.collect_list(F.struct("kind", "rank", "code", "text", "score"))).cast(context_type)
        out = out.join(rows.groupBy("query_id").agg(packed.alias("graph_context")), "query_id", "left")
    else:
        out = out.withColumn("graph_context", F.lit(None).cast(context_type))
    return out.select(
        "query_id", F.coalesce("results", F.array().cast(results.schema["results"].dataType)).alias("results"),
        F.coalesce("graph_context", F.array().cast(context_type)).alias("graph_context"), "metadata")
