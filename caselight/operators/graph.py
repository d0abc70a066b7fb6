"""Edge tables product -> issue -> resolution and error code -> resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caselight.functions.text import distinct_error_codes
from caselight.operators.scale import first_by_time, top_n_per_group


def _text(chars: int | None) -> Column:
    """The resolution, whole unless a length is asked for."""
    return F.col("resolution") if chars is None else F.left("resolution", F.lit(chars))


def product_issues(tickets: DataFrame) -> DataFrame:
    return (
        tickets.filter(F.col("product").isNotNull() & F.col("category").isNotNull())
        .groupBy("product", F.col("category").alias("issue_type"))
        .agg(F.count("ticket_id").alias("frequency"),
             F.avg("resolution_time_hours").alias("avg_resolution_hrs"))
    )


def issue_solutions(tickets: DataFrame, text_chars: int | None = None) -> DataFrame:
    """Per category and resolution code: use, success and the earliest text.

    The text is kept whole; ``text_chars`` cuts it.
    """
    rows = tickets.filter(
        F.col("resolution_code").isNotNull() & F.col("resolution").isNotNull()
        & F.col("category").isNotNull()
    ).withColumn("issue_type", F.col("category"))
    return first_by_time(
        rows, ["issue_type", "resolution_code"],
        {"resolution_template": _text(text_chars)},
        [F.count("ticket_id").alias("usage_count"),
         F.avg(F.col("resolution_helpful").cast("int")).alias("success_rate")])


def error_code_mapping(tickets: DataFrame, text_chars: int | None = None) -> DataFrame:
    """Per error code, product and category: tickets and the earliest resolution.

    The text is kept whole; ``text_chars`` cuts it.
    """
    rows = (
        tickets.filter(F.col("error_logs").isNotNull() & F.col("product").isNotNull()
                       & F.col("category").isNotNull())
        .select("ticket_id", "created_at", "product", F.col("category").alias("issue_type"),
                "resolution_code", _text(text_chars).alias("text"),
                F.explode(distinct_error_codes("error_logs")).alias("error_code"))
    )
    return first_by_time(
        rows, ["error_code", "product", "issue_type"],
        {"resolution_code": F.col("resolution_code"), "resolution_text": F.col("text")},
        [F.count("*").alias("occurrences")])


def product_resolutions(
    queries: DataFrame, issues: DataFrame, solutions: DataFrame, top_k: int = 5
) -> DataFrame:
    """Best solutions for each query's (product, category); two hops.

    The order of solutions depends on the category alone, so they are cut to the best
    ``top_k`` per category before the join: a query meets at most ``top_k`` rows.
    """
    best = top_n_per_group(
        solutions, ["issue_type"],
        [F.desc_nulls_first("success_rate"), F.asc("resolution_code")], top_k)
    return (
        queries.select("query_id", "product", F.col("category").alias("issue_type"), "subcategory")
        .join(issues.select("product", "issue_type", "avg_resolution_hrs"), ["product", "issue_type"])
        .join(best, "issue_type")
    )


def error_code_resolutions(queries: DataFrame, mapping: DataFrame, top_k: int = 5) -> DataFrame:
    """Most frequent mappings of each query's error codes, at most ``top_k`` per query.

    Each code is cut to its best ``top_k`` before the join; the best of a query are
    always among the best of its codes.
    """
    order = [F.desc("occurrences"), F.asc("error_code"), F.asc("product"), F.asc("issue_type")]
    best = top_n_per_group(mapping, ["error_code"], order, top_k).drop("rank")
    codes = queries.select("query_id", F.explode(F.array_distinct("error_codes")).alias("error_code"))
    return top_n_per_group(codes.join(best, "error_code"), ["query_id"], order, top_k)


def related_context(
    queries: DataFrame, issues: DataFrame, solutions: DataFrame, mapping: DataFrame, top_k: int = 5
) -> DataFrame:
    """Context rows per query: (query_id, kind, rank, code, text, score).

    Templates that mention the query's subcategory rank with a 1.5 times higher rate.
    """
    wanted = F.replace(F.replace(F.lower("subcategory"), F.lit("_"), F.lit(" ")), F.lit("/"), F.lit(" "))
    mentioned = F.contains(F.lower(F.coalesce("resolution_template", F.lit(""))), wanted)
    rate = F.coalesce("success_rate", F.lit(0.0))
    has_sub = F.length("subcategory") > 0
    templates = product_resolutions(queries, issues, solutions, top_k).withColumn(
        "score", F.when(has_sub & mentioned, rate * 1.5).otherwise(rate))
    templates = top_n_per_group(
        templates.withColumnRenamed("rank", "rate_rank"), ["query_id"],
        [F.desc("score"), F.asc("rate_rank")], top_k)
    codes = error_code_resolutions(queries, mapping, top_k)
    return templates.select(
        "query_id", F.lit("template").alias("kind"), "rank",
        F.col("resolution_code").alias("code"), F.col("resolution_template").alias("text"), "score",
    ).unionByName(codes.select(
        "query_id", F.lit("error_code").alias("kind"), "rank",
        F.col("error_code").alias("code"), F.col("resolution_text").alias("text"),
        F.col("occurrences").cast("double").alias("score"),
    ))
