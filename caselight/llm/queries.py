"""Queries of this subpackage over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format, decontaminate, embedding_whitening, graph_search, importance_resampling, licenses, line_dedup, mixing, near_dedup, oracles, quality_classifier, quality_rules, sharding, substring_dedup,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = oracles.ORACLES


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on two-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated 20-word windows removed from all documents."""
    out = substring_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"), window=20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word passages of the benchmark in all documents."""
    index = decontaminate.build_index(table(spark, sf_dir, "documents"))
    found = decontaminate.phrase_matches(index, table(spark, sf_dir, "benchmark"), size=10)
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated multi-line passages removed from all documents."""
    out = line_dedup.remove_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_passages", "n_removed_lines", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1 by source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.sharded(docs, 24).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = quality_classifier.held_out(F.col("doc_id"))
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), learn_from=~held)
    scores = quality_classifier.scored(docs, model)
    return scores.select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and one whose texts hold control strings; read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], turns.schema)
    return chat_format.read_back(chat_format.format_conversations(turns.union(extra)))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and likelihood-ratio verdict of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = quality_classifier.held_out(F.col("doc_id"))
    trusted = quality_rules.trusted_ids(table(spark, sf_dir, "labels"), learn_from=~held)
    out = quality_rules.judged(docs, trusted)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements of all documents."""
    out = licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.concat_ws(",", "sentence_ids").alias("sentence_ids"),
        F.size("matches").cast("long").alias("n_matches"), F.concat_ws(",", "licenses").alias("licenses"),
    )


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all documents towards the benchmark, and the ranks of the drawn twentieth."""
    out = importance_resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their 32 whitened principal components."""
    out = embedding_whitening.whitened(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


@query
def op11_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth embedding among all others."""
    vectors = graph_search.vectors_of(table(spark, sf_dir, "embeddings"))
    return graph_search.search(graph_search.build_index(vectors), vectors.where("id % 20 = 0"), k=20)
