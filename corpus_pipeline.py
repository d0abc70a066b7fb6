"""A training corpus from raw documents: classify, deduplicate, decontaminate, mix, shard.

``run`` applies the stages to the table documents; each is written as Parquet below
``spark.checkpoint.dir`` and read again as the next one's input. All stages but the last return
the columns of documents. Learnt labels, benchmark and corpus statistics come from the tables in
``sf_dir``; every stage works on all rows its predecessor kept.

Common to all stages: doc_id is a whole number or, of any other type, a name; a row without one
is identified by its text. Columns besides doc_id, text and source are carried along unchanged,
whatever their names and types. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from caselight.llm import decontaminate, mixing, near_dedup, quality_classifier, sharding
from caselight.llm.shared import all_columns, comparable, kept_aside, unused
from caselight.session import shared_dir

SHARDS = 24
#: No SQL: learnt scores and hashed signatures decide which rows stay.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _number(docs: DataFrame) -> Column:
    """A document's number: doc_id, a hash of it if it isn't a whole number, or for rows without
    one a number from their text, below all that are likely as ids. Rows of equal number are one
    document."""
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    own = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("string")))
    return F.coalesce(own, -F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(_number(docs).alias("doc_id"), "text")


def _joined(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``docs`` whose document is (left_semi) or isn't (left_anti) in ``ids`` (doc_id)."""
    name, other = unused(docs, "_number", "_other")
    rows = docs.select(*all_columns(docs), _number(docs).alias(name))
    return rows.join(ids.select(F.col("doc_id").alias(other)).distinct(), F.col(name) == F.col(other), how).select(all_columns(docs))


def _once(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` per document and text: the first by the other columns, nulls first.
    Only one row per task and group is moved."""
    name, digest, rank = unused(docs, "_number", "_digest", "_rank")
    others = [comparable(docs, c).asc_nulls_first() for c in docs.columns if c != "text"]
    first = F.row_number().over(Window.partitionBy(name, digest).orderBy(*others))
    rows = docs.select(*all_columns(docs), _number(docs).alias(name), F.sha2(F.col("text").cast("binary"), 256).alias(digest))
    return rows.withColumn(rank, first).where(F.col(rank) == 1).select(all_columns(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good.

    Rows are scored one by one: repeated rows share their fate, a null, empty or blank text has
    the score of a text without properties. Without usable labels every row scores 0.5 and stays.
    """
    held = quality_classifier.held_out(F.col("doc_id"))
    model = quality_classifier.fit(docs, _table(spark, sf_dir, "labels"), learn_from=~held)
    return quality_classifier.kept(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8).

    Of rows of one document (the same doc_id, or none and the same text) with equal texts one
    stays; those of a kept document that differ in text all stay, null and empty text included.
    Which rows repeat is found on narrow rows; texts are moved once, and those of documents with
    repeated rows once more.
    """
    groups = near_dedup.near_duplicates(_texts(docs))
    gone = groups.where(~F.col("kept")).select("doc_id")
    digests = docs.select(_number(docs).alias("doc_id"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    again = digests.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    again = kept_aside(again.join(gone, "doc_id", "left_anti"))
    if again.isEmpty():
        return _joined(docs, gone, "left_anti")
    return _joined(docs, gone.union(again), "left_anti").union(_once(_joined(docs, again, "left_semi")))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word passage of the benchmark.

    Of rows that share a doc_id all go if one of them has such a passage. Null, empty and blank
    texts have none and stay; without benchmark texts everything stays.
    """
    found = decontaminate.phrase_matches(decontaminate.build_index(_texts(docs)), _table(spark, sf_dir, "benchmark"))
    return _joined(docs, found.where(F.size("hit_words") > 0), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a row per copy taken.

    A null source is a source, the last one. Documents without words (null, empty, blank texts)
    use no budget: they are taken as often as their source's documents are whole. Ties in the
    random key are broken by doc_id and the other columns; the document at which a budget ends
    is cut to the words that are left.
    """
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and place in it.

    Rows of the same doc_id, or without one, share a shard; identical rows get neighbouring
    places; a null text has no bytes.
    """
    return sharding.sharded(docs, SHARDS)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", contamination),
    ("mixing", mix),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents: its columns and those of sharding.
    Each stage's output stays below ``spark.checkpoint.dir``, so a lost executor costs the tasks
    it ran, never an earlier stage."""
    docs = _table(spark, sf_dir, "documents")
    folder = shared_dir(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
