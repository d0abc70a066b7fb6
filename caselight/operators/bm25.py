"""Keyword search over an index of tables.

The postings table is bucketed by ticket, so the contributions to one (query, ticket)
pair meet in the task that reads the ticket: pairs are summed and cut to the best k
per query without being shuffled. Only k rows per task and query leave a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from caselight.functions.text import tokens
from caselight.operators.scale import top_n_per_group
from caselight.schemas import with_columns
from caselight.session import kept_aside, shared_dir, state_partitions

# ---- fixed values: scoring parameters -------------------------------------------
K1 = 1.5
B = 0.75
EPSILON = 0.25
# ---------------------------------------------------------------------------------

#: Query weights of one block, which every task gets whole.
QUERY_BYTES = 64 * 1024 * 1024


def search_text():
    """Original text of a ticket, nothing cleaned: exact codes stay findable."""
    return F.concat_ws(
        " ", "subject", "description", "resolution", "error_logs", F.array_join("tags", " "))


def search_texts(docs: DataFrame) -> DataFrame:
    """(ticket_id, category, text): what the index reads."""
    docs = with_columns(docs, ["subject", "description", "resolution", "error_logs", "tags", "category"])
    return docs.select("ticket_id", "category", search_text().alias("text"))


def tokenised(texts: DataFrame) -> DataFrame:
    return texts.select("ticket_id", "category", tokens("text").alias("tokens"))


def postings(tokenised_docs: DataFrame) -> DataFrame:
    """(ticket_id, category, dl, term, tf)."""
    return (
        tokenised_docs
        .select("ticket_id", "category", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
        .groupBy("ticket_id", "category", "dl", "term").agg(F.count("*").cast("int").alias("tf"))
    )


_POSTINGS = "ticket_id string, category string, dl int, term string, tf int"
#: Texts of an Arrow batch that are counted at once.
COUNTED_ROWS = 1000


def _counts(batch: pa.RecordBatch) -> pa.Table:
    """Terms and their counts per run of rows with equal ticket, category and length."""
    tokens = batch["tokens"]
    own = [batch["ticket_id"], batch["category"], pc.list_value_length(tokens)]
    codes = [c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in own]
    new = np.zeros(len(batch), dtype=np.int64)
    for c in codes:
        new[1:] |= c[1:] != c[:-1]
    run = np.cumsum(new)
    words = tokens.flatten().dictionary_encode()
    n = max(1, len(words.dictionary))
    pairs = run[pc.list_parent_indices(tokens).to_numpy()] * n + words.indices.to_numpy()
    pairs, counts = np.unique(pairs, return_counts=True)
    row = pa.array(np.flatnonzero(np.diff(run, prepend=-1))[pairs // n])
    return pa.table({"ticket_id": own[0].take(row), "category": own[1].take(row), "dl": own[2].take(row),
                     "term": words.dictionary.take(pa.array(pairs % n)), "tf": pa.array(counts, pa.int32())})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows in order of ticket, category and length; the counts of the last of them
    are held until it is certain that the next batch doesn't go on with it."""
    names = ["ticket_id", "category", "dl"]
    key = lambda t, at: tuple(t[c][at].as_py() for c in names)
    held = None
    for whole in batches:
        for at in range(0, len(whole), COUNTED_ROWS):
            found = _counts(whole.slice(at, COUNTED_ROWS))
            if not len(found):
                continue
            last = key(found, -1)
            if held is not None and key(held, 0) == key(found, 0):
                both = pa.concat_tables([held, found]).group_by([*names, "term"]).aggregate([("tf", "sum")])
                found = both.select([*names, "term", "tf_sum"]).rename_columns([*names, "term", "tf"])
                found = found.set_column(4, "tf", found["tf"].cast(pa.int32()))
            elif held is not None:
                yield from held.to_batches()
            mine = pa.array([True] * len(found))
            for c, x in zip(names, last):
                mine = pc.and_(mine, pc.is_null(found[c]) if x is None else pc.fill_null(pc.equal(found[c], x), False))
            held = found.filter(mine).combine_chunks()
            yield from found.filter(pc.invert(mine)).combine_chunks().to_batches()
    if held is not None:
        yield from held.to_batches()


def counted_postings(tokenised_docs: DataFrame) -> DataFrame:
    """``postings`` of rows that are dealt by ticket. Texts are put in order, not their many words,
    and words are counted where they are, so none is a row or a key of its own."""
    rows = tokenised_docs.select(F.col("ticket_id").cast("string"), F.col("category").cast("string"), "tokens")
    return rows.sortWithinPartitions("ticket_id", "category", F.size("tokens")).mapInArrow(_counted, _POSTINGS)


def corpus_terms(post: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, tokens, idf): unfloored inverse document frequency."""
    n = F.lit(float(n_docs))
    return post.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("tokens")).withColumn(
        "idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))


def floored(idf, mean_idf: float):
    """A negative idf becomes a quarter of the mean over all terms."""
    return F.when(idf < 0, F.lit(EPSILON * mean_idf)).otherwise(idf)


@dataclass(frozen=True)
class Bm25Index:
    """Names and places of the index tables and the corpus totals."""

    base: str
    postings_table: str
    buckets: int
    n_docs: int
    avg_len: float
    mean_idf: float

    def terms(self, spark: SparkSession) -> DataFrame:
        """(term, df, idf) with the floor applied."""
        return spark.read.parquet(f"{self.base}/terms").withColumn(
            "idf", floored(F.col("idf"), self.mean_idf))

    def categories(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.base}/categories")


def build_index(docs: DataFrame, base: str | None = None, buckets: int | None = None) -> Bm25Index:
    """Write postings, terms, category counts and totals; texts are shuffled once."""
    spark = docs.sparkSession
    buckets = buckets or state_partitions(spark)
    base = base or shared_dir(spark, "bm25")
    name = f"caselight_postings_{uuid.uuid4().hex[:12]}"
    # the raw texts are spread, which is less to shuffle than their tokens; tokenising and
    # counting then stay in the task that holds the ticket
    by_doc = search_texts(docs).repartition(buckets, "ticket_id")
    # sorted by term inside a bucket: a search skips the row groups without its terms
    (counted_postings(tokenised(by_doc)).write.bucketBy(buckets, "ticket_id").sortBy("term")
     .option("path", f"{base}/postings").format("parquet").saveAsTable(name))
    docs.groupBy("category").agg(F.count("*").alias("n")).write.parquet(f"{base}/categories")
    n = spark.read.parquet(f"{base}/categories").agg(F.sum("n")).first()[0] or 0
    corpus_terms(spark.table(name), n).write.parquet(f"{base}/terms")
    terms = spark.read.parquet(f"{base}/terms").agg(
        F.avg("idf").alias("mean"), F.sum("tokens").alias("tokens")).first()
    index = Bm25Index(base, name, buckets, n, (terms.tokens or 0) / n if n else 0.0, terms["mean"] or 0.0)
    spark.createDataFrame([asdict(index)]).write.parquet(f"{base}/totals")
    return index


def load_index(spark: SparkSession, base: str) -> Bm25Index:
    """Open a written index, also in a session whose catalog does not know its table."""
    index = Bm25Index(**spark.read.parquet(f"{base}/totals").first().asDict())
    if not spark.catalog.tableExists(index.postings_table):
        spark.sql(
            f"CREATE TABLE {index.postings_table} "
            "(ticket_id STRING, category STRING, dl INT, term STRING, tf INT) USING parquet "
            f"CLUSTERED BY (ticket_id) INTO {index.buckets} BUCKETS LOCATION '{base}/postings'")
    return index


def close_index(spark: SparkSession, index: Bm25Index) -> None:
    """Forget the table; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {index.postings_table}")


def search(
    index: Bm25Index, queries: DataFrame, top_k: int = 10, use_category: bool = True,
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """Best ``top_k`` tickets with a positive score for every query.

    ``queries`` has (query_id, text, category). A query's category restricts its
    results only if the index has documents of that category.
    """
    spark = queries.sparkSession
    q = (
        queries.select("query_id", "category", F.explode(tokens("text")).alias("term"))
        .groupBy("query_id", "category", "term").agg(F.count("*").alias("qtf"))
    )
    known = index.categories(spark).select(
        F.col("category").alias("known_category"))
    wanted = index.terms(spark).join(q, "term").join(
        known, F.col("category") == F.col("known_category"), "left")
    restrict = F.col("known_category") if use_category else F.lit(None).cast("string")
    weights = wanted.select(
        "query_id", "term", restrict.alias("only"),
        (F.col("qtf") * F.col("idf") * (K1 + 1)).alias("weight"))
    # ticket and query meet in the task that reads the ticket; a query table whose
    # weights exceed the bound is answered in blocks, never by shuffling pairs
    weights = kept_aside(weights)
    texts = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("query_id", "term", "only")), F.lit(64))
    size = weights.agg(F.sum(texts)).first()[0] or 0
    blocks = max(1, -(-size // (query_bytes // 2)))  # blocks by hash aren't quite even
    found = None
    for b in range(blocks):
        block = weights if blocks == 1 else weights.filter(
            F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        best = _best_of_block(index, spark, block, top_k)
        found = best if found is None else found.unionByName(best)
    return found


def _best_of_block(index: Bm25Index, spark: SparkSession, weights: DataFrame, top_k: int) -> DataFrame:
    gain = F.col("weight") * F.col("tf") / (
        F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(index.avg_len)))
    allowed = F.col("only").isNull() | (F.col("only") == F.col("category"))
    scores = (
        spark.table(index.postings_table)
        .join(F.broadcast(weights), "term").filter(allowed)
        .groupBy("query_id", "ticket_id").agg(F.sum(gain).alias("score"))
        .filter(F.col("score") > 0)
    )
    # sums differ in their last bits with the row order; equal scores must tie
    order = [F.desc(F.round("score", 9)), F.asc("ticket_id")]
    return top_n_per_group(scores, ["query_id"], order, top_k)
