"""Quality rules on whole texts, with column functions only.

Base rules count words, symbols, repeated lines and repeated eight-word windows. The verdict on
what they let pass is a log-likelihood ratio: hashed word n-grams of a document under a
multinomial of trusted documents against one of the raw corpus, per n-gram, against a threshold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept_aside, words

BUCKETS = 2**16
#: Mean log ratio per n-gram below which a document goes.
THRESHOLD = -0.1
#: Pseudo-counts of each bucket: few occurrences are no evidence.
PRIOR = 50
#: Runs of letters and digits, and runs of other characters that aren't white space.
TOKENS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"
WINDOW = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def repeated_words(own: Column, size: int = WINDOW) -> Column:
    """Words of an array that lie in a window of ``size`` words found twice or more in it."""

    def covered(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            marked = F.transform(s, lambda x, k: F.when(twin(x, k), x["i"]).otherwise(F.lit(-1)))
            return F.sort_array(F.filter(marked, lambda i: i >= 0))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last"))
        step = lambda s, i: F.struct((s["n"] + F.least(F.lit(size), i - s["last"])).alias("n"), i.alias("last"))
        return F.aggregate(let(ranked, places), start, step)["n"]

    starts = F.when(F.size(own) >= size, F.sequence(F.lit(1), F.size(own) - size + 1)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(own, i, size)))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def counts(text: Column) -> Column:
    """struct(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text, all long."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Hash buckets of a text's tokens and of its pairs of neighbouring tokens."""

    def both(t: Column) -> Column:
        one = F.transform(t, lambda x: F.pmod(F.xxhash64(x), F.lit(buckets)).cast("int"))
        two = F.zip_with(t, F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda x, y: F.when(y.isNotNull(), F.pmod(F.xxhash64(x, y), F.lit(buckets)).cast("int")))
        return F.concat(one, F.array_compact(two))

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKENS), F.lit(0)), both)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, weight): the log ratio of each of the ``buckets``.

    Counts cover every text of ``docs``; the target's are those of all documents in ``trusted``
    (doc_id). Each bucket has ``PRIOR`` further raw occurrences of which the target has its share,
    so a rare n-gram that happens to be in no trusted document weighs little, and a frequent one
    that none has weighs much. All weights are 0 without a target.

    Both counts come from one pass over the n-grams. The join by id is a merge join at every
    size, so what is shuffled grows in proportion to the texts.
    """
    ids = trusted.select("doc_id", F.lit(1).alias("target")).distinct().hint("merge")
    flagged = docs.select("doc_id", "text").join(ids, "doc_id", "left")
    grams = flagged.select(F.coalesce("target", F.lit(0)).alias("target"), F.explode(ngram_buckets(F.col("text"), buckets)).alias("bucket"))
    found = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("target").alias("target"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    filled = every.join(found, "bucket", "left").na.fill(0)
    whole = Window.partitionBy()  # one row per bucket
    share = F.sum("target").over(whole) / F.greatest(F.lit(1), F.sum("raw").over(whole))
    ratio = (F.col("target") + PRIOR * share) / F.when(share > 0, share * (F.col("raw") + PRIOR))
    return filled.select("bucket", F.when(share > 0, F.log(ratio)).otherwise(F.lit(0.0)).alias("weight"))


def trusted_ids(labels: DataFrame, learn_from: Column | None = None) -> DataFrame:
    """Ids of all documents whose labels (doc_id, quality) are all 1; null ids and null labels
    don't count."""
    usable = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null")
    if learn_from is not None:
        usable = usable.where(learn_from)
    return usable.groupBy("doc_id").agg(F.min("quality").alias("worst")).where("worst >= 1").select("doc_id")


def judged(
    docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS,
    least_words: int = 20, most_repeated: int = 30,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, score and kept.

    base_failed: fewer than ``least_words`` words, or more than ``most_repeated`` percent of them
    in repeated eight-word windows. score: mean log ratio of the document's hashed unigrams and
    bigrams, 0 for a text without tokens. kept: not base_failed and score >= ``threshold``. Null,
    empty and blank texts have no words and fail. Rows are judged one by one, so null and
    repeated doc_ids are fine; an empty table gives no rows. Without trusted documents all scores
    are 0. Other columns of ``docs`` are ignored.
    """
    table = kept_aside(log_ratios(docs, trusted, buckets)).agg(F.sort_array(F.collect_list(F.struct("bucket", "weight"))).alias("rows"))
    weights = table.select(F.transform("rows", lambda x: x["weight"]).alias("w")).scalar()  # one number per bucket
    grams = ngram_buckets(F.col("text"), buckets)
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda sum_, b: sum_ + F.get("weights", b))
    score = let(grams, lambda g: F.when(F.size(g) > 0, total(g) / F.size(g)).otherwise(F.lit(0.0)))
    rows = docs.select("doc_id", "text", weights.alias("weights"))
    rows = rows.select("doc_id", counts(F.col("text")).alias("c"), score.alias("score"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    rows = rows.select("doc_id", "c.*", "score").withColumn("base_failed", failed)
    return rows.withColumn("kept", ~failed & (F.col("score") >= threshold))
