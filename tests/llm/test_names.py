"""Columns whose names clash with those the operators use, dots, maps, text ids."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caselight.llm import (
    decontaminate, importance_resampling, licenses, line_dedup, mixing, near_dedup, quality_classifier, quality_rules, sharding, substring_dedup,
)

HELPERS = [
    "_at", "_s", "_c", "_cut", "_part", "_whole", "whole", "_salt", "_copy", "copy", "row", "copies", "rest", "range", "_jump", "_order", "_range", "_offset",
    "_n", "_bytes", "_id", "_number", "_other", "_digest", "_rank", "digest", "n", "key", "size", "score", "rank", "chunk", "node", "weights", "a.b", "x y`z", "chunk_",
]
TEXT = " ".join(f"w{i}" for i in range(40))


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"{TEXT} {i % 7} own{i // 2} more{i // 3}", "en", f"s{i % 3}" if i else None, 5) for i in range(12)] + [(20, None, None, "s1", None), (21, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: F.concat(F.lit(c + ":"), F.col("doc_id").cast("string")) for c in HELPERS}
    return docs.select("*", *[v.alias(c) for c, v in extra.items()], F.create_map(F.lit("k"), "doc_id").alias("_map")).cache()


def unchanged(docs, out, replaced=()):
    """Every row of ``out`` holds the extra columns of its document."""
    names = [c for c in docs.columns if c not in ("text", "n_chars", *replaced)]
    own = {r["doc_id"]: [r[c] for c in names] for r in docs.collect()}
    rows = out.collect()
    assert rows and all([r[c] for c in names] == own[r["doc_id"]] for r in rows)


def test_row_operators_return_other_columns(clashing):
    new = ("size", "source_size", "target", "copies", "part_words", "taken")
    unchanged(clashing, mixing.mixed(clashing), new)
    unchanged(clashing, mixing.mixed_documents(clashing))
    unchanged(clashing, sharding.sharded(clashing, 3), ("size", "text_crc32", "law", "shard", "slot", "grown_shard"))
    model = quality_classifier.Model(quality_classifier.np.ones(quality_classifier.N_FEATURES), 0.5)
    unchanged(clashing, quality_classifier.scored(clashing, model), ("score", "predicted"))
    assert quality_classifier.kept(clashing, model).columns == clashing.columns


@pytest.mark.parametrize("operator", [
    near_dedup.near_duplicates, substring_dedup.remove_repeated_windows, line_dedup.remove_repeated_passages, licenses.scanned,
    lambda d: decontaminate.phrase_matches(decontaminate.build_index(d), d.select(F.col("doc_id").alias("item_id"), "text").limit(2)),
    lambda d: quality_rules.judged(d, d.select("doc_id").limit(3)),
    lambda d: importance_resampling.resampled(d, d.select(F.col("doc_id").alias("item_id"), "text").limit(2)),
])
def test_operators_with_own_columns_ignore_others(clashing, operator):
    assert sorted(r["doc_id"] for r in operator(clashing).collect()) == [*range(12), 20, 21]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_return_other_columns(spark, clashing, tmp_path, stage):
    spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this kind"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, clashing, str(tmp_path))
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard") if stage is corpus_pipeline.shards else ()
    assert out.columns[: len(clashing.columns) - len({"size"} & set(new))] == [c for c in clashing.columns if c not in new]
    unchanged(clashing, out, new)
    none = stage(spark, clashing.limit(0), str(tmp_path))
    assert none.columns == out.columns and none.collect() == []


def test_stages_take_documents_named_by_text(spark):
    text = " ".join(f"t{i}" for i in range(30))
    docs = spark.createDataFrame([("a", text, "s"), ("b", text, "s"), ("b", text, "s"), (None, None, "s")], "doc_id string, text string, source string")
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert len(kept) == 2 and None in kept
    items = spark.createDataFrame([("x", text)], "item_id string, text string")
    index = decontaminate.build_index(corpus_pipeline._texts(docs))
    assert sorted(len(r["items"]) for r in decontaminate.phrase_matches(index, items).collect()) == [0, 1, 1, 1]
    assert corpus_pipeline.mix(spark, docs, "").count() >= 3 and corpus_pipeline.shards(spark, docs, "").count() == 4
