"""The distributed building blocks against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselight.operators import scale, split
from caselight.operators.scale import first_by_time, quantiles, top_n_per_group


def test_quantiles_equal_numpy(make):
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.normal(100, 15, 400), "tied": np.repeat([1.0, 2.0, 2.0, 7.0], 60),
        "one": np.array([3.5]), "negative": -rng.exponential(1e6, 77), "tiny": rng.random(50) * 1e-7,
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("one", None)]
    random.Random(0).shuffle(rows)
    probs = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]
    got = quantiles(make(rows, "g string, v double"), ["g"], F.col("v"), probs).collect()
    assert len(got) == len(groups)
    for r in got:
        assert np.allclose(r.quantiles, np.percentile(groups[r.g], np.array(probs) * 100), rtol=1e-12)


def test_quantiles_without_and_with_null_keys(make):
    df = make([(None, 1.0), (None, 2.0), ("a", 5.0)], "g string, v double")
    assert quantiles(df, [], F.col("v"), [0.5]).first().quantiles == [2.0]
    assert {r.g: r.quantiles for r in quantiles(df, ["g"], F.col("v"), [0.5]).collect()} == {
        None: [1.5], "a": [5.0]}


def test_quantiles_of_one_hot_value(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") * 1.0).alias("v"))
    local = [r.v for r in df.collect()]
    got = quantiles(df.repartition(7), [], F.col("v"), [0.1, 0.5, 0.9]).first().quantiles
    assert np.allclose(got, np.percentile(local, [10, 50, 90]))


@pytest.mark.parametrize("salts", [1, 3, 32])
def test_top_n_is_exact_for_any_division(spark, salts):
    df = spark.range(500).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"),
        (F.col("id") * 37 % 101).alias("x"), F.col("id").cast("string").alias("t")).repartition(9)
    got = {}
    for r in top_n_per_group(df, ["k"], [F.desc("x"), F.asc("t")], 4, salts=salts).collect():
        got.setdefault(r.k, []).append((r["rank"], r.x, r.t))
    want = {}
    for r in sorted(df.collect(), key=lambda r: (-r.x, r.t)):
        rows = want.setdefault(r.k, [])
        if len(rows) < 4:
            rows.append((len(rows) + 1, r.x, r.t))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_first_by_time_skips_nulls_and_breaks_ties(make):
    df = make([("a", "2024-01-01 00:00:00", "2", "x"), ("a", "2024-01-01 00:00:00", "1", "y"),
               ("a", "2023-01-01 00:00:00", "3", None), ("b", "2024-01-01 00:00:00", "1", None)],
              "g string, created_at string, ticket_id string, v string").withColumn(
        "created_at", F.col("created_at").cast("timestamp"))
    got = first_by_time(df, ["g"], {"v": F.col("v"), "w": F.upper("ticket_id")}, [F.count("*").alias("n")])
    assert sorted((r.g, r.n, r.v, r.w) for r in got.collect()) == [("a", 3, "y", "3"), ("b", 1, None, "1")]


def _ranked(rows):
    return sorted(rows, key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("sort_rows", [100_000, 5, 0])
def test_cut_keys_with_many_equal_times(spark, sort_rows):
    """Half of the tickets share one instant; small bounds force every narrowing step."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        at = 1704067200_000000 if i % 2 else 1704067200_000000 + rng.randrange(10**12)
        rows.append((f"T{rng.randrange(10**6):07d}-{i}", at))
    df = spark.createDataFrame(rows, "ticket_id string, at long").select(
        "ticket_id", F.timestamp_micros("at").alias("created_at"))
    order = [r[0] for r in _ranked(rows)]
    ranks = [1, 2, 75, 149, 150, 151, 210, 300]
    assert [k.ticket_id for k in split.cut_keys(df, ranks, sort_rows=sort_rows)] == [order[r - 1] for r in ranks]
    assert split.cut_keys(df, [0]) == [None]


@pytest.mark.parametrize("sort_rows", [100_000, 0])
@pytest.mark.parametrize("missing", [20, 80, 100])
def test_split_keeps_rows_without_time_or_id(spark, monkeypatch, missing, sort_rows):
    rows = [(None if i % 10 == 7 else f"T{i:03d}", None if i >= 100 - missing else 1704067200 + i * 3600) for i in range(100)]
    df = spark.createDataFrame(rows, "ticket_id string, at long").select(
        "ticket_id", F.timestamp_seconds("at").alias("created_at"), F.lit("p").alias("product"))
    monkeypatch.setattr(split, "cut_keys", lambda *a, f=split.cut_keys, **k: f(*a, sort_rows=sort_rows, **k))
    parts = split.temporal_split(df).collect()
    sizes = {s: sum(r.data_split == s for r in parts) for s in ("train", "val", "test")}
    # equal keys (no time and no identifier) can't be told apart and stay together
    together = sum(r.created_at is None and r.ticket_id is None for r in parts)
    assert sum(sizes.values()) == 100
    assert abs(sizes["train"] - 70) <= together and abs(sizes["val"] - 15) <= together
    order = {"train": 0, "val": 1, "test": 2}
    ranked = sorted(parts, key=lambda r: (r.created_at is None, str(r.created_at), r.ticket_id is None, r.ticket_id or ""))
    assert [order[r.data_split] for r in ranked] == sorted(order[r.data_split] for r in ranked)
    assert split.head_and_tail(df).count() >= 100 - together


@pytest.mark.parametrize(("low", "width"), [(1.7e9, 86_400 * 30), (100.0, 1.0), (0.0, 1e-9), (-5.0, 10.0)])
def test_close_values_spread_over_parts(spark, low, width):
    df = spark.range(20_000).select((F.lit(low) + F.rand(7) * F.lit(width)).alias("v"))
    part = scale._second_level(F.col("v"), F.col("low"), F.col("high"))
    sizes = (
        df.withColumn("b", scale._first_level(F.col("v")))
        .join(df.withColumn("b", scale._first_level(F.col("v"))).groupBy("b").agg(F.min("v").alias("low"), F.max("v").alias("high")), "b")
        .groupBy("b", part.alias("p")).agg(F.countDistinct("v").alias("n")).agg(F.max("n")).first()[0])
    assert sizes < 20
    values = sorted(r.v for r in df.collect())
    got = quantiles(df, [], F.col("v"), [0.1, 0.5, 0.99]).first().quantiles
    assert np.allclose(got, np.percentile(values, [10, 50, 99]), rtol=1e-12)


def test_bucket_is_monotone(spark):
    vs = sorted([0.0, 1e-9, -1e-9, 1e300, -1e300, 5.5, 5.5000001, -3.25, 1e-3, 1234567.0])
    got = [r.b for r in spark.createDataFrame([(v,) for v in vs], "v double").select(
        scale._first_level(F.col("v")).alias("b")).collect()]
    assert got == sorted(got)


def test_dealt_makes_even_parts_of_large_ones_only(spark):
    df = spark.range(1000).coalesce(1)
    few = scale.dealt(df, 1000)
    assert few is df
    sizes = [r["count"] for r in scale.dealt(df, 100).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 150 and sum(sizes) == 1000
    assert scale.dealt(spark.range(0), 10).count() == 0
