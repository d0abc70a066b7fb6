"""Sketches that merge over days, and encodings that see earlier labels only."""

from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from caselight.operators import drift, learning, sketches

T0 = datetime(2024, 3, 1)


def test_merged_days_stay_within_the_bounds(spark):
    random = np.random.default_rng(2)
    rows = [(str(i), T0 + timedelta(hours=i // 4) if i % 50 else None, float(x), int(x) % 7, "x") for i, x in enumerate(random.lognormal(3, 2, 6000))]
    t = spark.createDataFrame(rows, "ticket_id string, created_at timestamp, a double, b int, n string")
    t = t.withColumn("a", F.when(F.col("ticket_id") != "5", F.col("a")).otherwise(F.lit(float("nan"))))
    daily = sketches.daily_sketches(t, ["a", "b"])
    assert daily.agg(F.sum("n")).first()[0] == 2 * 6000 - 1
    whole = sketches.merged(daily)
    errors = {r.feature: r for r in sketches.sketch_errors(t, whole, ["a", "b"], [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]).collect()}
    assert set(errors) == {"a", "b"}
    assert all(r.rank_error <= sketches.RANK_ERROR and r.distinct_error <= sketches.DISTINCT_ERROR for r in errors.values())
    week = sketches.merged(daily.filter(F.col("day").between("2024-03-02", "2024-03-08")))
    assert {r.feature: r.n for r in week.collect()} == {f: t.filter(F.to_date("created_at").between("2024-03-02", "2024-03-08")).filter("not isnan(a)" if f == "a" else "true").count() for f in "ab"}
    edges = sketches.sketched_edges(whole)
    shifted = t.withColumn("a", F.col("a") * 1.5)
    exact = {r.feature: r.psi for r in drift.psi_table(t, shifted, ["a", "b"]).collect()}
    frozen = {r.feature: r.psi for r in drift.psi_table(t, shifted, ["a", "b"], edges=edges).collect()}
    assert all(abs(exact[f] - frozen[f]) < 0.02 for f in exact)
    assert sketches.merged(sketches.daily_sketches(t.limit(0), ["a"])).count() == 0


def test_encoding_sees_earlier_labels_only(spark):
    random = np.random.default_rng(3)
    rows = [(f"{i:03}", T0 + timedelta(minutes=int(random.integers(0, 600))) if i % 9 else None, ["A", "B", None][i % 3], int(random.integers(0, 2)) if i % 7 else None) for i in range(200)]
    t = spark.createDataFrame(rows, "ticket_id string, created_at timestamp, product string, y int")
    got = {r.ticket_id: r for r in learning.ordered_encoding(t, F.col("y"), ["product"], prior=0.3, weight=2.0).collect()}
    assert len(got) == 200
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or T0, r[0]))
    for at, (ident, _, product, _) in enumerate(order):
        before = [y for _, _, p, y in order[:at] if p == product and y is not None]
        assert got[ident].n_before == len(before)
        assert abs(got[ident].encoded - (sum(before) + 0.6) / (len(before) + 2)) < 1e-12
    table = {r.value: r.encoded for r in learning.target_encoding(t, F.col("y"), ["product"], prior=0.3, weight=2.0).collect()}
    ys = [y for _, _, p, y in rows if p == "A" and y is not None]
    assert abs(table["A"] - (sum(ys) + 0.6) / (len(ys) + 2)) < 1e-12
