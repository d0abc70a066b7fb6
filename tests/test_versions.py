"""Versions of tables and models, labelling that continues."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caselight.operators import relabel
from caselight.sources import versions

T0 = datetime(2024, 3, 1)


def test_a_failed_replace_leaves_the_version_before(spark, tmp_path):
    base = str(tmp_path)
    with pytest.raises(ValueError):
        versions.read_tables(spark, base, ["a"])
    versions.replace_tables(spark, base, {"a": spark.range(3), "b": spark.range(2)})
    broken = spark.range(5).select(F.raise_error(F.lit("cut off")).alias("id"))
    with pytest.raises(Exception, match="cut off"):
        versions.replace_tables(spark, base, {"a": spark.range(9), "b": broken})
    assert [t.count() for t in versions.read_tables(spark, base, ["a", "b"])] == [3, 2]
    a, b = versions.read_tables(spark, base, ["a", "b"])
    versions.replace_tables(spark, base, {"a": a.union(b), "b": b})  # from the version before
    assert [t.count() for t in versions.read_tables(spark, base, ["a", "b"])] == [5, 2]
    assert a.count() == 3  # an open reader keeps its version


def test_one_active_version_per_model(spark, tmp_path):
    path = f"{tmp_path}/models"
    assert versions.model_versions(spark, path).count() == 0
    rows = [("m", f"{k}", T0 + timedelta(days=k)) for k in range(3)] + [("other", "1", T0)]
    models = spark.createDataFrame(rows, "model_name string, version string, trained_at timestamp")
    versions.record_models(models, path, activate=False)
    active = lambda: sorted((r.model_name, r.version) for r in versions.model_versions(spark, path).filter("is_active").collect())
    assert active() == []
    versions.record_models(models.filter("version = '2'").withColumn("metrics", F.create_map(F.lit("f1"), F.lit(0.5))), path)
    assert active() == [("m", "2")]
    versions.record_models(models.filter("model_name = 'm' and version = '0'"), path)  # back to an older one
    assert active() == [("m", "0")]
    facts = {(r.model_name, r.version): r for r in versions.model_versions(spark, path).collect()}
    assert len(facts) == 4 and facts["m", "2"].metrics == {"f1": 0.5} and facts["m", "1"].trained_at == T0 + timedelta(days=1)


def test_labelling_continues_where_it_was_cut_off(spark, tmp_path):
    tickets = spark.createDataFrame([(str(i), "Data Issue") for i in range(60)], "ticket_id string, category string")
    answer = F.when(F.col("ticket_id").cast("int") % 10 > 0, F.lit('{"subcategory": "Corruption"}'))
    asked = []

    def labeler(rows):
        asked.append(rows.count())
        if len(asked) == 3:
            raise RuntimeError("client gone")
        return rows.withColumn("raw", answer)

    base = f"{tmp_path}/cut"
    with pytest.raises(RuntimeError):
        relabel.label_in_chunks(tickets, base, labeler, 20, retries=0)
    assert 0 < relabel.read_labels(spark, base).count() < 60
    first = sum(asked[:2])
    del asked[:]
    rows = relabel.label_in_chunks(tickets.limit(0), base, lambda r: (asked.append(r.count()), r.withColumn("raw", answer))[1], 20, retries=0)
    assert first + sum(asked) == 60  # nothing that was finished is asked again
    whole = relabel.label_in_chunks(tickets, f"{tmp_path}/whole", lambda r: r.withColumn("raw", answer), 20, retries=0)
    key = lambda d: sorted(map(str, d.collect()))
    assert key(rows) == key(whole) and whole.filter("status = 'api_fail'").count() == 6


def test_missing_answers_are_asked_again(spark, tmp_path):
    tickets = spark.createDataFrame([(str(i), "Data Issue") for i in range(12)], "ticket_id string, category string")
    calls = []

    def labeler(rows):
        calls.append(rows.count())
        ok = F.col("ticket_id").cast("int") < 4 * len(calls)
        return rows.withColumn("raw", F.when(ok, F.lit('{"subcategory": "Corruption"}')))

    out = relabel.label_in_chunks(tickets, str(tmp_path), labeler, 100, retries=1)
    assert calls == [12, 8]
    assert sorted((r.status, r.attempts) for r in out.collect()) == [("api_fail", 2)] * 4 + [("success", 1)] * 4 + [("success", 2)] * 4
