"""The driver contract, and results against SQL on the smallest data."""

import pytest

import __spark_entry__ as e
from check_oracles import compare, connect

SF = "/root/testdata/sf0.001"
FAST = ["dq_report", "ingest_summary", "features_trailing", "error_codes", "rrf_fusion", "new_categories",
        "label_confusions", "train_augment", "satisfaction_summary", "parse_labels", "event_rollup"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90
    from caselight.plans.oracles import ORACLES
    assert set(ORACLES) <= set(e.oracle_sql())


def test_entry(spark):
    assert e.entry(spark).count() == 20


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, con, name):
    assert compare(e.queries()[name](spark, SF), con, e.oracle_sql()[name]) == ""
