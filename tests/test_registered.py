from __future__ import annotations

import pytest

import __spark_entry__ as registered
from pulsegauge.plans.oracles import ORACLES
from pulsegauge.plans.queries import QUERIES
from tests import oracle
from tests.conftest import SF_DIR

BATCH = [n for n in QUERIES if not n.startswith("stream_")]


@pytest.fixture(scope="module")
def con():
    connection = oracle.connect(SF_DIR)
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(registered.queries())


def test_entry_finds_anomalies(spark):
    df = registered.entry(spark)
    assert df.columns == ["event_id", "metric", "value", "timestamp", "z_score", "detected_at"]
    assert df.count() == 12


@pytest.mark.parametrize("name", BATCH)
def test_query_equals_sql(spark, con, name):
    columns, got = oracle.spark_rows(registered.queries()[name](spark, SF_DIR))
    expected_columns, expected = oracle.sql_rows(con, registered.oracle_sql()[name])
    assert columns == expected_columns
    assert got == expected
