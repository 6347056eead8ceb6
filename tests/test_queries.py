"""Every registered query against its SQL twin, over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from emberline.plans import catalog, oracles

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(oracles.oracle_sql())
    assert set(catalog.queries()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, oracle, name):
    got = contract.queries()[name](spark, SF)
    columns = sorted(got.columns)
    text = contract.oracle_sql()[name]
    assert columns == sorted(oracle.sql(text).columns)
    expected = oracle.sql(f"select {', '.join(columns)} from ({text}) t").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))


def test_entry(spark):
    assert {r["intensity"] for r in contract.entry(spark).collect()} <= {"low", "moderate", "high", "extreme", "unknown"}


@pytest.mark.parametrize("name", ["hotspot_lookback", "layer_last_good", "fwi_layer", "perimeters_unified"])
def test_results_do_not_depend_on_the_session_zone(spark, oracle, name):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        test_query_matches_oracle(spark, oracle, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
