"""Every catalogue query against its oracle on whole tables."""

import os

import duckdb
import pytest

import harness
from plumbline.plans.catalog import QUERIES
from plumbline.plans.oracle import ORACLE

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con() -> duckdb.DuckDBPyConnection:
    return harness.duck(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    got = harness.spark_rows(QUERIES[name](spark, SF_DIR))
    want = harness.duck_rows(con, ORACLE[name])
    assert want[1], f"{name}: the oracle gives no rows"
    assert harness.difference(got, want) is None


def test_entry_runs(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert {"dataset_name", "partition_date", "status", "reason"} <= set(df.columns)
