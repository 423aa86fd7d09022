"""Shapes of physical plans that must hold at any scale."""

import re

import pytest
from pyspark.sql import functions as F

from plumbline.operators import profile, reports
from plumbline.plans import derived as d
from plumbline.plans.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.001"
WRITING = {"src_file_inventory", "src_format_detect", "src_parquet_partitioned", "store_rerun_roundtrip", "daily_run",
           "store_rerun_partial", "run_mixed_schemas", "run_with_bad_dataset"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITING))
def test_no_nested_loops_and_no_row_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    assert "NestedLoop" not in text and "CartesianProduct" not in text
    # only the walk over one type string per dataset runs in Python
    walks = ("json_nested_paths", "json_top_level_paths", "chk_dist_json", "chk_dist_json_levels")
    allowed = 2 if name in walks else 0
    assert len(re.findall("BatchEvalPython|ArrowEvalPython|MapInPandas", text)) <= allowed


def test_profiling_scans_once_and_aggregates_before_the_shuffle(spark):
    text = plan(QUERIES["profile_metrics"](spark, SF_DIR))
    assert text.count("FileScan parquet") == 1 and text.count("Exchange hashpartitioning") == 1
    assert text.count("partial_") > 0


def test_only_needed_columns_are_read(spark):
    text = plan(profile.row_counts(d.monitored(spark, SF_DIR)))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {x.split(":")[0] for x in schema.split(",")} == {"ts", "event_type"}


def test_latest_run_is_pruned_before_the_shuffle(spark):
    text = plan(reports.latest_run(d.active_runs(spark, SF_DIR)))
    assert "WindowGroupLimit" in text.split("Exchange hashpartitioning(dataset_name")[1]


def test_filters_reach_the_scan(spark):
    runs = d.runs(spark, SF_DIR).filter(F.col("run_id") == 17)
    assert "EqualTo(o_orderkey,17)" in plan(runs)
