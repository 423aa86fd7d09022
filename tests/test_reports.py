"""Reports on a small seeded history with known answers."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.functions import naming
from plumbline.operators import reports
from plumbline.sources import store

DAY = dt.date(2026, 4, 2)
FOREVER = dt.datetime(9999, 12, 31, 23, 59, 59)
SALES = "lob=retail/src_sys_nm=alpha/dataset=sales_daily"
SCHEMA = (
    "run_id bigint, dataset_name string, partition_date date, lookup_code string, check_status string, "
    "dqs_score decimal(5,2), rerun_number int, orchestration_run_id bigint, error_message string, "
    "create_date timestamp_ntz, expiry_date timestamp_ntz"
)


def run(i, name, day, code, status, score, rerun=0, orchestration=1, expiry=FOREVER):
    value = None if score is None else Decimal(score)
    return (i, name, day, code, status, value, rerun, orchestration, None, dt.datetime(2026, 4, 2, 6), expiry)


@pytest.fixture(scope="module")
def runs(spark):
    rows = [run(i, SALES, DAY - dt.timedelta(days=6 - i), "LOB_RETAIL", "PASS", "98.50") for i in range(7)]
    rows += [
        run(10, "lob=retail/src_sys_nm=alpha/dataset=products", DAY, "LOB_RETAIL", "FAIL", "45.00"),
        run(11, "lob=retail/src_sys_nm=alpha/dataset=customers", DAY, "LOB_RETAIL", "WARN", "72.00"),
        run(12, "lob=commercial/src_sys_nm=beta/dataset=transactions", DAY, "LOB_COMMERCIAL", "WARN", "60.00", 0, 2),
        run(13, "lob=commercial/src_sys_nm=beta/dataset=payments", DAY, "LOB_COMMERCIAL", "FAIL", "0.00", 0, 2),
        run(14, "src_sys_nm=omni/dataset=customer_profile", DAY, "LOB_LEGACY", "PASS", "95.00", 0, None),
        run(15, SALES, DAY, "LOB_RETAIL", "FAIL", "1.00", 5, 1, dt.datetime(2026, 4, 2, 7)),
    ]
    return store.active(spark.createDataFrame(rows, SCHEMA)).cache()


@pytest.fixture(scope="module")
def numerics(spark):
    volumes = [102345, 98721, 105612, 99988, 107234, 96103, 103876]
    rows = [(i, "VOLUME", "row_count", float(v)) for i, v in enumerate(volumes)]
    rows += [(6, "FRESHNESS", "hours_since_update", 2.0), (12, "FRESHNESS", "hours_since_update", 72.0),
             (13, "VOLUME", "row_count", 0.0), (10, "SCHEMA", "added_fields_count", 3.0),
             (11, "OPS", "null_rate_pct::x", 0.87), (14, "VOLUME", "row_count", 54321.0)]
    return spark.createDataFrame(rows, "run_id bigint, check_type string, metric_name string, metric_value double")


def details(spark, rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "detail_id bigint, run_id bigint, check_type string, detail_type string, detail_value string",
    )


def test_summary(runs):
    assert tuple(reports.summary_totals(runs).first()) == (6, 2, 2, 2)
    lobs = {r.lookup_code: r for r in reports.lob_summary(runs).collect()}
    assert {k: r.aggregate_score for k, r in lobs.items()} == {
        "LOB_RETAIL": 71.83, "LOB_COMMERCIAL": 30.0, "LOB_LEGACY": 95.0,
    }
    assert lobs["LOB_RETAIL"].dataset_count == 3
    last = reports.last_run(runs, F.lit("2026-04-03 00:00:00").cast("timestamp_ntz")).first()
    assert (last.last_run_at, last.run_failed, last.is_stale) == (DAY, True, True)


def test_trends(runs, numerics):
    trend = reports.dataset_trend(runs, "7d").filter(F.col("dataset_name") == SALES)
    assert trend.count() == 7 and {r.avg_score for r in trend.collect()} == {98.5}
    assert reports.dataset_trend(runs, "no such range").filter(F.col("dataset_name") == SALES).count() == 7
    lob = {r.day: r.avg_score for r in reports.lob_trend(runs).filter("lookup_code = 'LOB_RETAIL'").collect()}
    assert lob[DAY] == 71.83 and len(lob) == 7
    rows = {r.dataset_name: r for r in reports.trend_direction(runs, numerics).collect()}
    assert (rows[SALES].trend, rows[SALES].flagged_checks) == ("stable", "")
    assert rows["lob=commercial/src_sys_nm=beta/dataset=payments"].flagged_checks == "VOLUME"


def test_lob_datasets(runs, numerics):
    rows = {r.dataset_name: r for r in reports.lob_datasets(runs, numerics, "LOB_RETAIL").collect()}
    sales = rows[SALES]
    assert (sales.dataset_id, sales.freshness_status, sales.volume_status, sales.schema_status) == (6, "PASS", "PASS", None)
    assert sales.trend == ",".join(["98.5"] * 7)
    assert reports.lob_datasets(runs, numerics, "NOBODY").count() == 0


def test_dataset_detail(spark, runs, numerics):
    lobs = spark.createDataFrame(
        [("LOB_RETAIL", "Retail Banking", "team north", "Tier 1 Critical", FOREVER)],
        "lookup_code string, lob_name string, owner string, classification string, expiry_date timestamp_ntz",
    )
    parents = spark.createDataFrame([(1, "lob=retail/src_sys_nm=alpha")], "orchestration_run_id bigint, parent_path string")
    formats = details(spark, [(6, "SCHEMA", "eventAttribute_format", '"avro"')])
    row = reports.dataset_detail(runs, numerics, formats, parents, lobs, run_ids=[6]).collect()
    assert len(row) == 1
    row = row[0]
    assert row.hdfs_path == f"/prod/datalake/{SALES}/partition_date=20260402"
    assert (row.source_system, row.format, row.parent_path) == ("alpha", "Avro", "lob=retail/src_sys_nm=alpha")
    assert (row.row_count, row.previous_row_count, row.lob_name) == (103876.0, 96103.0, "Retail Banking")
    omni = reports.dataset_detail(runs, numerics, formats, parents, lobs, run_ids=[14]).first()
    assert (omni.format, omni.owner, omni.parent_path) == ("Unknown", "N/A", None)


def test_json_label(spark):
    df = spark.createDataFrame([('"avro"',), ("plain TEXT",), (None,), ("42",)], "v string")
    assert [r[0] for r in df.select(naming.json_label(F.col("v"))).collect()] == ["Avro", "Plain text", "Unknown", "42"]


def test_metrics_by_check(spark, runs, numerics):
    rows = details(spark, [(6, "SCHEMA", "schema_hash", "{}"), (6, "VOLUME", "volume_status", "{}")])
    got = {r.check_type: r for r in reports.metrics_by_check(runs, numerics, rows).filter("run_id = 6").collect()}
    assert sorted(got) == ["FRESHNESS", "SCHEMA", "VOLUME"]
    assert [m.metric_name for m in got["VOLUME"].numeric_metrics] == ["row_count"]
    assert got["SCHEMA"].numeric_metrics == [] and got["SCHEMA"].status == "PASS"


def test_search(runs):
    assert [r.dataset_name for r in reports.search(runs, "SRC_SYS_NM=").collect()][0].startswith("src_sys_nm=omni")
    assert reports.search(runs, "").count() == 0
    assert reports.search(runs, "100%").count() == 0
    assert reports.find_dataset(runs, "custom").first().run_id == 11


def test_executive(runs):
    months = reports.lob_monthly(runs, "2026-04-15").filter("lob_id = 'LOB_RETAIL'").orderBy("month").collect()
    assert [(r.month, r.avg_score) for r in months] == [("2026-03", 98.5), ("2026-04", 78.5)]
    pivot = reports.lob_monthly_pivot(runs, ["2026-03", "2026-04"], "2026-04-15").filter("lob_id = 'LOB_LEGACY'").first()
    assert (pivot.m_2026_03, pivot.m_2026_04) == (None, 95.0)
    sources = reports.source_accountability(runs).collect()
    assert [(r.src_sys_nm, r.dataset_count, r.avg_score) for r in sources] == [
        ("beta", 2, 30.0), ("alpha", 3, 71.83), ("omni", 1, 95.0),
    ]
    delta = {r.lob_id: r for r in reports.improvement_delta(runs, "2026-05-15").collect()}
    assert (delta["LOB_RETAIL"].baseline_score, delta["LOB_RETAIL"].current_score, delta["LOB_RETAIL"].delta) == (98.5, None, None)


def test_failures_and_comparison(spark, runs, numerics):
    failed = {r.dataset_name: r.check_types for r in reports.latest_failures(runs, numerics).collect()}
    assert failed == {"lob=retail/src_sys_nm=alpha/dataset=products": "SCHEMA",
                      "lob=commercial/src_sys_nm=beta/dataset=payments": "VOLUME"}
    lobs = {r.lob: (r.failure_count, r.total_datasets) for r in reports.failures_by_lob(runs).collect()}
    assert lobs == {"LOB_RETAIL": (1, 6), "LOB_COMMERCIAL": (1, 6)}
    ranked = reports.lob_compare(runs, numerics).orderBy("lob_rank").collect()
    assert [(r.lookup_code, r.failing_checks) for r in ranked] == [
        ("LOB_COMMERCIAL", "VOLUME"), ("LOB_RETAIL", "SCHEMA"), ("LOB_LEGACY", ""),
    ]
    rows = details(spark, [(10, "SCHEMA", "schema_status", "{}"), (10, "SCHEMA", "schema_hash", "{}"), (6, "OPS", "ops_status", "{}")])
    assert [tuple(r) for r in reports.run_check_failures(runs, rows).collect()] == [(1, "SCHEMA", 2)]
    assert reports.run_failed_datasets(runs).count() == 4


def test_display_helpers(spark, runs):
    header = reports.lob_header(runs).filter("lookup_code = 'LOB_RETAIL'").first()
    assert (header.avg_score, header.passing_rate, header.last_run) == (72, 33, DAY)
    worst = [(r.dataset_name.split("=")[-1], r.position) for r in reports.worst_first(runs).filter("lookup_code = 'LOB_RETAIL'").collect()]
    assert worst == [("products", 1), ("customers", 2), ("sales_daily", 3)]
    bands = spark.createDataFrame(
        [run(1, "d", DAY, None, "PASS", "80.00"), run(2, "d", DAY + dt.timedelta(days=1), None, "WARN", "60.00"),
         run(3, "d", DAY + dt.timedelta(days=3), None, "FAIL", "59.99")], SCHEMA)
    got = [(r.band, r.delta, r.direction) for r in reports.score_bands(bands).orderBy("partition_date").collect()]
    assert got == [("healthy", None, None), ("degraded", -20.0, "down"), ("critical", -0.01, "down")]


def test_source_names(spark):
    names = ["lob=a/src_sys_nm=x/dataset=y", "src_sys_nm=z", "lob=a/dataset=y", "src_sys_nm=/d"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    n = F.col("n")
    got = df.select(naming.source_system(n), naming.source_system_group(n), naming.source_system_label(n), naming.source_system_sql(n))
    assert [tuple(r) for r in got.collect()] == [
        ("x", "x", "x", "x"), ("z", None, "z", "z"), (None, None, "unknown", ""), (None, None, "", ""),
    ]
