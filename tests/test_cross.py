import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cross
from plumbline.plans import derived as d

DAY = dt.date(2026, 3, 30)


def runs(spark, *rows):
    data = [(n, DAY - dt.timedelta(days=back), None if s is None else Decimal(s), st) for n, back, s, st in rows]
    return spark.createDataFrame(
        data, "dataset_name string, partition_date date, dqs_score decimal(5,2), check_status string"
    )


def on_day(df):
    return {r.dataset_name: r for r in df.filter(F.col("partition_date") == DAY).collect()}


def test_source_health_window(spark):
    got = on_day(cross.source_health(runs(
        spark, ("src_sys_nm=a/x", 0, "70.00", "WARN"), ("src_sys_nm=a/y", 7, "80.00", "PASS"),
        ("src_sys_nm=a/y", 8, "0.00", "FAIL"), ("src_sys_nm=b", 0, "10.00", "FAIL"), ("plain", 0, "10.00", "FAIL"),
    )))
    assert (got["src_sys_nm=a/x"].aggregate_score, got["src_sys_nm=a/x"].dataset_count) == (75.0, 2)
    assert got["src_sys_nm=a/x"].status == "PASS"
    assert got["src_sys_nm=b"].reason == "no_history_available"
    assert got["plain"].reason == "no_source_system_segment"


@pytest.mark.parametrize("score, status", [("59.99", "FAIL"), ("60.00", "WARN"), ("74.99", "WARN"), ("75.00", "PASS")])
def test_source_health_limits(spark, score, status):
    assert on_day(cross.source_health(runs(spark, ("src_sys_nm=a/x", 0, score, "X"))))["src_sys_nm=a/x"].status == status


def test_correlation(spark):
    got = on_day(cross.correlation(runs(
        spark,
        ("src_sys_nm=a/1", 8, "90.00", "PASS"), ("src_sys_nm=a/1", 0, "79.99", "WARN"),
        ("src_sys_nm=a/2", 1, "90.00", "PASS"), ("src_sys_nm=a/2", 0, "80.00", "PASS"),
        ("src_sys_nm=a/3", 9, "90.00", "PASS"), ("src_sys_nm=a/3", 0, "10.00", "FAIL"),
        ("src_sys_nm=a/4", 0, None, "UNKNOWN"),
    )))
    row = got["src_sys_nm=a/1"]
    assert (row.correlated_dataset_count, row.total_dataset_count, row.status) == (1, 3, "WARN")


def test_lineage(spark):
    got = on_day(cross.lineage(runs(
        spark, ("src_sys_nm=a/1", 0, "10.00", "FAIL"), ("src_sys_nm=b/1", 0, "60.00", "WARN"),
        ("src_sys_nm=c/1", 0, "59.99", "WARN"), ("plain", 0, "90.00", "PASS"),
    )))
    assert (got["src_sys_nm=a/1"].upstream_dataset_count, got["src_sys_nm=a/1"].upstream_failed_count) == (3, 1)
    assert got["src_sys_nm=b/1"].status == "WARN"
    alone = on_day(cross.lineage(runs(spark, ("src_sys_nm=a/1", 0, "10.00", "FAIL"))))
    assert alone["src_sys_nm=a/1"].reason == "no_upstream_datasets"


def test_cross_destination(spark):
    got = on_day(cross.cross_destination(runs(
        spark, ("a", 0, "80.00", "PASS"), ("a", 0, "50.00", "WARN"),
        ("b", 0, "80.00", "PASS"), ("b", 0, "49.00", "FAIL"), ("c", 0, "80.00", "PASS"), ("c", 0, None, "UNKNOWN"),
        ("e", 0, "80.00", "PASS"), ("e", 0, "80.00", "PASS"), ("e", 0, "20.00", "FAIL"),
    )))
    assert (got["a"].status, got["a"].max_deviation) == ("PASS", 15.0)
    assert (got["b"].status, got["b"].inconsistent_destination_count) == ("FAIL", 2)
    assert got["c"].reason == "single_destination"
    assert (got["e"].destination_count, got["e"].mean_score, got["e"].inconsistent_destination_count) == (3, 60.0, 3)


def hours(spark, values, name="d"):
    rows = [(name, DAY - dt.timedelta(days=len(values) - 1 - i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "dataset_name string, partition_date date, hours_since_update double")


@pytest.mark.parametrize(
    "last, status", [(16, "FAIL"), (14, "WARN"), (11.3, "WARN"), (11.2, "PASS"), (5, "PASS")]
)
def test_inferred_sla(spark, last, status):
    history = [8, 12, 8, 12, 8, 12]          # mean 10, sigma 2
    row = on_day(cross.inferred_sla(hours(spark, [*history, last]), d.enrichment(spark)))["d"]
    assert (row.inferred_sla_hours, row.data_points, row.status) == (14.0, 6, status)


@pytest.mark.parametrize("values, status", [
    ([44, 26, 6, 48, 10, 14, 26, 2, 48, 25, 46], "PASS"),    # exactly 80 % of 24.9 + 2 * 16.3
    ([44, 26, 6, 48, 10, 14, 26, 2, 48, 25, 46.0001], "WARN"),
    ([0.1] * 11, "WARN"),                                    # exactly the limit
])
def test_inferred_sla_ties(spark, values, status):
    assert on_day(cross.inferred_sla(hours(spark, values), d.enrichment(spark)))["d"].status == status


def test_inferred_sla_needs_points_and_no_explicit_sla(spark):
    row = on_day(cross.inferred_sla(hours(spark, [1] * 6), d.enrichment(spark)))["d"]
    assert (row.reason, row.data_points, row.inferred_sla_hours) == ("insufficient_history", 6, None)
    explicit = cross.inferred_sla(hours(spark, [1] * 9, "lob=commercial/x"), d.enrichment(spark))
    assert explicit.count() == 0


def test_sla_countdown_truncates_hours(spark):
    parts = spark.createDataFrame([("lob=commercial/x", DAY), ("nobody", DAY)], "dataset_name string, partition_date date")
    at = F.lit("2026-03-30 12:59:59").cast("timestamp_ntz")
    rows = cross.sla_countdown(parts, d.enrichment(spark), at).collect()
    assert [(r.dataset_name, r.hours_remaining, r.status) for r in rows] == [("lob=commercial/x", 1.0, "WARN")]
    late = F.lit("2026-03-30 14:00:00").cast("timestamp_ntz")
    assert cross.sla_countdown(parts, d.enrichment(spark), late).first().status == "FAIL"
    ahead = F.lit("2026-03-29 23:30:00").cast("timestamp_ntz")
    assert cross.sla_countdown(parts, d.enrichment(spark), ahead).first().hours_remaining == 13.0
