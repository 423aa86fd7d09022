import datetime as dt

from pyspark.sql import functions as F

from plumbline.operators import baseline, checks, json_paths, profile

DAY = dt.date(2026, 3, 30)
KEY = "dataset_name string, partition_date date"


def keyed(rows, name="d", day=DAY):
    return [(name, day, *r) for r in rows]


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_null_and_blank_rates(spark):
    rows = keyed([(1, "a"), (None, ""), (3, "   "), (4, "b")])
    rates = profile.null_rates(spark.createDataFrame(rows, f"{KEY}, id bigint, status string"))
    assert by(rates, "column_name", "null_rate_pct") == {"id": 25.0, "status": 0.0}
    assert by(rates, "column_name", "empty_rate_pct") == {"id": None, "status": 50.0}


def test_odd_column_names(spark):
    df = spark.createDataFrame(keyed([(1, None)]), f"{KEY}, `a.b` bigint, `c``d` string")
    assert by(profile.null_rates(df), "column_name", "null_rate_pct") == {"a.b": 0.0, "c`d": 100.0}
    assert by(profile.column_stats(df), "column_path", "mean") == {"a.b": 1.0}


def test_column_stats_choose_numeric_types(spark):
    df = spark.createDataFrame(
        keyed([(1, 100.0, 7, "x"), (2, 150.0, 7, "y"), (3, 200.0, None, "z")]),
        f"{KEY}, id bigint, amount double, tiny tinyint, note string",
    )
    stats = profile.column_stats(df)
    assert by(stats, "column_path", "mean") == {"id": 2.0, "amount": 150.0}
    row = stats.filter("column_path = 'amount'").first()
    assert (row.sample_count, row.p50, row.p95) == (3, 150.0, 200.0)


def test_all_null_column_has_zero_stats(spark):
    df = spark.createDataFrame(keyed([(None,), (None,)]), f"{KEY}, amount double")
    row = profile.column_stats(df).first()
    assert (row.mean, row.stddev, row.p50, row.p95, row.sample_count) == (0.0, 0.0, 0.0, 0.0, 0)


def test_staleness_of_text_timestamps(spark):
    rows = keyed([("2026-03-30 10:00:00",), ("junk",), ("2026-03-30 08:00:00",)])
    df = spark.createDataFrame(rows, f"{KEY}, source_event_timestamp string")
    at = F.lit("2026-03-30 12:00:00.900").cast("timestamp_ntz")
    assert profile.staleness(df, "source_event_timestamp", at).first().hours_since_update == 2.0
    early = F.lit("2026-03-30 01:00:00").cast("timestamp_ntz")
    assert profile.staleness(df, "source_event_timestamp", early).first().hours_since_update == 0.0
    bad = spark.createDataFrame(keyed([("junk",)]), f"{KEY}, source_event_timestamp string")
    out = checks.freshness_status(profile.staleness(bad, "source_event_timestamp", at)).first()
    assert (out.status, out.reason) == ("NOT_RUN", "no_parseable_timestamps")
    none = checks.missing_freshness_column(bad.select("dataset_name", "partition_date").distinct()).first()
    assert (none.status, none.reason) == ("NOT_RUN", "missing_source_event_timestamp")


def test_timestamp_sanity_limits(spark):
    at = dt.datetime
    rows = keyed([
        (at(2026, 3, 31, 0, 0, 0), DAY), (at(2026, 3, 31, 0, 0, 1), DAY),
        (at(2016, 3, 30, 0, 0, 0), DAY), (at(2016, 3, 29, 23, 59, 59), dt.date(2016, 3, 29)), (None, None),
    ])
    df = spark.createDataFrame(rows, f"{KEY}, event_ts timestamp_ntz, created date")
    judged = {r.column_name: r for r in checks.timestamp_sanity_status(profile.timestamp_sanity(df)).collect()}
    ts, day = judged["event_ts"], judged["created"]
    assert (ts.non_null_rows, ts.future_count, ts.stale_count, ts.status) == (4, 1, 1, "FAIL")
    assert (day.future_pct, day.stale_pct, day.status) == (0.0, 0.25, "FAIL")
    summary = checks.timestamp_sanity_summary(checks.timestamp_sanity_status(profile.timestamp_sanity(df))).first()
    assert (summary.status, summary.total_columns_analyzed, summary.failed_columns) == ("FAIL", 2, 2)


def test_all_null_timestamps_pass(spark):
    df = spark.createDataFrame(keyed([(None,)]), f"{KEY}, event_ts timestamp_ntz")
    row = checks.timestamp_sanity_status(profile.timestamp_sanity(df)).first()
    assert (row.future_pct, row.stale_pct, row.status) == (0.0, 0.0, "PASS")


def test_no_column_to_look_at(spark):
    parts = spark.createDataFrame([("d", DAY)], KEY)
    empty = spark.createDataFrame([], f"{KEY}, column_path string, status string")
    row = checks.distribution_summary(empty, parts).first()
    assert (row.status, row.reason, row.total_columns_analyzed) == ("PASS", "no_numeric_columns", 0)
    row = checks.timestamp_sanity_summary(empty, parts).first()
    assert (row.status, row.reason) == ("PASS", "no_timestamp_columns")


def test_baseline_ignores_nulls_and_uses_population_stddev(spark):
    rows = [("d", "X", "m", DAY + dt.timedelta(days=i), v) for i, v in enumerate([2.0, None, 4.0, 9.0])]
    df = spark.createDataFrame(
        rows, "dataset_name string, check_type string, metric_name string, partition_date date, metric_value double"
    )
    last = baseline.rolling_baseline(df).orderBy(F.desc("partition_date")).first()
    assert (last.baseline_mean, last.baseline_stddev, last.baseline_count) == (3.0, 1.0, 2)


def test_baseline_takes_thirty_rows(spark):
    rows = [("d", DAY + dt.timedelta(days=i), 1000 if i == 0 else 10) for i in range(32)]
    df = spark.createDataFrame(rows, f"{KEY}, row_count bigint")
    last = checks.volume_status(df).orderBy(F.desc("partition_date")).first()
    assert (last.baseline_mean, last.baseline_count, last.pct_change) == (10.0, 30, 0.0)


def test_zero_rows_need_the_expected_partitions(spark):
    counts = spark.createDataFrame([("d", DAY, 5), ("d", DAY + dt.timedelta(days=2), 1)], f"{KEY}, row_count bigint")
    out = checks.zero_row_status(profile.expected_partitions(counts), counts)
    assert by(out, "partition_date", "status") == {
        DAY: "PASS", DAY + dt.timedelta(days=1): "FAIL", DAY + dt.timedelta(days=2): "PASS",
    }


def test_first_anomaly_in_schema_order_names_the_reason(spark):
    days = [DAY + dt.timedelta(days=i) for i in range(4)]
    rows = [("d", day, "a", 0, 1.0) for day in days[:3]] + [("d", day, "b", 1, 1.0) for day in days[:3]]
    rows += [("d", days[3], "a", 0, 4.0), ("d", days[3], "b", 1, 90.0)]
    df = spark.createDataFrame(rows, f"{KEY}, column_name string, column_ordinal int, null_rate_pct double")
    last = checks.ops_status(df).filter(F.col("partition_date") == days[3]).first()
    assert (last.status, last.reason, last.flagged_columns) == ("FAIL", "above_fail_threshold", 2)
    first = checks.ops_status(df).filter(F.col("partition_date") == days[0]).first()
    assert (first.status, first.reason) == ("PASS", "baseline_unavailable")


def paths(spark, rows, level):
    df = spark.createDataFrame(keyed([(r,) for r in rows]), f"{KEY}, attr string")
    return sorted(r.column_path for r in json_paths.numeric_paths(df, "attr", level).collect())


def test_json_levels(spark):
    rows = ['{"amount": 100.0, "name": "x", "details": {"price": 5, "deep": {"n": 1}}, "list": [1, 2]}',
            '{"amount": 7, "details": {"price": 2.5}}', "not json", None]
    assert paths(spark, rows, json_paths.OFF) == []
    assert paths(spark, rows, json_paths.TOP_LEVEL) == ["attr.amount"]
    assert paths(spark, rows, json_paths.ALL) == ["attr.amount", "attr.details.deep.n", "attr.details.price"]


def test_json_paths_with_text_values_or_odd_keys(spark):
    assert paths(spark, ['{"a": 1}', '{"a": "x"}'], json_paths.ALL) == []
    assert paths(spark, ['{"a b": 1, "c,d": 2, "e`f": 3, "g>": {"h": 4}}'], json_paths.ALL) == [
        "attr.a b", "attr.c,d", "attr.e`f", "attr.g>.h",
    ]
    assert paths(spark, ["junk"], json_paths.ALL) == []


def test_json_leaf_values(spark):
    df = spark.createDataFrame(
        keyed([('{"a": {"b c": 2}}',), ('{"a": {"b c": 4}}',), ("bad",), ('{"a": {"b c": "x"}}',)]),
        f"{KEY}, attr string",
    )
    sources = json_paths.leaf_sources("attr", [["a", "b c"]])
    row = profile.column_stats(df, columns=[], sources=sources).first()
    assert (row.column_path, row.mean, row.sample_count) == ("attr.a.b c", 3.0, 2)


def test_latest_column_stats_split_at_the_last_dot(spark):
    rows = [("d", DAY + dt.timedelta(days=i), "DISTRIBUTION", f"a.b.{s}", v)
            for i, (m, sd) in enumerate([(1.0, 2.0), (3.0, 4.0)]) for s, v in (("mean", m), ("stddev", sd))]
    df = spark.createDataFrame(rows, f"{KEY}, check_type string, metric_name string, metric_value double")
    got = baseline.latest_column_stats(df).collect()
    assert [(r.column_path, r.baseline_mean, r.baseline_stddev, r.baseline_p50) for r in got] == [("a.b", 1.0, 2.0, 0.0)]


def test_json_statistics_follow_mixed_and_deep_shapes(spark):
    rows = [("d", t) for t in (
        '{"a": 1, "b": {"c": 2.5, "d": [1]}, "e": null, "f": "5", "g": {}}', "junk", None, '{"m": {"x": 1}}', '{"m": 3, "b": {"c": null}}',
        '{"deep": {"a": {"b": {"c": {"d": {"e": {"f": 7}}}}}}}')] + [("list", "[1]"), ("list", '{"a": 1}')]
    df = spark.createDataFrame(rows, "dataset_name string, t string").withColumn("partition_date", F.lit("2024-01-01").cast("date"))
    got = {(r.dataset_name, r.column_path): (r.mean, r.sample_count) for r in json_paths.leaf_stats(df, ["t"]).collect()}
    # m is a number in one row and an object in another, the texts of "list" are not all objects
    assert got == {("d", "t.a"): (1.0, 1), ("d", "t.b.c"): (2.5, 1), ("d", "t.deep.a.b.c.d.e.f"): (7.0, 1)}
    assert sorted(r.column_path for r in json_paths.numeric_paths(df, ["t"]).collect()) == sorted(p for _, p in got)
    plan = json_paths._opened(df, ["t"], None, ["dataset_name"], 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate variant_explode") == 4 and plan.count("parseJson") == 1 and "Python" not in plan


def test_sketches_merge_over_days_and_reruns(spark):
    from plumbline.operators import sketches

    df = spark.range(60_000).selectExpr("concat('d', id % 2) AS dataset_name", "date_add(date'2026-01-01', cast(id % 30 AS int)) AS partition_date",
                                        "cast(pmod(hash(id), 1000003) AS double) AS x", "cast(NULL AS double) AS empty")
    days = sketches.column_sketches(df)
    assert days.count() == 2 * 15 * 2 and max(len(r.sketch) for r in days.collect()) < 40_000
    got = {(r.dataset_name, r.column_path): r for r in sketches.quantiles(sketches.merged(days, ["dataset_name"]), {"p50": 0.5, "p95": 0.95}).collect()}
    for name in ("d0", "d1"):
        values = sorted(r.x for r in df.filter(F.col("dataset_name") == name).select("x").collect())
        row = got[(name, "x")]
        assert row.sample_count == len(values)
        for p, q in ((0.5, row.p50), (0.95, row.p95)):
            rank = sum(v <= q for v in values) / len(values)
            assert abs(rank - p) <= sketches.RANK_ERROR
        assert (got[(name, "empty")].p50, got[(name, "empty")].sample_count) == (None, 0)
    plan = sketches.column_sketches(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ObjectHashAggregate") + plan.count("SortAggregate") == 2 and plan.count("Exchange") == 1
