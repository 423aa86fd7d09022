import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from plumbline.plans import daily_run as daily, derived as d
from plumbline.operators import profile
from plumbline.session import scratch_folder
from plumbline.sources import files, store

DAY = dt.date(2026, 3, 30)
FOREVER = dt.datetime(9999, 12, 31, 23, 59, 59)
AT = dt.datetime(2026, 3, 31, 1)


def touch(path, text="x"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture()
def tree():
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    base = f"{root}/partition_date=20260330"
    touch(f"{base}/src_sys_nm=cb10/part-0.avro")
    touch(f"{base}/src_sys_nm=cb10/part-1.parquet")
    touch(f"{base}/src_sys_nm=p q/part-0.parquet")
    touch(f"{base}/src_sys_nm=text/notes.csv")
    touch(f"{base}/src_sys_nm=hidden/_SUCCESS")
    touch(f"{base}/src_sys_nm=hidden/.part.crc")
    touch(f"{base}/src_sys_nm=deep/sub/part-0.parquet")
    touch(f"{base}/_temporary/part-0.parquet")
    touch(f"{base}/other=x/part-0.parquet")
    os.makedirs(f"{base}/src_sys_nm=empty")
    touch(f"{root}/partition_date=20260331/src_sys_nm=cb10/part-0.parquet")
    return root


def test_discovery(spark, tree):
    found = {r.raw_code: r for r in files.datasets(files.inventory(spark, tree, [DAY])).collect()}
    assert {k: r.format for k, r in found.items()} == {"cb10": "AVRO", "p q": "PARQUET", "text": "UNKNOWN"}
    assert (found["text"].status, found["text"].reason) == ("NOT_RUN", "unsupported_format")
    assert found["cb10"].dataset_name == "src_sys_nm=cb10" and found["cb10"].partition_date == DAY
    assert (found["cb10"].file_count, found["cb10"].total_bytes, found["cb10"].status) == (2, 2, None)
    assert files.datasets(files.inventory(spark, tree)).count() == 4
    assert files.inventory(spark, tree, [dt.date(1999, 1, 1)]).count() == 0


def test_discovery_enriches_codes(spark, tree):
    table = spark.createDataFrame(
        [(1, "src_sys_nm=cb1_", "CB", FOREVER)],
        "id bigint, dataset_pattern string, lookup_code string, expiry_date timestamp_ntz",
    )
    found = files.datasets(files.inventory(spark, tree, [DAY]), table)
    assert {r.raw_code: r.lookup_code for r in found.collect()} == {"cb10": "CB", "p q": "p q", "text": "text"}


def test_read_prunes_partitions(spark):
    folder = scratch_folder(spark)
    rows = [(DAY + dt.timedelta(days=i % 2), f"00{i % 3}", i) for i in range(12)]
    files.write_partitions(spark.createDataFrame(rows, "partition_date date, src_sys_nm string, v int"), folder)
    df = files.read_partitions(spark, folder, [DAY, dt.date(1999, 1, 1)])
    assert df.count() == 6
    assert {r.partition_date for r in df.collect()} == {DAY}
    assert {r.dataset_name for r in df.collect()} == {"src_sys_nm=000", "src_sys_nm=001", "src_sys_nm=002"}
    one = files.read_partitions(spark, folder, sources=["001"])
    assert {r.dataset_name for r in one.collect()} == {"src_sys_nm=001"} and one.count() == 4
    assert "src_sys_nm" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    with pytest.raises(KeyError):
        files.read_partitions(spark, folder, file_format="UNKNOWN")


def test_avro_route(spark):
    folder = scratch_folder(spark)
    try:
        spark.range(1).write.format("avro").save(f"{folder}/partition_date=20260330/src_sys_nm=a")
    except Exception as error:
        if "avro" in str(error).lower():
            pytest.skip("the avro module is not on the class path")
        raise
    assert files.read_partitions(spark, folder, file_format=files.AVRO).count() == 1


RUN_SCHEMA = "run_id bigint, dataset_name string, partition_date date, rerun_number int, expiry_date timestamp_ntz"


def history(spark):
    runs = spark.createDataFrame(
        [(1, "a", DAY, 0, AT), (2, "a", DAY, 1, FOREVER), (3, "b", DAY, 0, FOREVER)], RUN_SCHEMA)
    metrics = spark.createDataFrame(
        [(1, "m", AT), (2, "m", FOREVER), (2, "n", AT), (3, "m", FOREVER)],
        "run_id bigint, metric_name string, expiry_date timestamp_ntz")
    targets = spark.createDataFrame([("a", DAY), ("new", DAY)], "dataset_name string, partition_date date")
    return runs, metrics, targets


def test_rerun(spark):
    runs, metrics, targets = history(spark)
    at = dt.datetime(2026, 4, 1)
    expired = {r.run_id: (r.expiry_date, r.next_rerun_number) for r in store.expire_runs(runs, targets, at).collect()}
    assert expired == {1: (AT, None), 2: (at, 2), 3: (FOREVER, None)}
    rows = sorted((r.run_id, r.metric_name, r.expiry_date) for r in store.expire_metrics(metrics, runs, targets, at).collect())
    assert rows == [(1, "m", AT), (2, "m", at), (2, "n", AT), (3, "m", FOREVER)]
    numbers = {r.dataset_name: (r.previous_rerun_number, r.rerun_number) for r in store.rerun_numbers(runs, targets).collect()}
    assert numbers == {"a": (1, 2), "new": (None, 1)}
    following = {r.dataset_name: r.next_rerun_number for r in store.next_rerun_numbers(runs, targets).collect()}
    assert following == {"a": 2, "new": 0}


def test_orchestration(spark):
    started = store.start_orchestration(spark, ["p/a", "p/b"], dt.datetime(2026, 3, 30, 3)).collect()
    assert {r.run_status for r in started} == {"running"} and len({r.orchestration_run_id for r in started}) == 2
    rows = [(1, "PASS", FOREVER), (1, "WARN", FOREVER), (1, "FAIL", AT), (2, "FAIL", FOREVER), (None, "FAIL", FOREVER)]
    df = spark.createDataFrame(rows, "orchestration_run_id bigint, check_status string, expiry_date timestamp_ntz")
    got = {r.orchestration_run_id: r for r in store.orchestration_rollup(df).collect()}
    assert (got[1].run_status, got[1].total_datasets, got[1].passed_datasets) == ("completed", 2, 1)
    assert (got[2].run_status, got[2].failed_datasets) == ("completed_with_errors", 1)


def monitored(spark, days, value=1.0):
    rows = [("lob=retail/src_sys_nm=alpha/dataset=click", DAY + dt.timedelta(days=i), j, value,
             f"{DAY + dt.timedelta(days=i)} 0{j % 9}:00:00") for i in days for j in range(20)]
    return spark.createDataFrame(
        rows, "dataset_name string, partition_date date, id int, value double, source_event_timestamp string")


def test_daily_run_with_history_and_rerun(spark):
    clock = profile.per_partition_clock(30)
    def go(m, **options):
        folder = scratch_folder(spark)
        fams = profile.default_families(m, freshness_column="source_event_timestamp", as_of=clock)
        daily.run(spark, m, folder, families=fams, enrichment=d.enrichment(spark),
                  at=F.lit("2026-04-01 06:00:00").cast("timestamp_ntz"), **options)
        return folder

    first = go(monitored(spark, range(4)))
    numerics = store.read_table(spark, first, store.NUMERICS)
    keys = ["run_id", "check_type", "metric_name", "expiry_date"]
    assert numerics.groupBy(*keys).count().filter("count > 1").count() == 0
    assert numerics.filter(F.col("metric_value").isNull()).count() == 0
    runs = store.read_table(spark, first, store.RUNS)
    assert runs.count() == 4 and {r.check_status for r in runs.collect()} == {"PASS"}
    assert {r.lookup_code for r in runs.collect()} == {"LOB_CLICKS"}

    # the next day is judged against the stored history; an expected dataset stayed away
    missing = spark.createDataFrame(
        [("lob=commercial/x", DAY + dt.timedelta(days=4))], "dataset_name string, partition_date date")
    second = go(monitored(spark, [4], None), history=numerics, expected=missing)
    status = {
        (r.dataset_name.split("/")[0], r.check_type): r.status
        for r in store.read_table(spark, second, store.DETAILS)
        .filter("detail_type LIKE '%_status' OR detail_type = 'distribution_summary'")
        .select("dataset_name", "check_type", F.get_json_object("detail_value", "$.status").alias("status")).collect()
    }
    assert status[("lob=retail", "OPS")] == "FAIL" and status[("lob=retail", "VOLUME")] == "PASS"
    assert status[("lob=retail", "DISTRIBUTION")] == "WARN"
    assert status[("lob=commercial", "ZERO_ROW")] == "FAIL"
    assert status[("lob=commercial", "FRESHNESS")] == "NOT_RUN"
    assert store.read_table(spark, second, store.RUNS).count() == 2

    # a rerun of a date replaces its active rows
    targets = runs.select("dataset_name", "partition_date").filter(F.col("partition_date") == DAY)
    store.apply_expiry(spark, first, targets, dt.datetime(2026, 4, 2))
    again = store.read_table(spark, first, store.RUNS)
    assert again.count() == 4 and store.active(again).count() == 3
    left = store.active(store.read_table(spark, first, store.NUMERICS))
    assert left.select("run_id").distinct().count() == 3


def test_two_runs_share_a_store(spark):
    clock, folder = profile.per_partition_clock(30), scratch_folder(spark)
    for days in (range(2), range(1, 3)):
        m = monitored(spark, days)
        fams = profile.default_families(m, freshness_column="source_event_timestamp", as_of=clock)
        daily.run(spark, m, folder, families=fams, enrichment=d.enrichment(spark), rerun_number=days.start,
                  at=F.lit("2026-04-01 06:00:00").cast("timestamp_ntz"))
    runs = store.read_table(spark, folder, store.RUNS)
    seen = sorted((r.partition_date, r.rerun_number) for r in runs.collect())
    assert seen == [(DAY, 0), (DAY + dt.timedelta(1), 0), (DAY + dt.timedelta(1), 1), (DAY + dt.timedelta(2), 1)]
    spark.range(1).selectExpr("'lost' AS batch_id", "id AS run_id", "'d' AS dataset_name", "0 AS rerun_number",
                              "timestamp_ntz'9999-12-31 23:59:59' AS expiry_date", "date'2026-03-30' AS partition_date"
                              ).write.mode("append").partitionBy("partition_date").parquet(f"{folder}/runs")
    assert store.read_table(spark, folder, store.RUNS).count() == 4


def test_disabled_checks_leave_no_metrics(spark):
    folder, m = scratch_folder(spark), monitored(spark, range(2))
    fams = profile.default_families(m, freshness_column="source_event_timestamp", as_of=profile.per_partition_clock(30))
    config = spark.createDataFrame(
        [(1, "lob=retail/%", "FRESHNESS", True, 0, FOREVER)],
        "id bigint, dataset_pattern string, check_type string, enabled boolean, explosion_level int, expiry_date timestamp_ntz")
    daily.run(spark, m, folder, families=fams, enrichment=d.enrichment(spark), config=config,
              at=F.lit("2026-04-01 06:00:00").cast("timestamp_ntz"))
    kinds = {r.check_type for r in store.read_table(spark, folder, store.NUMERICS).select("check_type").distinct().collect()}
    assert kinds <= {"FRESHNESS", "DQS_SCORE"}


def test_daily_run_writes_the_whole_vocabulary(spark):
    from plumbline.operators import profile as p

    m = monitored(spark, range(9))
    m = m.withColumn("event_ts", F.col("source_event_timestamp").cast("timestamp_ntz"))
    # the enrichment gives alpha/click an SLA; a second dataset has none
    m = m.unionByName(m.withColumn("dataset_name", F.lit("lob=other/src_sys_nm=beta/dataset=b")))
    checks = [
        "FRESHNESS", "VOLUME", "SCHEMA", "OPS", "SLA_COUNTDOWN", "ZERO_ROW", "BREAKING_CHANGE", "DISTRIBUTION",
        "TIMESTAMP_SANITY", "CLASSIFICATION_WEIGHTED", "SOURCE_SYSTEM_HEALTH", "CORRELATION", "INFERRED_SLA",
        "LINEAGE", "CROSS_DESTINATION",
    ]
    config = spark.createDataFrame(
        [(i, "lob=%", k, True, 0, FOREVER) for i, k in enumerate(checks)],
        "id bigint, dataset_pattern string, check_type string, enabled boolean, explosion_level int, expiry_date timestamp_ntz")
    lobs = spark.createDataFrame(
        [("LOB_CLICKS", "Clicks", "x", "Tier 1 Critical", FOREVER)],
        "lookup_code string, lob_name string, owner string, classification string, expiry_date timestamp_ntz")
    folder = scratch_folder(spark)
    fams = p.default_families(m, freshness_column="source_event_timestamp", as_of=p.per_partition_clock(30))
    daily.run(spark, m, folder, families=fams, enrichment=d.enrichment(spark), config=config, lob_lookup=lobs,
              at=F.lit("2026-04-01 06:00:00").cast("timestamp_ntz"))
    names = {(r.check_type, r.metric_name) for r in store.read_table(spark, folder, store.NUMERICS)
             .select("check_type", "metric_name").distinct().collect()}
    assert names >= {
        ("FRESHNESS", "hours_since_update"), ("VOLUME", "row_count"), ("VOLUME", "pct_change"),
        ("VOLUME", "row_count_stddev"), ("SCHEMA", "added_fields_count"), ("SCHEMA", "removed_fields_count"),
        ("SCHEMA", "changed_fields_count"), ("OPS", "null_rate_pct::value"),
        ("OPS", "empty_string_rate_pct::source_event_timestamp"), ("SLA_COUNTDOWN", "hours_remaining"),
        ("ZERO_ROW", "row_count"), ("DISTRIBUTION", "value.mean"), ("DISTRIBUTION", "value.stddev"),
        ("DISTRIBUTION", "value.p50"), ("DISTRIBUTION", "value.p95"), ("DISTRIBUTION", "value.count"),
        ("TIMESTAMP_SANITY", "future_pct.event_ts"), ("TIMESTAMP_SANITY", "stale_pct.event_ts"),
        ("CLASSIFICATION_WEIGHTED", "classification_weighted_score"), ("SOURCE_SYSTEM_HEALTH", "aggregate_score"),
        ("SOURCE_SYSTEM_HEALTH", "dataset_count"), ("CORRELATION", "correlated_dataset_count"),
        ("CORRELATION", "correlation_ratio"), ("INFERRED_SLA", "inferred_sla_hours"),
        ("INFERRED_SLA", "deviation_from_inferred"), ("LINEAGE", "upstream_dataset_count"),
        ("LINEAGE", "upstream_failed_count"), ("DQS_SCORE", "composite_score"),
    }
    kinds = {(r.check_type, r.detail_type) for r in store.read_table(spark, folder, store.DETAILS)
             .select("check_type", "detail_type").distinct().collect()}
    assert kinds >= {
        ("FRESHNESS", "freshness_status"), ("VOLUME", "volume_status"), ("SCHEMA", "schema_status"),
        ("SCHEMA", "schema_hash"), ("OPS", "ops_status"), ("OPS", "ops_anomalies"),
        ("SLA_COUNTDOWN", "sla_countdown_status"), ("ZERO_ROW", "zero_row_status"),
        ("BREAKING_CHANGE", "breaking_change_status"), ("DISTRIBUTION", "value.status"),
        ("DISTRIBUTION", "distribution_summary"), ("TIMESTAMP_SANITY", "timestamp_sanity.event_ts"),
        ("TIMESTAMP_SANITY", "timestamp_sanity_summary"), ("CLASSIFICATION_WEIGHTED", "classification_weighted_status"),
        ("SOURCE_SYSTEM_HEALTH", "source_system_health_status"), ("CORRELATION", "correlation_status"),
        ("INFERRED_SLA", "inferred_sla_status"), ("LINEAGE", "lineage_status"),
        ("ORPHAN_DETECTION", "orphan_detection_status"), ("CROSS_DESTINATION", "cross_destination_status"),
        ("DQS_SCORE", "dqs_score_breakdown"),
    }
    details = store.read_table(spark, folder, store.DETAILS)
    assert details.groupBy("run_id", "check_type", "detail_type").count().filter("count > 1").count() == 0
    runs = store.read_table(spark, folder, store.RUNS)
    assert runs.count() == 18 and runs.select("run_id").distinct().count() == 18


def test_partitions_without_event_time(spark):
    rows = [("lob=x/d", DAY, "text")]
    m = spark.createDataFrame(rows, "dataset_name string, partition_date date, note string")
    folder = scratch_folder(spark)
    fams = [profile.volume_measures(), profile.null_rate_measures(m)]
    daily.run(spark, m, folder, families=fams, enrichment=d.enrichment(spark),
              at=F.lit("2026-04-01 06:00:00").cast("timestamp_ntz"))
    status = {
        r.check_type: (r.status, r.reason)
        for r in store.read_table(spark, folder, store.DETAILS)
        .filter("detail_type IN ('freshness_status', 'distribution_summary', 'timestamp_sanity_summary')")
        .select("check_type", F.get_json_object("detail_value", "$.status").alias("status"),
                F.get_json_object("detail_value", "$.reason").alias("reason")).collect()
    }
    assert status == {
        "FRESHNESS": ("NOT_RUN", "missing_source_event_timestamp"),
        "DISTRIBUTION": ("PASS", "no_numeric_columns"), "TIMESTAMP_SANITY": ("PASS", "no_timestamp_columns"),
    }


def test_kept_baselines_replace_the_history(spark, monkeypatch):
    """Day by day from the kept state: the verdicts of a run over the whole history, which is not read."""
    fams = lambda m: profile.default_families(m, freshness_column="source_event_timestamp", as_of=profile.per_partition_clock(30))
    options = {"enrichment": d.enrichment(spark), "at": F.lit("2026-04-01 06:00:00").cast("timestamp_ntz")}
    kept, whole = scratch_folder(spark), scratch_folder(spark)
    for k in range(5):
        m = monitored(spark, [k], 1.0 if k < 4 else 50.0)
        daily.run(spark, m, kept, families=fams(m), keep_baselines=True, **options)
        if k == 3:
            # from here on a read of stored metrics would fail
            monkeypatch.setattr(store, "read_table", lambda *_, **__: pytest.fail("history was read"))
    monkeypatch.undo()
    m = monitored(spark, range(4), 1.0).unionByName(monitored(spark, [4], 50.0))
    daily.run(spark, m, whole, families=fams(m), **options)
    def details(folder):
        rows = store.read_table(spark, folder, store.DETAILS)
        # schemas are not part of the kept values
        return sorted((r.partition_date, r.check_type, r.detail_type, r.detail_value) for r in rows.filter("check_type NOT IN ('SCHEMA', 'BREAKING_CHANGE')").collect())
    assert details(kept) == details(whole)
    state = store.read_baselines(spark, kept)
    assert {r.n for r in state.selectExpr("size(kept) AS n").collect()} == {5}
    store.compact(spark, kept)
    assert store.read_baselines(spark, kept).count() == state.count()


def test_kept_baselines_know_their_reach(spark):
    from plumbline.operators import baseline

    days = [(DAY + dt.timedelta(days=k), float(k)) for k in range(60)]
    history = spark.createDataFrame([("d", "c", "m", *x) for x in days], "dataset_name string, check_type string, metric_name string, partition_date date, metric_value double")
    state = baseline.kept_values(history)
    assert len(state.first().kept) == 40 and state.first().kept[-1]["value"] == 59.0
    assert baseline.reaches(state, DAY + dt.timedelta(days=50)) and not baseline.reaches(state, DAY + dt.timedelta(days=49))
    again = baseline.advanced(state, history.limit(0).unionByName(history.filter("metric_value = 59").withColumn("metric_value", F.lit(-1.0))))
    assert len(again.first().kept) == 40 and again.first().kept[-1]["value"] == -1.0
    assert baseline.reaches(baseline.kept_values(history.limit(5)), DAY)


def test_sketches_end_with_their_runs(spark):
    from plumbline.operators import sketches

    folder = scratch_folder(spark)
    for value in (1.0, 9.0):
        m = monitored(spark, [0], value)
        fams = profile.default_families(m, freshness_column="source_event_timestamp", as_of=profile.per_partition_clock(30))
        daily.run(spark, m, folder, families=fams, enrichment=d.enrichment(spark), keep_sketches=True, rerun=True,
                  at=F.lit("2026-04-01 06:00:00").cast("timestamp_ntz"))
    rows = store.read_table(spark, folder, store.SKETCHES)
    assert rows.count() == 4 and store.active(rows).count() == 2
    got = sketches.quantiles(sketches.merged(store.active(rows), ["dataset_name"]), {"p50": 0.5}).collect()
    assert {r.column_path: r.p50 for r in got}["value"] == 9.0
