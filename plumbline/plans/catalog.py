"""The catalogue: one query per operator, each over whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline import constants as c
from plumbline.functions import naming
from plumbline.operators import (
    baseline, checks, cross, json_paths, patterns, profile, reports, schema, score, sketches,
)
from plumbline.plans import daily_run as daily, derived as d, file_run
from plumbline.session import scratch_folder, staged
from plumbline.sources import files, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def stable(column, digits: int = 4) -> Column:
    """Rounding for comparison: exact ties are nudged up first, so that rounding
    does not depend on the last bits of a floating-point sum."""
    return F.round(F.col(column) + 1e-9, digits) if isinstance(column, str) else F.round(column + 1e-9, digits)


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({x: stable(x, digits) for x in columns})


BASELINE = ("baseline_mean", "baseline_stddev")

# ---- monitored rows ---------------------------------------------------------


@query
def chk_volume_rowcount(spark, sf):
    return profile.row_counts(d.monitored(spark, sf))


@query
def chk_volume_status(spark, sf):
    out = checks.volume_status(profile.row_counts(d.monitored(spark, sf)))
    return _rounded(out, "pct_change", "row_count_stddev", *BASELINE)


@query
def chk_zero_row(spark, sf):
    counts = d.order_counts(spark, sf)
    return checks.zero_row_status(profile.expected_partitions(counts), counts)


def _staleness(spark, sf):
    return profile.staleness(d.monitored(spark, sf), "source_event_timestamp", d.partition_clock())


@query
def chk_freshness_hours(spark, sf):
    return _staleness(spark, sf)


@query
def chk_freshness_status(spark, sf):
    return _rounded(checks.freshness_status(_staleness(spark, sf)), *BASELINE)


def _null_rates(spark, sf):
    return profile.null_rates(d.monitored(spark, sf))


@query
def chk_ops_null_rate(spark, sf):
    return _null_rates(spark, sf).select(
        *c.KEYS, "column_name", "row_count", "null_count", "null_rate_pct"
    )


@query
def chk_ops_empty_rate(spark, sf):
    rates = _null_rates(spark, sf).filter(F.col("blank_count").isNotNull())
    return rates.select(*c.KEYS, "column_name", "row_count", "blank_count", "empty_rate_pct")


@query
def chk_ops_anomalies(spark, sf):
    out = checks.ops_anomalies(_null_rates(spark, sf)).select(
        *c.KEYS, "column_name", "null_rate_pct", *BASELINE, "baseline_count",
        "severity", "status", "reason",
    )
    return _rounded(out, *BASELINE)


@query
def chk_ops_status(spark, sf):
    return checks.ops_status(_null_rates(spark, sf))


def _stats(spark, sf, **options):
    return profile.column_stats(d.monitored(spark, sf), **options)


@query
def chk_dist_stats(spark, sf):
    return _rounded(_stats(spark, sf, percentiles=False), "mean", "stddev")


@query
def chk_dist_percentiles(spark, sf):
    return _stats(spark, sf).select(*c.KEYS, "column_path", "p50", "p95")


@query
def chk_dist_shift(spark, sf):
    out = checks.distribution_shift(_stats(spark, sf, percentiles=False))
    return _rounded(out, "mean", "stddev", *BASELINE, "z_score")


@query
def chk_dist_summary(spark, sf):
    return checks.distribution_summary(
        checks.distribution_shift(_stats(spark, sf, percentiles=False))
    )


def _numeric_paths(spark, sf, level):
    found = json_paths.numeric_paths(d.monitored_json(spark, sf), ["event_attribute", "props"], level)
    return found.select("dataset_name", "column_path")


@query
def json_top_level_paths(spark, sf):
    return _numeric_paths(spark, sf, json_paths.TOP_LEVEL)


@query
def json_nested_paths(spark, sf):
    return _numeric_paths(spark, sf, json_paths.ALL)


@query
def chk_dist_json(spark, sf):
    m = d.monitored_json(spark, sf)
    return _rounded(json_paths.leaf_stats(m, ["event_attribute", "props"]), "mean", "stddev")


@query
def chk_dist_json_levels(spark, sf):
    """Statistics of the JSON leaves that each dataset's configured level asks for."""
    m = d.monitored_json(spark, sf)
    levels = patterns.explosion_levels(m.select("dataset_name").distinct(), d.check_config(spark))
    return _rounded(json_paths.leaf_stats(m, ["event_attribute", "props"], levels), "mean", "stddev")


def _ts_counts(spark, sf):
    return profile.timestamp_sanity(d.monitored(spark, sf))


@query
def chk_ts_sanity(spark, sf):
    return checks.timestamp_sanity_status(_ts_counts(spark, sf))


@query
def chk_ts_sanity_summary(spark, sf):
    return checks.timestamp_sanity_summary(
        checks.timestamp_sanity_status(_ts_counts(spark, sf))
    )


def _families(m: DataFrame):
    return profile.default_families(
        m, freshness_column="source_event_timestamp", as_of=d.partition_clock()
    )


@query
def profile_metrics(spark, sf):
    m = d.monitored(spark, sf)
    return _rounded(profile.metrics(m, _families(m)), "metric_value")


@query
def profile_lineitem(spark, sf):
    """Statistics of all numeric line item columns per supplier and year."""
    lines = d.table(spark, sf, "lineitem").select(
        F.concat(F.lit("src_sys_nm=s"), F.col("l_suppkey").cast("string")).alias("dataset_name"),
        F.trunc("l_shipdate", "year").alias("partition_date"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )
    return _rounded(profile.column_stats(lines), "mean", "stddev")


@query
def profile_month_quantiles(spark, sf):
    """Quantiles of a month from the merged sketches of its days; whether their true ranks are as stated."""
    m = d.monitored(spark, sf).select(*c.KEYS, "event_id", "user_id", "value")
    days = staged(sketches.column_sketches(m), scratch_folder(spark))
    month = F.trunc("partition_date", "month").alias("month")
    asked = {"p50": 0.5, "p95": 0.95}
    found = sketches.quantiles(sketches.merged(days.select("*", month), ["dataset_name", "month"]), asked)
    values = F.array(*(F.struct(F.lit(x).alias("column_path"), F.col(x).cast("double").alias("v")) for x in ("event_id", "user_id", "value")))
    rows = m.select("dataset_name", month, F.inline(values)).filter(F.col("v").isNotNull()).join(found, ["dataset_name", "month", "column_path"])
    n = F.count(F.lit(1))
    close = [
        ((F.count_if(F.col("v") < F.col(x)) / n <= p + sketches.RANK_ERROR) & (F.count_if(F.col("v") <= F.col(x)) / n >= p - sketches.RANK_ERROR)).alias(f"{x}_close")
        for x, p in asked.items()
    ]
    return rows.groupBy("dataset_name", "month", "column_path").agg(
        F.max("sample_count").cast("bigint").alias("sample_count"), n.alias("row_count"), *close)


# ---- history ----------------------------------------------------------------


@query
def hist_rolling_baseline(spark, sf):
    out = baseline.rolling_baseline(d.metric_history(spark, sf)).select(
        *c.KEYS, "check_type", "metric_name", "metric_value", *BASELINE, "baseline_count"
    )
    return _rounded(out, *BASELINE)


@query
def hist_kept_baseline(spark, sf):
    """The rolling baseline, year by year: each year sees the kept rows of the years before only."""
    folder, kept, parts = scratch_folder(spark), None, []
    # each year reads its own files only
    history = d.metric_history(spark, sf).withColumn("year", F.year("partition_date"))
    history = staged(history, f"{folder}/history", "year")
    first, last = history.agg(F.min("year"), F.max("year")).first()
    for year in range(first, last + 1):
        rows = staged(baseline.rolled(kept, history.filter(F.col("year") == year)), f"{folder}/{year}", "is_new")
        parts.append(rows.filter("is_new"))
        kept = rows.filter("is_kept")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return _rounded(out.select(*c.KEYS, "check_type", "metric_name", "metric_value", *BASELINE, "baseline_count"), *BASELINE)


@query
def hist_latest_column_stats(spark, sf):
    m = d.monitored(spark, sf)
    sources = [(x, F.col(x)) for x in profile.numeric_columns(m)]
    long = profile.metrics(m, [profile.distribution_measures(sources)])
    out = baseline.latest_column_stats(long)
    return _rounded(out, "baseline_mean", "baseline_stddev")


@query
def hist_prev_schema(spark, sf):
    return schema.previous_snapshot(d.snapshots(spark, sf)).select(
        *c.KEYS, "schema_hash", "baseline_date", "baseline_hash", "baseline_json"
    )


@query
def chk_schema_hash(spark, sf):
    stored = d.snapshots(spark, sf).filter(F.col("schema_json").isNotNull())
    return schema.with_hash(stored.select(*c.KEYS, "schema_json"))


@query
def chk_schema_drift(spark, sf):
    return schema.field_drift(d.snapshots(spark, sf))


@query
def chk_schema_status(spark, sf):
    return schema.schema_status(d.snapshots(spark, sf))


@query
def chk_breaking_change(spark, sf):
    return schema.breaking_change(d.snapshots(spark, sf))


# ---- configuration ----------------------------------------------------------


@query
def cfg_enabled_checks(spark, sf):
    return patterns.enabled_checks(d.dataset_names(spark, sf), d.check_config(spark))


@query
def cfg_lookup_enrichment(spark, sf):
    codes = d.dataset_names(spark, sf).select(
        naming.source_system(F.col("dataset_name")).alias("raw_code")
    ).filter("raw_code IS NOT NULL")
    return patterns.lookup_codes(codes, d.enrichment(spark))


@query
def cfg_sla_hours(spark, sf):
    return patterns.sla_hours(d.dataset_names(spark, sf), d.enrichment(spark))


@query
def cfg_explosion_level(spark, sf):
    return patterns.explosion_levels(d.dataset_names(spark, sf), d.check_config(spark))


@query
def cfg_score_weights(spark, sf):
    weights = patterns.score_weights(d.dataset_names(spark, sf), d.enrichment(spark))
    return weights.select("dataset_name", F.explode("weights").alias("check_type", "weight"))


@query
def chk_orphan_detection(spark, sf):
    return patterns.orphan_detection(d.dataset_names(spark, sf), d.check_config(spark))


@query
def ref_lob_resolution(spark, sf):
    runs = d.active_runs(spark, sf).select("run_id", "lookup_code")
    return patterns.resolve_lob(runs, d.lob_lookup(spark))


@query
def chk_classification_weighted(spark, sf):
    runs = d.active_runs(spark, sf).select("run_id", "lookup_code")
    return patterns.classification_weighted(runs, d.lob_lookup(spark))


# ---- score and store --------------------------------------------------------


def _statuses(spark, sf):
    return score.statuses_from_details(store.active(d.details(spark, sf)))


def _run_weights(spark, sf):
    """Custom weights of the run's dataset."""
    runs = d.active_runs(spark, sf).select("run_id", "dataset_name")
    return runs.join(
        patterns.score_weights(runs, d.enrichment(spark)), "dataset_name"
    ).select("run_id", "weights")


@query
def dq_score(spark, sf):
    return _rounded(score.dq_score(_statuses(spark, sf)), "composite_score")


@query
def dq_score_custom_weights(spark, sf):
    runs = d.active_runs(spark, sf).select("run_id")
    statuses = _statuses(spark, sf).join(runs, "run_id", "left_semi")
    return _rounded(score.dq_score(statuses, _run_weights(spark, sf)), "composite_score")


@query
def dq_score_breakdown(spark, sf):
    out = score.breakdown(_statuses(spark, sf))
    return _rounded(out, "normalized_weight", "contribution")


@query
def run_status_derivation(spark, sf):
    out = score.run_status(
        d.active_runs(spark, sf), store.active(d.details(spark, sf)), store.active(d.numerics(spark, sf))
    )
    return out.withColumn("dqs_score", F.col("dqs_score").cast("double"))


def _plain_score(df: DataFrame) -> DataFrame:
    return df.withColumn("dqs_score", F.col("dqs_score").cast("double"))


@query
def active_runs(spark, sf):
    return _plain_score(store.active(d.runs(spark, sf)))


def _rerun_targets(spark, sf):
    """Every partition from 2001 on is run again."""
    return d.runs(spark, sf).filter(F.col("partition_date") >= F.lit("2001-01-01").cast("date"))


EXPIRED_AT = "2002-06-01 12:00:00"


@query
def rerun_expire_runs(spark, sf):
    out = store.expire_runs(d.runs(spark, sf), _rerun_targets(spark, sf), EXPIRED_AT)
    return out.select("run_id", *c.KEYS, "rerun_number", "expiry_date", "next_rerun_number")


@query
def rerun_expire_numeric(spark, sf):
    out = store.expire_metrics(
        d.numerics(spark, sf), d.runs(spark, sf), _rerun_targets(spark, sf), EXPIRED_AT
    )
    return out.select("metric_id", "run_id", "check_type", "metric_name", "expiry_date")


@query
def rerun_expire_detail(spark, sf):
    out = store.expire_metrics(
        d.details(spark, sf), d.runs(spark, sf), _rerun_targets(spark, sf), EXPIRED_AT
    )
    return out.select("detail_id", "run_id", "check_type", "detail_type", "expiry_date")


@query
def rerun_numbers(spark, sf):
    return store.rerun_numbers(d.runs(spark, sf), _rerun_targets(spark, sf))


@query
def rerun_next_number(spark, sf):
    return store.next_rerun_numbers(d.runs(spark, sf))


@query
def orchestration_rollup(spark, sf):
    return store.orchestration_rollup(d.runs(spark, sf))


# ---- cross-dataset checks ---------------------------------------------------


@query
def chk_sla_countdown(spark, sf):
    runs = d.active_runs(spark, sf).select("run_id", *c.KEYS, "create_date")
    out = cross.sla_countdown(runs, d.enrichment(spark), F.col("create_date"))
    return out.select(
        "run_id", *c.KEYS, "sla_hours", "hours_remaining", stable("warn_threshold").alias("warn_threshold"),
        "status", "reason",
    )


@query
def chk_source_health(spark, sf):
    return _rounded(cross.source_health(d.active_runs(spark, sf)), "aggregate_score")


@query
def chk_correlation(spark, sf):
    return _rounded(cross.correlation(d.active_runs(spark, sf)), "correlation_ratio")


@query
def chk_lineage(spark, sf):
    return cross.lineage(d.active_runs(spark, sf))


@query
def chk_cross_destination(spark, sf):
    """Runs of one source on one day are taken as copies of one delivery."""
    runs = d.active_runs(spark, sf).select(
        naming.source_system_label(F.col("dataset_name")).alias("dataset_name"),
        "partition_date", "dqs_score",
    )
    return _rounded(cross.cross_destination(runs), "mean_score", "max_deviation")


@query
def chk_inferred_sla(spark, sf):
    out = cross.inferred_sla(d.delivery_hours(spark, sf), d.enrichment(spark))
    return _rounded(
        out, "mean_hours", "stddev_hours", "inferred_sla_hours", "deviation_from_inferred"
    )


# ---- reports ----------------------------------------------------------------

MONTHLY_AS_OF = "2001-07-15"
MONTHS = ("2001-05", "2001-06", "2001-07")


def _active_numerics(spark, sf):
    return store.active(d.numerics(spark, sf))


def _active_details(spark, sf):
    return store.active(d.details(spark, sf))


def _yearly_runs(spark, sf):
    """Runs of yearly partitions, so that the newest date carries many of them."""
    return d.active_runs(spark, sf).withColumn("partition_date", F.trunc("partition_date", "year"))


@query
def fn_source_system(spark, sf):
    name = F.col("dataset_name")
    return d.dataset_names(spark, sf).select(
        "dataset_name",
        naming.source_system(name).alias("for_checks"),
        naming.source_system_label(name).alias("for_display"),
        naming.source_system_sql(name).alias("for_ranking"),
    )


@query
def rpt_latest_run(spark, sf):
    return _plain_score(reports.latest_run(d.active_runs(spark, sf))).select(
        "run_id", "dataset_name", "lookup_code", "check_status", "dqs_score", "partition_date"
    )


@query
def rpt_summary_totals(spark, sf):
    return reports.summary_totals(d.active_runs(spark, sf))


@query
def rpt_lob_summary(spark, sf):
    return reports.lob_summary(d.active_runs(spark, sf))


@query
def rpt_lob_trend(spark, sf):
    return reports.lob_trend(d.active_runs(spark, sf))


@query
def rpt_last_run(spark, sf):
    return reports.last_run(
        d.active_runs(spark, sf), F.lit("2001-08-01 23:00:00").cast("timestamp_ntz")
    )


@query
def rpt_lob_datasets(spark, sf):
    return reports.lob_datasets(d.active_runs(spark, sf), _active_numerics(spark, sf), time_range="90d")


@query
def rpt_lob_datasets_one(spark, sf):
    return reports.lob_datasets(
        d.active_runs(spark, sf), _active_numerics(spark, sf), lob="LOB_BUILDING", time_range="30d"
    )


@query
def rpt_dataset_detail(spark, sf):
    return reports.dataset_detail(
        d.active_runs(spark, sf), _active_numerics(spark, sf), _active_details(spark, sf),
        d.orchestrations(spark, sf), d.lob_lookup(spark),
    )


@query
def rpt_previous_row_count(spark, sf):
    return reports.previous_row_count(d.active_runs(spark, sf), _active_numerics(spark, sf))


@query
def rpt_row_count_before(spark, sf):
    return reports.row_count_before(d.active_runs(spark, sf), _active_numerics(spark, sf))


@query
def rpt_dataset_trend(spark, sf):
    return reports.dataset_trend(d.active_runs(spark, sf), "90d")


@query
def rpt_metrics_by_check(spark, sf):
    out = reports.metrics_by_check(
        d.active_runs(spark, sf), _active_numerics(spark, sf), _active_details(spark, sf)
    )
    return out.select(
        "run_id", "check_type", "status",
        F.array_join(
            F.transform("numeric_metrics", lambda m: F.concat(m["metric_name"], F.lit("="), m["metric_value"].cast("bigint").cast("string"))),
            ";",
        ).alias("numeric_metrics"),
        F.array_join(
            F.transform("detail_metrics", lambda m: F.concat(m["detail_type"], F.lit("="), m["detail_value"])),
            ";",
        ).alias("detail_metrics"),
    )


@query
def rpt_search(spark, sf):
    return reports.search(d.active_runs(spark, sf), "SRC_SYS_NM=nation_1/")


@query
def rpt_lob_monthly(spark, sf):
    return reports.lob_monthly(d.active_runs(spark, sf), MONTHLY_AS_OF)


@query
def rpt_lob_monthly_pivot(spark, sf):
    return reports.lob_monthly_pivot(d.active_runs(spark, sf), MONTHS, MONTHLY_AS_OF)


@query
def rpt_source_accountability(spark, sf):
    return reports.source_accountability(_yearly_runs(spark, sf))


@query
def rpt_improvement_delta(spark, sf):
    return reports.improvement_delta(d.active_runs(spark, sf), MONTHLY_AS_OF)


@query
def rpt_latest_failures(spark, sf):
    return reports.latest_failures(_yearly_runs(spark, sf), _active_numerics(spark, sf))


@query
def rpt_failures_by_lob(spark, sf):
    return reports.failures_by_lob(_yearly_runs(spark, sf))


@query
def rpt_trend_direction(spark, sf):
    return reports.trend_direction(d.active_runs(spark, sf), _active_numerics(spark, sf), "90d")


@query
def rpt_find_dataset(spark, sf):
    return _plain_score(reports.find_dataset(d.active_runs(spark, sf), "Nation_17/")).select(
        "run_id", "dataset_name", "check_status", "dqs_score", "partition_date"
    )


@query
def rpt_lob_compare(spark, sf):
    return reports.lob_compare(d.active_runs(spark, sf), _active_numerics(spark, sf))


@query
def rpt_run_check_failures(spark, sf):
    return reports.run_check_failures(d.active_runs(spark, sf), _active_details(spark, sf))


@query
def rpt_run_failed_datasets(spark, sf):
    return reports.run_failed_datasets(d.active_runs(spark, sf))


@query
def rpt_lob_header(spark, sf):
    return reports.lob_header(d.active_runs(spark, sf))


@query
def rpt_worst_first(spark, sf):
    return reports.worst_first(d.active_runs(spark, sf))


@query
def rpt_score_band(spark, sf):
    return reports.score_bands(d.active_runs(spark, sf))


# ---- files and the daily run ------------------------------------------------


def _event_tree(spark, sf) -> str:
    """The monitored rows written as partition directories in a new shared folder."""
    m = d.monitored(spark, sf).select(
        "partition_date",
        naming.source_system(F.col("dataset_name")).alias("src_sys_nm"),
        "event_id", "value", "event_ts",
    )
    folder = scratch_folder(spark)
    files.write_partitions(m, folder)
    return folder


@query
def src_file_inventory(spark, sf):
    found = files.inventory(spark, _event_tree(spark, sf))
    return found.groupBy("raw_date", "src_sys_nm").agg(F.max(F.col("length") > 0).alias("has_bytes"))


@query
def src_format_detect(spark, sf):
    found = files.datasets(files.inventory(spark, _event_tree(spark, sf)), d.enrichment(spark))
    return found.select(*c.KEYS, "raw_code", "lookup_code", "format", "status", "reason")


@query
def src_parquet_partitioned(spark, sf):
    rows = files.read_partitions(spark, _event_tree(spark, sf))
    return rows.groupBy(*c.KEYS).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("event_id").alias("id_sum"),
        F.count("value").alias("value_count"),
        F.max("event_ts").alias("latest"),
    )


@query
def store_rerun_roundtrip(spark, sf):
    """Runs and metrics of quarterly partitions written, those from 2001 on expired in
    place, everything read back."""
    quarter = F.trunc("partition_date", "quarter")
    runs = d.runs(spark, sf).withColumn("partition_date", quarter)
    dated = runs.select("run_id", *c.KEYS)
    folder = scratch_folder(spark)
    store.write_metrics(
        folder, runs, d.numerics(spark, sf).join(dated, "run_id"),
        d.details(spark, sf).join(dated, "run_id"),
    )
    targets = staged(
        runs.filter(F.col("partition_date") >= F.lit("2001-01-01").cast("date"))
        .select(*c.KEYS).distinct(),
        f"{folder}/targets",
    )
    store.apply_expiry(spark, folder, targets, EXPIRED_AT)
    parts = [
        store.read_table(spark, folder, name).groupBy("expiry_date").agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(name).alias("table_name"), "expiry_date", "row_count")
        for name in (store.RUNS, store.NUMERICS, store.DETAILS)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def store_rerun_partial(spark, sf):
    """All runs stored; failed ones expired and run again twice into the same folder.

    Other datasets of the same (quarterly) dates, and all expired rows, must stay as they were.
    """
    runs = d.runs(spark, sf).withColumn("partition_date", F.trunc("partition_date", "quarter"))
    dated = runs.select("run_id", *c.KEYS)
    parts = {
        store.RUNS: runs, store.NUMERICS: d.numerics(spark, sf).join(dated, "run_id"),
        store.DETAILS: d.details(spark, sf).join(dated, "run_id"),
    }
    folder = scratch_folder(spark)
    store.write_metrics(folder, *parts.values())
    failed = staged(
        runs.filter((F.col("check_status") == c.FAIL) & (F.col("expiry_date") == store.sentinel()))
        .select("run_id", *c.KEYS), f"{folder}-failed",
    )
    for turn in (1, 2):
        store.apply_expiry(spark, folder, failed, f"2002-0{turn}-15 00:00:00")
        again = []
        for df in parts.values():
            own = df.join(failed.select("run_id"), "run_id", "left_semi")
            again.append(own.withColumn("run_id", F.col("run_id") + turn * 1_000_000_000))
        again[0] = again[0].withColumn("rerun_number", F.col("rerun_number") + turn)
        store.write_metrics(folder, *again)
    numbered = [
        store.read_table(spark, folder, name).groupBy("run_id", "expiry_date").agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(name).alias("table_name"), "run_id", "expiry_date", "row_count")
        for name in parts
    ]
    return numbered[0].unionByName(numbered[1]).unionByName(numbered[2])


def _orchestrated_runs(spark, sf):
    """Runs with a parent path per source and year; those without a score could not be run."""
    start = F.lit("1999-01-01 03:00:00").cast("timestamp_ntz")
    nation, year = F.floor(F.col("orchestration_run_id") / 10000), F.col("orchestration_run_id") % 10000
    path = F.concat(F.lit("/prod/nation_"), nation.cast("string"), F.lit("/"), year.cast("string"))
    return d.runs(spark, sf).filter(F.col("orchestration_run_id").isNotNull()).withColumns({
        "parent_path": path, "partition_date": F.trunc("partition_date", "year"),
        "check_status": F.when(F.col("check_status") == "UNKNOWN", c.NOT_RUN).otherwise(F.col("check_status")),
        "orchestration_run_id": store.orchestration_id(path, start),
    }), start


def _states(rows: DataFrame, moment: str) -> DataFrame:
    return rows.drop("orchestration_run_id").withColumn("moment", F.lit(moment))


@query
def orchestration_lifecycle(spark, sf):
    """Orchestration runs at three commits: started; those before 1998 finalized with their counts;
    the 1992 paths started again, which expires their former runs."""
    folder = scratch_folder(spark)
    runs, start = _orchestrated_runs(spark, sf)
    paths = staged(runs.select("parent_path").distinct(), f"{folder}-paths")
    store.write_running(folder, store.running(paths, start))
    none = runs.limit(0)
    store.write_metrics(
        folder, runs.drop("parent_path"), none.select("run_id", *c.KEYS, F.lit(0.0).alias("metric_value")),
        none.select("run_id", *c.KEYS, F.lit("").alias("detail_value")),
    )
    begun = store.last_commit(spark, folder)
    done = paths.filter(~F.col("parent_path").endswith("1998")).select(
        store.orchestration_id(F.col("parent_path"), start).alias("orchestration_run_id"))
    store.finalize(spark, folder, "1999-01-01 04:30:00", only=done)
    finished = store.last_commit(spark, folder)
    again = paths.filter(F.col("parent_path").endswith("1992"))
    store.write_running(folder, store.running(again, F.lit("1999-01-02 03:00:00")))
    return _states(store.read_orchestrations(spark, folder, begun), "begun").unionByName(
        _states(store.read_orchestrations(spark, folder, finished), "finished")
    ).unionByName(_states(store.read_orchestrations(spark, folder), "again"))


@query
def store_compacted(spark, sf):
    """Failed runs of a stored year run again in one commit with the end of the old ones; then the
    store is compacted and an orchestration is written after it: rows, ends and rerun numbers stay."""
    folder = scratch_folder(spark)
    runs = d.runs(spark, sf).withColumn("partition_date", F.trunc("partition_date", "year"))
    dated = runs.select("run_id", *c.KEYS)
    numerics, details = (x.join(dated, "run_id") for x in (d.numerics(spark, sf), d.details(spark, sf)))
    store.write_metrics(folder, runs, numerics, details)
    failed = staged(runs.filter((F.col("check_status") == c.FAIL) & (F.col("expiry_date") == store.sentinel()))
                    .select("run_id", *c.KEYS), f"{folder}-failed")
    again = [df.join(failed.select("run_id"), "run_id", "left_semi").withColumn("run_id", F.col("run_id") + 1_000_000_000)
             for df in (runs, numerics, details)]
    again[0] = again[0].withColumn("rerun_number", F.col("rerun_number") + 1)
    store.write_metrics(folder, *again, replace=failed, at="2002-01-15 00:00:00")
    store.compact(spark, folder)
    store.write_running(folder, store.start_orchestration(spark, ["/prod/x"], "2002-01-15 00:00:00"))
    runs_read = store.read_table(spark, folder, store.RUNS).select(
        F.lit(store.RUNS).alias("table_name"), "run_id", "expiry_date", "next_rerun_number", F.lit(1).cast("bigint").alias("row_count"))
    others = [
        store.read_table(spark, folder, name).groupBy("run_id", "expiry_date").agg(F.count(F.lit(1)).alias("row_count"))
        .select(F.lit(name).alias("table_name"), "run_id", "expiry_date", F.lit(None).cast("int").alias("next_rerun_number"), "row_count")
        for name in (store.NUMERICS, store.DETAILS)
    ]
    return runs_read.unionByName(others[0]).unionByName(others[1])


@query
def daily_run(spark, sf):
    """All partition checks, score and run rows of every monitored date, stored and read back."""
    folder = scratch_folder(spark)
    m = d.monitored(spark, sf)
    daily.run(
        spark, m, folder, families=_families(m), enrichment=d.enrichment(spark),
        at=F.lit("2024-01-31 06:00:00").cast("timestamp_ntz"),
    )
    runs = store.read_table(spark, folder, store.RUNS)
    return runs.select(
        *c.KEYS, "check_status", F.col("dqs_score").cast("double").alias("dqs_score")
    )


def _full_run(spark, sf) -> str:
    """Two batches into one store with everything switched on: history kept in the store, configuration,
    reference data, the first batch's runs as past runs, JSON levels, an orchestration run."""
    folder, m = scratch_folder(spark), d.monitored(spark, sf)
    at = F.lit("2024-01-31 06:00:00").cast("timestamp_ntz")
    started = staged(store.start_orchestration(spark, ["/prod/events"], at), f"{folder}-started")
    store.write_running(folder, started)
    first = F.col("partition_date") < F.lit("2024-01-16").cast("date")
    for batch in (m.filter(first), m.filter(~first)):
        past = store.active(store.read_table(spark, folder, store.RUNS)) if store.has_table(spark, folder, store.RUNS) else None
        daily.run(
            spark, batch, folder, families=_families(m), enrichment=d.enrichment(spark), config=d.check_config(spark, d.FULL_CONFIG),
            lob_lookup=d.lob_lookup(spark), past_runs=past, at=at, keep_baselines=True, json_columns=("event_attribute", "props"),
            orchestration_run_id=store.orchestration_id(F.lit("/prod/events"), at),
        )
    store.finalize(spark, folder, at)
    return folder


@query
def daily_run_numerics(spark, sf):
    """Every stored number of a run with everything switched on."""
    rows = store.read_table(spark, _full_run(spark, sf), store.NUMERICS)
    return _rounded(rows.select(*c.KEYS, "check_type", "metric_name", "metric_value"), "metric_value")


@query
def daily_run_details(spark, sf):
    """Status and reason of the checks of the same run."""
    rows = store.read_table(spark, _full_run(spark, sf), store.DETAILS)
    listed = (c.VOLUME, c.FRESHNESS, c.OPS, c.TIMESTAMP_SANITY, c.SLA_COUNTDOWN, c.INFERRED_SLA, c.SOURCE_SYSTEM_HEALTH,
              c.CORRELATION, c.LINEAGE, c.CLASSIFICATION_WEIGHTED, c.DQS_SCORE)
    of_check = F.col("check_type").isin(*listed) & (F.col("detail_type").endswith("_status") | F.col("detail_type").isin(
        "dqs_score_breakdown", "timestamp_sanity.event_ts", "timestamp_sanity_summary"))
    return rows.filter(of_check).select(
        *c.KEYS, "check_type", "detail_type", F.get_json_object("detail_value", "$.status").alias("status"),
        F.get_json_object("detail_value", "$.reason").alias("reason"))


def _mixed_tree(spark, sf) -> str:
    """Three datasets with columns of their own; ``id`` has a different type in each, and
    the events gain a column on 2024-01-15."""
    folder = scratch_folder(spark)
    events = d.monitored(spark, sf).select(
        "partition_date", F.lit("ev").alias("src_sys_nm"), F.col("event_id").alias("id"), "value", "tag",
    )
    late = F.col("partition_date") >= F.lit("2024-01-15").cast("date")
    year = lambda day: F.trunc(F.col(day).cast("date"), "year").alias("partition_date")
    orders = d.table(spark, sf, "orders").select(
        year("o_orderdate"), F.lit("od").alias("src_sys_nm"), F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price"),
    )
    lines = d.table(spark, sf, "lineitem").select(
        year("l_shipdate"), F.lit("li").alias("src_sys_nm"), F.col("l_orderkey").cast("double").alias("id"), "l_quantity",
        F.when(F.col("l_linenumber") > 1, F.col("l_returnflag")).alias("flag"),
    )
    for df in (events.filter(~late).drop("tag"), events.filter(late), orders, lines):
        df.withColumn("partition_date", F.date_format("partition_date", "yyyyMMdd")).write.mode("append").partitionBy(
            "partition_date", "src_sys_nm"
        ).parquet(folder)
    return folder


@query
def run_mixed_schemas(spark, sf):
    """Files of different schemas, each profiled with its own columns: rows, null rates, drift."""
    folder = scratch_folder(spark)
    file_run.run(spark, _mixed_tree(spark, sf), folder, enrichment=d.enrichment(spark), at=F.lit("2024-03-01 06:00:00").cast("timestamp_ntz"))
    return store.read_table(spark, folder, store.NUMERICS).filter(
        F.col("metric_name").isin("row_count", "added_fields_count", "removed_fields_count", "changed_fields_count")
        & F.col("check_type").isin(c.VOLUME, c.SCHEMA) | F.col("metric_name").startswith("null_rate_pct::")
    ).select(*c.KEYS, "check_type", "metric_name", _rounded_value("metric_value"))


def _rounded_value(name: str) -> Column:
    return F.round(name, 6).alias(name)


@query
def run_with_bad_dataset(spark, sf):
    """The same files beside an unknown format and a broken file: the others are still run."""
    tree, folder = _mixed_tree(spark, sf), scratch_folder(spark)
    text = d.table(spark, sf, "nation").select(F.col("n_name").alias("value"))
    text.write.text(f"{tree}/partition_date=20240110/src_sys_nm=notes")
    text.coalesce(1).write.text(f"{tree}/partition_date=20240110/src_sys_nm=broken")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{tree}/partition_date=20240110/src_sys_nm=broken")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in system.listStatus(path):
        if found.getPath().getName().startswith("part-"):
            system.rename(found.getPath(), spark._jvm.org.apache.hadoop.fs.Path(path, "part-0.parquet"))
    file_run.run(spark, tree, folder, enrichment=d.enrichment(spark), at=F.lit("2024-03-01 06:00:00").cast("timestamp_ntz"))
    runs = store.read_table(spark, folder, store.RUNS)
    return runs.select(*c.KEYS, (F.col("check_status") != c.NOT_RUN).alias("was_run"), "error_message")
