"""Reporting queries over run history.

``runs`` holds active rows (see :func:`plumbline.sources.store.active`) with
run_id, dataset_name, partition_date, lookup_code, check_status, dqs_score,
rerun_number, orchestration_run_id, error_message and create_date.  ``numerics``
and ``details`` are active metric rows keyed by run_id.

Scores are DECIMAL(5,2); averages are rounded half up and returned as DOUBLE.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from plumbline import constants as c
from plumbline.functions import naming, verdicts
from plumbline.functions.columns import as_column, date_at_midnight, mean_of, round_score, seconds_between
from plumbline.operators.baseline import latest_rerun
from plumbline.operators.patterns import resolve_lob

NEWEST = ("partition_date", "rerun_number", "run_id")


def _newest_first():
    return [F.desc(x) for x in NEWEST]


def _status_counts() -> list:
    return [
        F.count_if(F.col("check_status") == s).alias(name)
        for s, name in ((c.PASS, "healthy_count"), (c.WARN, "degraded_count"), (c.FAIL, "critical_count"))
    ]


def _average(digits: int = 2):
    return round_score(mean_of(F.sum("dqs_score"), F.count("dqs_score")), digits)


def _on_newest_date(runs: DataFrame):
    """A scalar subquery on the partition column: only that date's files are read."""
    return F.col("partition_date") == runs.agg(F.max("partition_date")).scalar()


# ---- latest state -----------------------------------------------------------

def latest_run(runs: DataFrame, with_lookup_only: bool = True) -> DataFrame:
    """The newest run of every dataset; ties go to the higher rerun, then run id."""
    if with_lookup_only:
        runs = runs.filter(F.col("lookup_code").isNotNull())
    return latest_rerun(runs, ["dataset_name"], _newest_first())


def summary_totals(runs: DataFrame) -> DataFrame:
    return latest_run(runs).agg(F.count(F.lit(1)).alias("total_datasets"), *_status_counts())


def lob_summary(runs: DataFrame) -> DataFrame:
    return latest_run(runs).groupBy("lookup_code").agg(
        F.count(F.lit(1)).alias("dataset_count"), _average().alias("aggregate_score"),
        *_status_counts(),
    )


def last_run(runs: DataFrame, as_of=None) -> DataFrame:
    """Newest date, whether anything failed on it, and optionally its age flag."""
    days = runs.groupBy("partition_date").agg(
        F.max(F.col("check_status") == c.FAIL).alias("run_failed")
    )
    newest = days.orderBy(F.desc("partition_date")).limit(1).select(
        F.col("partition_date").alias("last_run_at"),
        F.coalesce("run_failed", F.lit(False)).alias("run_failed"),
    )
    if as_of is None:
        return newest
    age = seconds_between(date_at_midnight(F.col("last_run_at")), as_column(as_of))
    return newest.withColumn("is_stale", age >= c.DATA_AGE_STALE_HOURS * 3600)


# ---- trends -----------------------------------------------------------------

def _daily_trend(runs: DataFrame, key: str, days: int) -> DataFrame:
    """Daily average over the ``days`` up to the key's own newest day.

    Days are aggregated first, so the window sees one row per key and day.
    """
    daily = runs.groupBy(key, "partition_date").agg(_average().alias("avg_score"))
    newest = F.max("partition_date").over(Window.partitionBy(key))
    return (
        daily.withColumn("_newest", newest)
        .filter(F.col("partition_date") >= F.date_sub("_newest", days - 1))
        .select(key, F.col("partition_date").alias("day"), "avg_score")
    )


def lob_trend(runs: DataFrame, days: int = 7) -> DataFrame:
    return _daily_trend(runs.filter(F.col("lookup_code").isNotNull()), "lookup_code", days)


def dataset_trend(runs: DataFrame, time_range: str = "7d") -> DataFrame:
    return _daily_trend(runs, "dataset_name", naming.time_range_days(time_range))


def trend_points(trend: DataFrame, key: str) -> DataFrame:
    """The ascending series as one text value per key (at most ``days`` points)."""
    points = F.array_sort(F.collect_list(F.struct("day", "avg_score")))
    return trend.groupBy(key).agg(
        F.count(F.lit(1)).alias("points"),
        F.array_join(F.transform(points, lambda p: p["avg_score"].cast("string")), ",", "null").alias("trend"),
    )


def trend_direction(runs: DataFrame, numerics: DataFrame, time_range: str = "7d") -> DataFrame:
    """improving / degrading / stable per dataset, with the checks of a non-PASS latest run."""
    trend = dataset_trend(runs, time_range)
    ends = trend.groupBy("dataset_name").agg(
        F.max_by("avg_score", "day").alias("last_score"),
        F.min_by("avg_score", "day").alias("first_score"),
        F.count(F.lit(1)).alias("points"),
    )
    delta = F.col("last_score") - F.col("first_score")
    p = c.TREND_DIRECTION_POINTS
    direction = (
        F.when((F.col("points") >= 2) & (delta > p), "improving")
        .when((F.col("points") >= 2) & (delta < -p), "degrading")
        .otherwise("stable")
    )
    latest = latest_run(runs, with_lookup_only=False)
    flagged = _check_types(latest.filter(F.col("check_status") != c.PASS), numerics)
    return (
        latest.select(
            "run_id", "dataset_name", "check_status", "partition_date",
            F.col("dqs_score").cast("double").alias("current_score"),
        )
        .join(ends, "dataset_name")
        .join(flagged, "run_id", "left")
        .select(
            "dataset_name", "partition_date", "current_score", "check_status",
            F.col("points").alias("history_points"), direction.alias("trend"),
            F.coalesce("check_types", F.lit("")).alias("flagged_checks"),
        )
    )


def find_dataset(runs: DataFrame, text: str) -> DataFrame:
    """The first dataset by name that contains the text."""
    return latest_run(_containing(runs, text), with_lookup_only=False).orderBy("dataset_name").limit(1)


def _check_types(runs: DataFrame, numerics: DataFrame) -> DataFrame:
    """(run_id, check_types): the distinct check types of the given runs, sorted.

    There are at most as many check types as registered checks.
    """
    kept = numerics.select("run_id", "check_type").join(runs.select("run_id"), "run_id", "left_semi")
    return kept.groupBy("run_id").agg(
        F.concat_ws(",", F.array_sort(F.collect_set("check_type"))).alias("check_types")
    )


# ---- one LOB, one dataset ---------------------------------------------------

def lob_datasets(runs: DataFrame, numerics: DataFrame, lob: str | None = None,
                 time_range: str = "7d") -> DataFrame:
    """Latest run of the datasets of a LOB (or all), per-check presence and trend."""
    if lob is not None:
        runs_in = runs.filter(F.col("lookup_code") == lob)
    else:
        runs_in = runs.filter(F.col("lookup_code").isNotNull())
    latest = latest_run(runs_in)
    checks = (c.FRESHNESS, c.VOLUME, c.SCHEMA)
    present = (
        numerics.filter(F.col("check_type").isin(*checks))
        .groupBy("run_id")
        .agg(*(F.max(F.col("check_type") == k).alias(f"_{k}") for k in checks))
    )
    # the sparkline covers every run of the dataset name, whatever its code
    named = runs.join(latest.select("dataset_name"), "dataset_name", "left_semi") if lob else runs_in
    trend = trend_points(dataset_trend(named, time_range), "dataset_name")
    return (
        latest.join(present, "run_id", "left")
        .join(trend, "dataset_name", "left")
        .select(
            "lookup_code",
            F.col("run_id").alias("dataset_id"),
            "dataset_name",
            F.col("dqs_score").cast("double").alias("dqs_score"),
            "check_status",
            "partition_date",
            "trend",
            *(F.when(F.col(f"_{k}"), F.col("check_status")).alias(f"{k.lower()}_status") for k in checks),
        )
    )


def previous_row_count(runs: DataFrame, numerics: DataFrame) -> DataFrame:
    """Second newest VOLUME row count of every dataset name."""
    counts = _row_counts(numerics)
    dated = runs.select("dataset_name", *NEWEST).join(counts, "run_id")
    w = Window.partitionBy("dataset_name").orderBy(*_newest_first())
    second = dated.withColumn("_rn", F.row_number().over(w)).filter("_rn = 2")
    return second.select("dataset_name", F.col("row_count").alias("previous_row_count"))


def row_count_before(runs: DataFrame, numerics: DataFrame) -> DataFrame:
    """Row count of every run and of the dataset's run just before it."""
    dated = latest_rerun(
        runs.select("dataset_name", *NEWEST).join(_row_counts(numerics), "run_id"),
        ["dataset_name", "partition_date"], _newest_first(),
    )
    w = Window.partitionBy("dataset_name").orderBy("partition_date")
    return dated.withColumn("previous_row_count", F.lag("row_count").over(w)).select(
        "run_id", "row_count", "previous_row_count"
    )


def _row_counts(numerics: DataFrame) -> DataFrame:
    return numerics.filter(
        (F.col("check_type") == c.VOLUME) & (F.col("metric_name") == "row_count")
    ).select("run_id", F.col("metric_value").alias("row_count"))


def dataset_detail(runs: DataFrame, numerics: DataFrame, details: DataFrame,
                   orchestration: DataFrame, lob_lookup: DataFrame,
                   run_ids: Sequence[int] | None = None) -> DataFrame:
    """Everything known about a run; all runs unless ids are given."""
    wanted = runs if run_ids is None else runs.filter(F.col("run_id").isin(*run_ids))
    formats = details.filter(
        (F.col("check_type") == c.SCHEMA) & (F.col("detail_type") == "eventAttribute_format")
    ).groupBy("run_id").agg(F.min_by("detail_value", "detail_id").alias("_format"))
    # runs without an orchestration get a key of their own each, not one for all
    parents = orchestration.select(F.col("orchestration_run_id").alias("_parent"), F.lit(False).alias("_alone"), "parent_path")
    previous = previous_row_count(
        runs if run_ids is None
        else runs.join(wanted.select("dataset_name").distinct(), "dataset_name", "left_semi"),
        numerics,
    )
    joined = (
        wanted.join(_row_counts(numerics), "run_id", "left")
        .join(formats, "run_id", "left")
        .join(previous, "dataset_name", "left")
        .withColumns({
            "_parent": F.coalesce("orchestration_run_id", F.col("run_id").cast("bigint")),
            "_alone": F.col("orchestration_run_id").isNull(),
        })
        .join(parents, ["_parent", "_alone"], "left")
    )
    name, day = F.col("dataset_name"), F.col("partition_date")
    return resolve_lob(joined, lob_lookup).select(
        F.col("run_id").alias("dataset_id"),
        "dataset_name",
        F.col("lookup_code").alias("lob_id"),
        naming.source_system_label(name).alias("source_system"),
        naming.json_label(F.col("_format")).alias("format"),
        naming.partition_path(name, day).alias("hdfs_path"),
        "parent_path",
        "partition_date",
        "row_count",
        "previous_row_count",
        F.col("create_date").alias("last_updated"),
        "rerun_number",
        F.col("dqs_score").cast("double").alias("dqs_score"),
        "check_status",
        "error_message",
        "lob_name", "owner", "classification",
    )


def metrics_by_check(runs: DataFrame, numerics: DataFrame, details: DataFrame) -> DataFrame:
    """Metric and detail rows of every (run, check type), sorted by name.

    Lists hold the metrics of one check on one partition, at most a few per
    monitored column.
    """
    keys = ["run_id", "check_type"]
    both = numerics.select(
        *keys, F.struct("metric_name", "metric_value").alias("n"),
        F.lit(None).cast("struct<detail_type:string,detail_value:string>").alias("d"),
    ).unionByName(
        details.select(
            *keys, F.lit(None).cast("struct<metric_name:string,metric_value:double>").alias("n"),
            F.struct("detail_type", "detail_value").alias("d"),
        )
    )
    grouped = both.groupBy(*keys).agg(
        F.array_sort(F.collect_list("n")).alias("numeric_metrics"),
        F.array_sort(F.collect_list("d")).alias("detail_metrics"),
    )
    return runs.select("run_id", F.col("check_status").alias("status")).join(grouped, "run_id")


# ---- search -----------------------------------------------------------------

def _containing(runs: DataFrame, text: str) -> DataFrame:
    return runs.filter(F.contains(F.lower("dataset_name"), F.lit(text.lower())))


def search(runs: DataFrame, text: str, limit: int = c.SEARCH_LIMIT) -> DataFrame:
    """Top matches by name: prefix matches first, then by name; '' finds nothing."""
    hits = _containing(runs, text) if text else runs.filter(F.lit(False))
    latest = latest_run(hits, with_lookup_only=False)
    order = F.when(F.startswith(F.lower("dataset_name"), F.lit(text.lower())), 0).otherwise(1)
    return (
        latest.select(
            F.col("run_id").alias("dataset_id"), "dataset_name", F.col("lookup_code").alias("lob_id"),
            F.col("dqs_score").cast("double").alias("dqs_score"), "check_status",
            order.alias("sort_order"),
        )
        .orderBy("sort_order", "dataset_name")
        .limit(limit)
    )


# ---- executive reports ------------------------------------------------------

def _recent_months(runs: DataFrame, as_of, back: int = 2) -> DataFrame:
    first = F.add_months(F.trunc(as_column(as_of).cast("date"), "month"), -back)
    return runs.filter(
        F.col("lookup_code").isNotNull() & F.col("dqs_score").isNotNull()
        & (F.col("partition_date") >= first)
    )


def lob_monthly(runs: DataFrame, as_of) -> DataFrame:
    """Average score per LOB and month over the last three calendar months."""
    month = F.date_format("partition_date", "yyyy-MM")
    return _recent_months(runs, as_of).groupBy(
        F.col("lookup_code").alias("lob_id"), month.alias("month")
    ).agg(_average().alias("avg_score"))


def lob_monthly_pivot(runs: DataFrame, months: Sequence[str], as_of) -> DataFrame:
    """LOB x month scorecard; ``months`` as ``yyyy-MM`` become columns ``m_yyyy_MM``."""
    monthly = lob_monthly(runs, as_of)
    wide = monthly.groupBy("lob_id").pivot("month", list(months)).agg(F.first("avg_score"))
    return wide.withColumnsRenamed({m: "m_" + m.replace("-", "_") for m in months})


def source_accountability(runs: DataFrame) -> DataFrame:
    """Rows, average score and PASS/FAIL counts per source on the newest date."""
    source = naming.source_system_sql(F.col("dataset_name"))
    on_day = runs.filter(_on_newest_date(runs)).withColumn("src_sys_nm", source)
    return (
        on_day.filter(F.col("src_sys_nm") != "")
        .groupBy("src_sys_nm")
        .agg(
            F.count(F.lit(1)).alias("dataset_count"),
            _average().alias("avg_score"),
            F.count_if(F.col("check_status") == c.PASS).alias("healthy_count"),
            F.count_if(F.col("check_status") == c.FAIL).alias("critical_count"),
        )
        .orderBy(F.asc_nulls_last("avg_score"), "src_sys_nm")
    )


def improvement_delta(runs: DataFrame, as_of) -> DataFrame:
    """Average of the current month against the month two earlier, per LOB, in one pass."""
    month = F.trunc("partition_date", "month")
    this_month = F.trunc(as_column(as_of).cast("date"), "month")
    current, base = month == this_month, month == F.add_months(this_month, -2)
    mean = lambda when: mean_of(
        F.sum(F.when(when, F.col("dqs_score"))), F.count(F.when(when, F.col("dqs_score")))
    )
    both = (
        _recent_months(runs, as_of)
        .filter(current | base)
        .groupBy(F.col("lookup_code").alias("lob_id"))
        .agg(mean(base).alias("_base"), mean(current).alias("_current"))
    )
    return both.select(
        "lob_id",
        round_score(F.col("_base")).alias("baseline_score"),
        round_score(F.col("_current")).alias("current_score"),
        round_score(F.col("_current") - F.col("_base")).alias("delta"),
    )


# ---- failures and comparison ------------------------------------------------

def latest_failures(runs: DataFrame, numerics: DataFrame) -> DataFrame:
    """Failed runs of the newest date with the check types their dataset has metrics for."""
    failed = runs.filter(_on_newest_date(runs) & (F.col("check_status") == c.FAIL))
    types = _check_types(failed, numerics)
    return failed.join(types, "run_id", "left").select(
        "run_id", "dataset_name", "partition_date",
        F.coalesce("lookup_code", F.lit("UNKNOWN")).alias("lob"),
        F.col("dqs_score").cast("double").alias("dqs_score"),
        F.coalesce("check_types", F.lit("")).alias("check_types"),
    )


def failures_by_lob(runs: DataFrame) -> DataFrame:
    """Failure count per LOB on the newest date, next to the datasets processed."""
    on_day = runs.filter(_on_newest_date(runs))
    total = on_day.agg(F.countDistinct("dataset_name")).scalar()
    return (
        on_day.filter(F.col("check_status") == c.FAIL)
        .groupBy(F.coalesce("lookup_code", F.lit("UNKNOWN")).alias("lob"), "partition_date")
        .agg(F.count(F.lit(1)).alias("failure_count"))
        .withColumn("total_datasets", total)
    )


def lob_compare(runs: DataFrame, numerics: DataFrame) -> DataFrame:
    """LOBs from worst to best average score of their latest runs."""
    latest = latest_run(runs)
    failed = latest.filter(F.col("check_status") == c.FAIL)
    types = (
        numerics.select("run_id", "check_type").distinct()
        .join(failed.select("run_id", "lookup_code"), "run_id")
        .groupBy("lookup_code")
        .agg(F.concat_ws(",", F.array_sort(F.collect_set("check_type"))).alias("failing_checks"))
    )
    scores = latest.groupBy("lookup_code").agg(
        _average().alias("avg_score"),
        F.count(F.lit(1)).alias("dataset_count"),
        F.count_if(F.col("check_status") == c.FAIL).alias("failing_count"),
    )
    # one row per LOB is left here, a handful to rank
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("avg_score"), "lookup_code"))
    return scores.join(types, "lookup_code", "left").select(
        rank.cast("bigint").alias("lob_rank"), "lookup_code", "avg_score", "dataset_count",
        "failing_count", F.coalesce("failing_checks", F.lit("")).alias("failing_checks"),
    )


def run_failed_datasets(runs: DataFrame) -> DataFrame:
    """Datasets of each orchestration run that did not pass."""
    return runs.filter(
        F.col("orchestration_run_id").isNotNull() & (F.col("check_status") != c.PASS)
    ).select("orchestration_run_id", "dataset_name", "partition_date", "run_id", "check_status")


def run_check_failures(runs: DataFrame, details: DataFrame) -> DataFrame:
    """Detail rows per check type of the runs that did not pass."""
    failed = run_failed_datasets(runs).select("orchestration_run_id", "run_id")
    return (
        details.select("run_id", "check_type").join(failed, "run_id")
        .groupBy("orchestration_run_id", "check_type")
        .agg(F.count(F.lit(1)).alias("failure_count"))
    )


# ---- display helpers --------------------------------------------------------

def lob_header(runs: DataFrame) -> DataFrame:
    """Dataset count, rounded average, passing rate and last run per LOB."""
    rate = F.count_if(F.col("check_status") == c.PASS).cast("decimal(20,0)") * 100 / F.count(F.lit(1))
    return latest_run(runs).groupBy("lookup_code").agg(
        F.count(F.lit(1)).alias("dataset_count"),
        _average(0).cast("bigint").alias("avg_score"),
        F.round(rate, 0).cast("bigint").alias("passing_rate"),
        F.max("partition_date").alias("last_run"),
    )


def worst_first(runs: DataFrame) -> DataFrame:
    """Latest runs of each LOB ranked by score, unscored last.

    Ranks come from a count per distinct score (a DECIMAL(5,2) has few values),
    so no LOB is sorted as a whole in one task; equal scores share a rank.
    """
    latest = latest_run(runs).select("lookup_code", "dataset_name", "dqs_score")
    # NULL scores take a value above every score for counting and joining
    placed = latest.withColumn("_s", F.coalesce("dqs_score", F.lit(999.99).cast("decimal(5,2)")))
    counts = placed.groupBy("lookup_code", "_s").agg(F.count(F.lit(1)).alias("_n"))
    before = (
        Window.partitionBy("lookup_code").orderBy("_s")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    ranks = counts.select(
        "lookup_code", "_s", (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1).alias("position")
    )
    return placed.join(ranks, ["lookup_code", "_s"]).select(
        "lookup_code", "dataset_name", F.col("dqs_score").cast("double").alias("dqs_score"), "position"
    ).orderBy("lookup_code", "position", "dataset_name")


def score_bands(runs: DataFrame, bands=c.SCORE_BANDS) -> DataFrame:
    """Band of every day's newest score and its change since the dataset's previous day."""
    daily = latest_rerun(
        runs.filter(F.col("dqs_score").isNotNull()), ["dataset_name", "partition_date"], _newest_first()
    )
    w = Window.partitionBy("dataset_name").orderBy("partition_date")
    delta = F.col("dqs_score") - F.lag("dqs_score").over(w)
    return daily.withColumn("_delta", delta).select(
        "dataset_name", "partition_date",
        F.col("dqs_score").cast("double").alias("dqs_score"),
        verdicts.score_band(F.col("dqs_score"), bands).alias("band"),
        F.col("_delta").cast("double").alias("delta"),
        F.when(F.col("_delta") > 0, "up").when(F.col("_delta") < 0, "down")
        .when(F.col("_delta") == 0, "flat").alias("direction"),
    )
