"""Checks on one dataset partition against its own history."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline import constants as c
from plumbline.functions import verdicts
from plumbline.operators.baseline import previous_values, rolling_baseline

DAY = "partition_date"


def _with_verdict(df: DataFrame, verdict) -> DataFrame:
    return (
        df.withColumn("_v", verdict)
        .withColumns({"status": F.col("_v.status"), "reason": F.col("_v.reason")})
        .drop("_v")
    )


def volume_status(counts: DataFrame) -> DataFrame:
    """Row counts against the earlier ones of the dataset."""
    based = rolling_baseline(counts, "row_count", ["dataset_name"])
    x, mean = F.col("row_count").cast("double"), F.col("baseline_mean")
    n = F.col("baseline_count")
    known = (n >= c.BASELINE_MIN_SAMPLES) & (mean > 0.0)
    based = based.withColumn(
        "pct_change",
        F.when(known, (x - mean) / F.nullif(mean, F.lit(0.0)) * 100.0).otherwise(0.0),
    ).withColumn("row_count_stddev", F.coalesce("baseline_stddev", F.lit(0.0)))
    return _with_verdict(based, verdicts.volume(x, mean, F.col("baseline_stddev"), n))


def zero_row_status(expected: DataFrame, counts: DataFrame) -> DataFrame:
    """Expected partitions without rows; a plain groupBy cannot see them."""
    found = expected.join(counts, list(c.KEYS), "left").select(
        *c.KEYS, F.coalesce("row_count", F.lit(0)).alias("row_count")
    )
    return _with_verdict(
        found,
        verdicts.decide([(F.col("row_count") == 0, c.FAIL, "zero_rows")], (c.PASS, "has_rows")),
    )


def freshness_status(staleness: DataFrame) -> DataFrame:
    """Staleness hours against the earlier ones; NOT_RUN where none could be told."""
    based = rolling_baseline(staleness, "hours_since_update", ["dataset_name"])
    rule = verdicts.freshness(
        F.col("hours_since_update"), F.col("baseline_mean"), F.col("baseline_stddev"),
        F.col("baseline_count"),
    )
    return _with_verdict(based, rule)


def missing_freshness_column(partitions: DataFrame) -> DataFrame:
    """Verdict rows for partitions whose schema has no event-time column."""
    return partitions.select(
        *c.KEYS,
        F.lit(c.NOT_RUN).alias("status"),
        F.lit("missing_source_event_timestamp").alias("reason"),
    )


def ops_column_status(rates: DataFrame) -> DataFrame:
    """NULL rate of every column against its earlier ones."""
    based = rolling_baseline(rates, "null_rate_pct", ["dataset_name", "column_name"])
    verdict = verdicts.null_rate(
        F.col("null_rate_pct"), F.col("baseline_mean"), F.col("baseline_stddev"),
        F.col("baseline_count"),
    )
    out = _with_verdict(based, verdict)
    return out.withColumn(
        "severity",
        F.when(F.col("reason") == "all_null_column", "critical")
        .when(F.col("status") == c.FAIL, "fail")
        .when(F.col("status") == c.WARN, "warn"),
    )


def ops_anomalies(rates: DataFrame) -> DataFrame:
    return ops_column_status(rates).filter(F.col("severity").isNotNull())


def ops_status(rates: DataFrame) -> DataFrame:
    """Worst column per partition; within one severity the first in schema order."""
    columns = ops_column_status(rates)
    rank = (
        F.when(F.col("severity") == "critical", 0)
        .when(F.col("severity") == "fail", 1)
        .when(F.col("severity") == "warn", 2)
    )
    order = F.struct(rank.alias("rank"), F.col("column_ordinal").alias("ordinal"))
    reason_code = F.when(F.col("reason") == "all_null_column", 0).when(
        F.col("reason") == "above_fail_threshold", 1).otherwise(2)
    summary = columns.groupBy(*c.KEYS).agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.count("severity").alias("flagged_columns"),
        F.sum("baseline_count").alias("baseline_sample_count"),
        F.count_if(F.col("baseline_count") >= c.BASELINE_MIN_SAMPLES).alias("_available"),
        F.min_by(reason_code, F.when(F.col("severity").isNotNull(), order)).alias("_worst"),
    )
    worst = F.col("_worst")
    none = F.col("flagged_columns") == 0
    return _with_verdict(
        summary,
        verdicts.decide(
            [
                (none & (F.col("_available") == 0), c.PASS, "baseline_unavailable"),
                (none, c.PASS, "within_baseline"),
                (worst == 0, c.FAIL, "all_null_column"),
                (worst == 1, c.FAIL, "above_fail_threshold"),
            ],
            (c.WARN, "above_warn_threshold"),
        ),
    ).drop("_worst", "_available")


def distribution_shift(stats: DataFrame) -> DataFrame:
    """Column means against the mean and spread of the previous partition."""
    based = previous_values(
        stats, ["mean", "stddev"], ["dataset_name", "column_path"], prefix="baseline_"
    )
    mean, bm, bs = F.col("mean"), F.col("baseline_mean"), F.col("baseline_stddev")
    scored = based.withColumn("z_score", F.when(bm.isNotNull(), verdicts.shift_score(mean, bm, bs)))
    return _with_verdict(scored, verdicts.shift(mean, bm, bs))


def distribution_summary(shifts: DataFrame, partitions: DataFrame | None = None) -> DataFrame:
    """Worst column status per partition.

    ``partitions`` adds the partitions without any numeric column.
    """
    rolled = shifts.groupBy(*c.KEYS).agg(
        verdicts.from_severity(F.max(verdicts.severity(F.col("status")))).alias("status"),
        F.count(F.lit(1)).alias("total_columns_analyzed"),
        F.count_if(F.col("status").isin(c.WARN, c.FAIL)).alias("shifted_columns"),
    )
    return _complete(rolled, partitions, "no_numeric_columns", ["total_columns_analyzed", "shifted_columns"])


def timestamp_sanity_status(counts: DataFrame) -> DataFrame:
    return _with_verdict(
        counts, verdicts.timestamp_sanity(F.col("future_pct"), F.col("stale_pct"))
    )


def timestamp_sanity_summary(status: DataFrame, partitions: DataFrame | None = None) -> DataFrame:
    failed = F.count_if(F.col("status") == c.FAIL)
    rolled = status.groupBy(*c.KEYS).agg(
        F.when(failed > 0, c.FAIL).otherwise(c.PASS).alias("status"),
        F.count(F.lit(1)).alias("total_columns_analyzed"),
        failed.alias("failed_columns"),
    )
    return _complete(rolled, partitions, "no_timestamp_columns", ["total_columns_analyzed", "failed_columns"])


def _complete(rolled: DataFrame, partitions: DataFrame | None, reason: str, counts) -> DataFrame:
    if partitions is None:
        return rolled.withColumn("reason", F.lit(None).cast("string"))
    absent = F.col("status").isNull()
    return partitions.select(*c.KEYS).join(rolled, list(c.KEYS), "left").withColumns(
        {
            "reason": F.when(absent, reason),
            "status": F.coalesce("status", F.lit(c.PASS)),
            **{x: F.coalesce(x, F.lit(0).cast("bigint")) for x in counts},
        }
    )
