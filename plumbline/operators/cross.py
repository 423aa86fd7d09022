"""Checks that compare datasets with each other or with their run history.

Run rows are first reduced to (dataset, day); everything after works on that
size.  Sources are matched by equality on the parsed segment, so no dataset is
ever paired with another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline import constants as c
from plumbline.functions import verdicts
from plumbline.functions.columns import as_column, date_at_midnight, mean_of, seconds_between
from plumbline.functions.naming import source_system, source_system_group
from plumbline.operators import patterns
from plumbline.operators.baseline import calendar_window

DATASET, DAY = c.KEYS


def _expand(df: DataFrame, verdict: Column) -> DataFrame:
    return (
        df.withColumn("_v", verdict)
        .withColumns({"status": F.col("_v.status"), "reason": F.col("_v.reason")})
        .drop("_v")
    )


def _daily(runs: DataFrame) -> DataFrame:
    """One row per (dataset, day): score sum, count and minimum, worst flags."""
    return runs.groupBy(DATASET, DAY).agg(
        F.sum("dqs_score").alias("score_sum"),
        F.count("dqs_score").alias("score_count"),
        F.min("dqs_score").alias("score_min"),
        F.max(
            F.col("dqs_score").isNotNull()
            & ((F.col("dqs_score") < c.UPSTREAM_FAIL_BELOW) | (F.col("check_status") == c.FAIL))
        ).alias("failing"),
    ).withColumns(
        {"src_sys_nm": source_system(F.col(DATASET)), "src_group": source_system_group(F.col(DATASET))}
    )


def sla_countdown(partitions: DataFrame, enrichment: DataFrame, as_of) -> DataFrame:
    """Whole hours since the partition's midnight against the configured SLA.

    Partitions without an SLA give no row.
    """
    slas = patterns.sla_hours(partitions, enrichment)
    # truncated towards zero, also for partitions dated ahead of the clock
    elapsed = (seconds_between(date_at_midnight(F.col(DAY)), as_column(as_of)) / 3600).cast("bigint")
    sla = F.col("sla_hours").cast("double")
    out = partitions.join(slas, DATASET).withColumns(
        {"sla_hours": sla, "hours_remaining": sla - elapsed, "warn_threshold": sla * c.SLA_WARN_SHARE}
    )
    return _expand(out, verdicts.sla_countdown(F.col("hours_remaining"), sla))


def source_health(runs: DataFrame) -> DataFrame:
    """Average score and dataset count of each partition's source over its last 8 days."""
    daily = _daily(runs)
    # a scored day counts its dataset from that day until it leaves the window or the
    # dataset's next scored day takes over: one entry and one exit, never overlapping
    following = F.expr(
        f"lead(CASE WHEN score_count > 0 THEN {DAY} END) IGNORE NULLS "
        f"OVER (PARTITION BY {DATASET} ORDER BY {DAY})"
    )
    daily_next = daily.filter(F.col("src_group").isNotNull()).withColumn("_next", following)
    leaves = F.date_add(DAY, c.SOURCE_HEALTH_DAYS + 1)
    scored = F.when(F.col("score_count") > 0, 1).otherwise(0)
    changes = daily_next.select(
        F.col("src_group").alias("src_sys_nm"),
        F.inline(
            F.array(
                F.struct(F.col(DAY).alias(DAY), scored.alias("delta"), "score_sum", "score_count"),
                F.struct(
                    F.least(leaves, F.coalesce("_next", leaves)).alias(DAY), (-scored).alias("delta"),
                    F.lit(None).cast(daily.schema["score_sum"].dataType).alias("score_sum"),
                    F.lit(0).cast("bigint").alias("score_count"),
                ),
            )
        ),
    )
    per_day = changes.groupBy("src_sys_nm", DAY).agg(
        F.sum("delta").alias("delta"), F.sum("score_sum").alias("s"), F.sum("score_count").alias("n")
    )
    recent = calendar_window(["src_sys_nm"], -c.SOURCE_HEALTH_DAYS, 0)
    so_far = Window.partitionBy("src_sys_nm").orderBy(DAY)
    present = F.sum("delta").over(so_far)
    per_source = per_day.select(
        "src_sys_nm", DAY,
        F.sum("s").over(recent).alias("_sum"), F.sum("n").over(recent).alias("_count"),
        F.when(present > 0, present).alias("dataset_count"),
    )
    joined = daily.select(DATASET, DAY, "src_sys_nm").join(per_source, ["src_sys_nm", DAY], "left")
    score = mean_of(F.col("_sum"), F.col("_count")).cast("double")
    none = F.lit(None).cast("string")
    out = joined.select(DATASET, DAY, "src_sys_nm", score.alias("aggregate_score"), "dataset_count")
    return _expand(
        out,
        verdicts.decide(
            [
                (F.col("src_sys_nm").isNull(), c.PASS, "no_source_system_segment"),
                (F.col("dataset_count").isNull(), c.PASS, "no_history_available"),
                (F.col("aggregate_score") < c.SOURCE_HEALTH_FAIL_BELOW, c.FAIL, none),
                (F.col("aggregate_score") < c.SOURCE_HEALTH_WARN_BELOW, c.WARN, none),
            ],
            (c.PASS, none),
        ),
    )


def correlation(runs: DataFrame) -> DataFrame:
    """Share of a source's datasets that fell more than 10 points below their own
    average of the 8 days before, on the same day."""
    daily = _daily(runs)
    before = calendar_window([DATASET], -c.CORRELATION_DAYS, -1)
    own = mean_of(F.sum("score_sum").over(before), F.sum("score_count").over(before))
    marked = daily.withColumn("_own", own)
    per_source = (
        marked.filter((F.col("score_count") > 0) & F.col("src_group").isNotNull())
        .groupBy(F.col("src_group").alias("src_sys_nm"), DAY)
        .agg(
            F.count(F.lit(1)).alias("total_dataset_count"),
            F.count_if(F.col("score_min") < F.col("_own") - c.CORRELATION_DROP)
            .alias("correlated_dataset_count"),
        )
    )
    joined = daily.select(DATASET, DAY, "src_sys_nm").join(per_source, ["src_sys_nm", DAY], "left")
    ratio = F.col("correlated_dataset_count").cast("double") / F.col("total_dataset_count")
    none = F.lit(None).cast("string")
    out = joined.withColumn("correlation_ratio", ratio)
    return _expand(
        out,
        verdicts.decide(
            [
                (F.col("src_sys_nm").isNull(), c.PASS, "no_source_system_segment"),
                (F.col("total_dataset_count").isNull(), c.PASS, "no_current_day_data"),
                (F.col("correlation_ratio") >= c.CORRELATION_FAIL_AT, c.FAIL, none),
                (F.col("correlation_ratio") >= c.CORRELATION_WARN_AT, c.WARN, none),
            ],
            (c.PASS, none),
        ),
    )


def lineage(runs: DataFrame) -> DataFrame:
    """Datasets of all other sources on the day, and how many of them fail.

    Everything minus the own source: two groupings instead of a pairing.
    """
    daily = _daily(runs)
    scored = F.col("score_count") > 0
    own = daily.groupBy(F.col("src_group").alias("src_sys_nm"), DAY).agg(
        F.count_if(scored).alias("_own_n"), F.count_if(scored & F.col("failing")).alias("_own_bad")
    )
    # totals come from the few rows per source and meet them there: no join of datasets on the day alone
    total = own.groupBy(DAY).agg(F.sum("_own_n").alias("_n"), F.sum("_own_bad").alias("_bad"))
    joined = daily.select(DATASET, DAY, "src_sys_nm").join(own.join(total, DAY), ["src_sys_nm", DAY], "left")
    less = lambda whole, part: F.coalesce(whole, F.lit(0)) - F.coalesce(part, F.lit(0))
    known = F.col("src_sys_nm").isNotNull()
    upstream = less("_n", "_own_n")
    out = joined.select(
        DATASET, DAY, "src_sys_nm",
        F.when(known & (upstream > 0), upstream).alias("upstream_dataset_count"),
        F.when(known & (upstream > 0), less("_bad", "_own_bad")).alias("upstream_failed_count"),
    )
    none = F.lit(None).cast("string")
    return _expand(
        out,
        verdicts.decide(
            [
                (F.col("src_sys_nm").isNull(), c.PASS, "no_source_system_segment"),
                (F.col("upstream_dataset_count").isNull(), c.PASS, "no_upstream_datasets"),
                (F.col("upstream_failed_count") > 0, c.WARN, none),
            ],
            (c.PASS, none),
        ),
    )


def cross_destination(runs: DataFrame, keys=c.KEYS) -> DataFrame:
    """Spread of the scores of several active runs of one partition.

    Runs are first counted per distinct score.  A DECIMAL(5,2) has a bounded
    number of values, so a key never gathers more rows than that.
    """
    keys = list(keys)
    scores = runs.groupBy(*keys, "dqs_score").agg(F.count(F.lit(1)).alias("n"))
    score = F.col("dqs_score").cast("double")
    weighted = F.col("n").cast("decimal(20,0)") * F.col("dqs_score")
    means = scores.groupBy(*keys).agg(
        F.sum(F.when(score.isNotNull(), F.col("n"))).alias("destination_count"),
        F.sum(weighted).alias("_sum"),
        F.collect_list(F.when(score.isNotNull(), F.struct(score.alias("s"), "n"))).alias("_scores"),
    )
    mean = (F.col("_sum").cast("double") / F.col("destination_count"))
    several = F.col("destination_count") > 1
    out = means.withColumn("mean_score", F.when(several, mean))
    off = lambda x: F.abs(x["s"] - F.col("mean_score"))
    beyond = F.filter("_scores", lambda x: off(x) > c.DESTINATION_MAX_DEVIATION)
    out = out.select(
        *keys,
        F.when(several, F.col("destination_count")).alias("destination_count"),
        "mean_score",
        F.when(several, F.array_max(F.transform("_scores", off))).alias("max_deviation"),
        F.when(several, F.aggregate(beyond, F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"]))
        .alias("inconsistent_destination_count"),
    )
    none = F.lit(None).cast("string")
    return _expand(
        out,
        verdicts.decide(
            [
                (F.col("destination_count").isNull(), c.PASS, "single_destination"),
                (F.col("inconsistent_destination_count") > 0, c.FAIL, none),
            ],
            (c.PASS, none),
        ),
    )


def inferred_sla(hours: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Delivery hours against mean + 2 sigma of the last 30 days before.

    ``hours`` has one row per (dataset, day) with ``hours_since_update``.
    Datasets with an explicit SLA are left to :func:`sla_countdown`.
    """
    explicit = patterns.sla_hours(hours, enrichment).select(DATASET)
    own = hours.join(explicit, DATASET, "left_anti").filter(F.col("hours_since_update").isNotNull())
    before = calendar_window([DATASET], -c.INFERRED_SLA_DAYS, -1)
    h = F.col("hours_since_update")
    stats = own.withColumns(
        {
            "data_points": F.count(h).over(before),
            "_mean": F.avg(h).over(before),
            "_stddev": F.stddev_pop(h).over(before),
        }
    )
    enough = F.col("data_points") + 1 >= c.INFERRED_SLA_MIN_POINTS
    inferred = F.when(enough, F.col("_mean") + F.col("_stddev") * c.INFERRED_SLA_SIGMAS)
    out = stats.withColumns(
        {
            "mean_hours": F.when(enough, F.col("_mean")),
            "stddev_hours": F.when(enough, F.col("_stddev")),
            "inferred_sla_hours": inferred,
            "deviation_from_inferred": h - inferred,
            # short histories report all their points, the current one included
            "data_points": F.when(enough, F.col("data_points")).otherwise(F.col("data_points") + 1),
        }
    ).drop("_mean", "_stddev")
    points = F.when(F.col("inferred_sla_hours").isNull(), 0).otherwise(c.INFERRED_SLA_MIN_POINTS)
    return _expand(
        out,
        verdicts.inferred_sla(points, F.col("deviation_from_inferred"), F.col("inferred_sla_hours")),
    )
