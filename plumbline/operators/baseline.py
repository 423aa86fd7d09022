"""Baselines from metric history.

All windows run after history is reduced to one row per (key, day), so a window
group holds at most one row per calendar day, however many rows the monitored
dataset has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline import constants as c
from plumbline.functions.columns import day_number

METRIC_KEYS = ("dataset_name", "check_type", "metric_name")


def latest_rerun(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Keep the newest row per key.

    ``row_number() = 1`` lets Spark prune to one row per key and task before the
    shuffle, so a hot key never travels whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def rolling_baseline(
    history: DataFrame,
    value: str = "metric_value",
    keys: Sequence[str] = METRIC_KEYS,
    day: str = "partition_date",
    rows: int = c.BASELINE_ROWS,
) -> DataFrame:
    """Mean, population stddev and count of the ``rows`` earlier values per key.

    NULL values take a place in the frame but not in the statistics.
    """
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(-rows, -1)
    v = F.col(value).cast("double")
    return history.withColumns(
        {
            "baseline_mean": F.avg(v).over(w),
            "baseline_stddev": F.stddev_pop(v).over(w),
            "baseline_count": F.count(v).over(w),
        }
    )


# ---- kept state: what the next day needs of all days before it ---------------

def kept_values(history: DataFrame, value: str = "metric_value", keys: Sequence[str] = METRIC_KEYS,
                day: str = "partition_date", rows: int = c.KEPT_ROWS) -> DataFrame:
    """One row per key with its newest ``rows`` (day, value), newest last; NULL values included.

    The limit is applied before the shuffle, so an array never holds more.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc(day))
    recent = history.withColumn("_nth", F.row_number().over(newest)).filter(F.col("_nth") <= rows)
    pair = F.struct(F.col(day).alias("day"), F.col(value).cast("double").alias("value"))
    return recent.groupBy(*keys).agg(F.array_sort(F.collect_list(pair)).alias("kept"))


def kept_history(state: DataFrame, value: str = "metric_value", keys: Sequence[str] = METRIC_KEYS,
                 day: str = "partition_date") -> DataFrame:
    """The kept values as history rows."""
    return state.select(*keys, F.inline("kept")).withColumnsRenamed({"day": day, "value": value})


def advanced(state: DataFrame | None, fresh: DataFrame, value: str = "metric_value", keys: Sequence[str] = METRIC_KEYS,
             day: str = "partition_date", rows: int = c.KEPT_ROWS) -> DataFrame:
    """The state after a batch: fresh values replace kept ones of the same day."""
    new = fresh.select(*keys, day, F.col(value).cast("double").alias(value), F.lit(1).alias("_new"))
    if state is None:
        return kept_values(new, value, keys, day, rows)
    old = kept_history(state, value, keys, day).select(*keys, day, value, F.lit(0).alias("_new"))
    return kept_values(latest_rerun(old.unionByName(new), [*keys, day], [F.desc("_new")]), value, keys, day, rows)


def rolled(kept: DataFrame | None, fresh: DataFrame, value: str = "metric_value", keys: Sequence[str] = METRIC_KEYS,
           day: str = "partition_date", rows: int = c.KEPT_ROWS) -> DataFrame:
    """Baselines of a batch and the rows to keep after it, with one shuffle and one sort.

    ``kept``: the ``is_kept`` rows after the batch before.  Rows of the batch are ``is_new`` and have the columns of
    :func:`rolling_baseline`; they replace kept ones of the same day.
    """
    known = fresh.select(*keys, day, F.col(value).cast("double").alias(value), F.lit(True).alias("is_new"))
    if kept is not None:
        known = kept.select(*keys, day, value, F.lit(False).alias("is_new")).unionByName(known)
    of_key = Window.partitionBy(*keys)
    before = F.lag(day).over(of_key.orderBy(day, F.desc("is_new")))
    once = known.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col(day))).drop("_before")
    out = rolling_baseline(once, value, keys, day).withColumns({
        "_nth": F.row_number().over(of_key.orderBy(day)), "_all": F.count(F.lit(1)).over(of_key)})
    stats = ("baseline_mean", "baseline_stddev", "baseline_count")
    out = out.withColumns({x: F.when(F.col("is_new"), F.col(x)) for x in stats})
    return out.withColumn("is_kept", F.col("_all") - F.col("_nth") < rows).drop("_nth", "_all").filter("is_new OR is_kept")


def reaches(state: DataFrame, first_day, need: int = c.BASELINE_ROWS, rows: int = c.KEPT_ROWS) -> bool:
    """Whether the state still holds the ``need`` values before a day, for every key that ever had them."""
    before = F.size(F.filter("kept", lambda x: x["day"] < F.lit(first_day)))
    return state.filter((F.size("kept") >= rows) & (before < need)).isEmpty()


def previous_values(
    history: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str],
    day: str = "partition_date",
    prefix: str = "previous_",
) -> DataFrame:
    """The same columns as of the key's previous day."""
    w = Window.partitionBy(*keys).orderBy(day)
    return history.withColumns({f"{prefix}{x}": F.lag(x).over(w) for x in columns})


def latest_column_stats(metrics: DataFrame) -> DataFrame:
    """Latest earlier value of every column statistic, one row per (dataset, day, column).

    Metric names are ``<column path>.<statistic>``; the path may itself hold dots.
    """
    stats = metrics.filter(F.col("check_type") == c.DISTRIBUTION).select(
        "dataset_name",
        "partition_date",
        F.regexp_extract("metric_name", r"^(.*)\.([^.]+)$", 1).alias("column_path"),
        F.regexp_extract("metric_name", r"^(.*)\.([^.]+)$", 2).alias("stat"),
        "metric_value",
    )
    prior = previous_values(
        stats, ["metric_value"], ["dataset_name", "column_path", "stat"]
    ).filter(F.col("previous_metric_value").isNotNull())
    pick = lambda s: F.max(F.when(F.col("stat") == s, F.col("previous_metric_value")))
    return prior.groupBy("dataset_name", "partition_date", "column_path").agg(
        *(
            F.coalesce(pick(s), F.lit(0.0)).alias(f"baseline_{s}")
            for s in ("mean", "stddev", "p50", "p95", "count")
        )
    )


def calendar_window(keys: Sequence[str], first: int, last: int, day: str = "partition_date"):
    """RANGE frame in days relative to the current row (negative = earlier)."""
    return Window.partitionBy(*keys).orderBy(day_number(F.col(day))).rangeBetween(first, last)
