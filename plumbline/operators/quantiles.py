"""Exact quantiles of groups of any size.

One ``percentile_approx`` sketch per group holds every value while there are fewer than
``EXACT_BELOW``.  For larger groups the same sketch gives bounds around each quantile; the values
are read once more, counted below the bounds and listed with their counts between them, so only
a small part of a group ever comes together.  A quantile is the least value whose rank reaches the
asked share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline import constants as c
from plumbline.session import scratch_folder, staged

PERCENTS = (50, 95)
#: A sketch of fewer values merges none of them.
EXACT_BELOW = c.PERCENTILE_ACCURACY // 2
#: Distance of the bounds from the asked share; wider ones are used where the quantile lies outside, none at last.
_WIDTHS = (4 / c.PERCENTILE_ACCURACY, 0.02)


def sketch(value: Column) -> Column:
    """The quantiles, as far as the sketch knows, followed by the bounds of each."""
    asked = [x / 100 for x in PERCENTS]
    bounds = [min(max(p + side * width, 0.0), 1.0) for width in _WIDTHS for p in asked for side in (-1, 1)]
    return F.percentile_approx(value, asked + bounds, c.PERCENTILE_ACCURACY)


def same(left: str, right: str, columns: Sequence[str]) -> Column:
    """Equality of the columns of two aliased frames, NULL equal to NULL."""
    return reduce(Column.__and__, (F.col(f"{left}.`{x}`").eqNullSafe(F.col(f"{right}.`{x}`")) for x in columns))


def exact(values: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame | None:
    """(by, exact): the array of quantiles of every group of ``EXACT_BELOW`` values or more; None without any.

    ``values``: (by, value).  ``found``: (by, n, sketch), n the number of values that are not NULL.
    """
    spark, by = values.sparkSession, list(by)
    large = found.filter(F.col("n") >= EXACT_BELOW)
    if large.isEmpty():
        return None
    # the least rank that reaches the share, in integers
    asked = F.array(*(
        F.struct(F.lit(nth).alias("nth"), (F.col("n") - F.floor(F.col("n") * (100 - p) / 100)).cast("bigint").alias("rank"))
        for nth, p in enumerate(PERCENTS)
    ))
    todo, key, parts = large.select(*by, "sketch", F.inline(asked)), [*by, "nth"], []
    for step in range(len(_WIDTHS) + 1):
        low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
        if step < len(_WIDTHS):
            at = len(PERCENTS) * (1 + 2 * step) + 2 * F.col("nth")
            low, high = F.get("sketch", at), F.get("sketch", at + 1)
        bounds = todo.select(*by, "nth", "rank", low.alias("low"), high.alias("high"))
        near = values.filter(F.col("value").isNotNull()).alias("v").join(bounds.alias("b"), same("v", "b", by)).filter(
            F.col("high").isNull() | (F.col("value") <= F.col("high")))
        # NULL stands for all values below the bounds
        inside = F.when(F.col("low").isNull() | (F.col("value") >= F.col("low")), F.col("value"))
        counts = near.select(*(F.col(f"b.`{x}`").alias(x) for x in by), "nth", "rank", inside.alias("value")).groupBy(
            *key, "rank", "value").agg(F.count(F.lit(1)).alias("rows"))
        up_to = F.sum("rows").over(Window.partitionBy(*key).orderBy(F.asc_nulls_first("value")).rowsBetween(
            Window.unboundedPreceding, Window.currentRow))
        reached = counts.withColumn("up_to", up_to).filter(
            F.col("value").isNotNull() & (F.col("up_to") >= F.col("rank")) & (F.col("up_to") - F.col("rows") < F.col("rank")))
        hits = staged(reached.select(*key, "value"), scratch_folder(spark))
        parts.append(hits)
        todo = staged(todo.alias("t").join(hits.alias("h"), same("t", "h", key), "left_anti"), scratch_folder(spark))
        if todo.isEmpty():
            break
    picked = (F.max(F.when(F.col("nth") == nth, F.col("value"))) for nth in range(len(PERCENTS)))
    return reduce(DataFrame.unionByName, parts).groupBy(*by).agg(F.array(*picked).alias("exact"))
