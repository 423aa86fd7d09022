"""Quantile sketches that are stored per partition and merged over any set of partitions.

A KLL sketch of a column holds some ``K`` values per level, about 10 KB for any number of rows.  The
sketches of days, reruns, sources or schema families merge to that of their union without the
rows; its quantiles are exact up to ``RANK_ERROR`` of the rank (and exact for up to ``K`` values).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plumbline import constants as c
from plumbline.functions.columns import named
from plumbline.operators import profile

K = 800
#: Difference of a quantile's true rank from the asked one, with 99 % confidence.
RANK_ERROR = 0.005


def column_sketches(df: DataFrame, keys: Sequence[str] = c.KEYS, columns: Sequence[str] | None = None, k: int = K) -> DataFrame:
    """(keys, column_path, sketch): one row per key and numeric column, from one scan.

    Partial sketches are merged on the map side, so a hot key sends one sketch per task.
    """
    listed = profile.numeric_columns(df, keys) if columns is None else list(columns)
    sums = [F.kll_sketch_agg_double(named(x).cast("double"), k).alias(f"_sketch_{n}") for n, x in enumerate(listed)]
    rows = F.array(*(F.struct(F.lit(x).alias("column_path"), F.col(f"_sketch_{n}").alias("sketch")) for n, x in enumerate(listed)))
    return df.groupBy(*keys).agg(*sums).select(*keys, F.inline(rows))


def merged(sketches: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """(keys, column_path, sketch) of the union of the partitions that share the keys."""
    return sketches.groupBy(*keys, "column_path").agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))


def quantiles(sketches: DataFrame, probabilities: dict[str, float], sketch: str = "sketch") -> DataFrame:
    """The sketches' rows with ``sample_count`` and a column per probability; NULL without values."""
    n = F.kll_sketch_get_n_double(sketch)
    return sketches.withColumns({
        "sample_count": n,
        **{x: F.when(n > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(p))) for x, p in probabilities.items()},
    }).drop(sketch)
