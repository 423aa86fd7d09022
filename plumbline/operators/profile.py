"""One-pass profiling of monitored rows.

All measures of one scan go into a single ``groupBy(keys).agg(...)``: partial
aggregation happens before the shuffle, so a partition holding most of the rows
costs one buffer per task, and the shuffle carries at most one row per task and
key.  Only the aggregated rows are turned from wide to long.  Quantiles of keys with many rows
take a second look at the values, see :mod:`plumbline.operators.quantiles`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline import constants as c
from plumbline.functions.columns import (
    as_column, count_where, date_at_midnight, named, ntz, percent, seconds_between, share,
)
from plumbline.operators import quantiles
from plumbline.session import scratch_folder, staged

NUMERIC_TYPES = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TIMESTAMP_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


@dataclass
class Measures:
    """Aggregate expressions of one family plus how to read them back as rows."""

    aggregates: dict[str, Column] = field(default_factory=dict)   # by output name
    inputs: dict[str, Column] = field(default_factory=dict)       # computed once per row
    sketches: dict[str, tuple[str, str]] = field(default_factory=dict)   # aggregate -> its input and count
    rows: list[Column] = field(default_factory=list)        # struct per output row
    metrics: list[Column] = field(default_factory=list)     # long metric structs

    def metric(self, check_type: str, name: str, value: Column) -> None:
        self.metrics.append(
            F.struct(
                F.lit(check_type).alias("check_type"),
                F.lit(name).alias("metric_name"),
                value.cast("double").alias("metric_value"),
            )
        )


def value_columns(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [f for f in df.schema.fields if f.name not in keys]


def numeric_columns(df: DataFrame, keys: Sequence[str] = c.KEYS) -> list[str]:
    """Integer, long, float, double and decimal columns, in schema order."""
    return [f.name for f in value_columns(df, keys) if isinstance(f.dataType, NUMERIC_TYPES)]


def timestamp_columns(df: DataFrame, keys: Sequence[str] = c.KEYS) -> list[str]:
    return [f.name for f in value_columns(df, keys) if isinstance(f.dataType, TIMESTAMP_TYPES)]


# ---- families ---------------------------------------------------------------

def volume_measures() -> Measures:
    m = Measures({"row_count": F.count(F.lit(1))})
    m.metric(c.VOLUME, "row_count", F.col("row_count"))
    return m


def freshness_measures(df: DataFrame, column: str, as_of) -> Measures:
    """Latest parseable event time and whole-second staleness against ``as_of``.

    ``as_of`` is a timestamp, or a column over the keys (one clock per partition).
    """
    m = Measures()
    if column not in df.columns:
        return m
    source = named(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        source = F.try_to_timestamp(source)
    m.aggregates["latest_event"] = F.max(ntz(source))
    latest = F.col("latest_event")
    hours = F.when(
        latest.isNotNull(),
        F.greatest(F.lit(0.0), seconds_between(latest, as_column(as_of)) / 3600.0),
    )
    m.rows.append(F.struct(latest.alias("latest_event"), hours.alias("hours_since_update")))
    m.metric(c.FRESHNESS, "hours_since_update", hours)
    return m


def null_rate_measures(df: DataFrame, keys: Sequence[str] = c.KEYS, columns=None) -> Measures:
    """NULL share of every column, blank share of string columns."""
    m = Measures({"row_count": F.count(F.lit(1))})
    fields = [f for f in value_columns(df, keys) if columns is None or f.name in columns]
    total = F.col("row_count")
    for i, f in enumerate(fields):
        source = named(f.name)
        nulls, blanks = f"nulls_{i}", f"blanks_{i}"
        m.aggregates[nulls] = count_where(source.isNull())
        null_pct = percent(F.col(nulls), total)
        blank_count = F.lit(None).cast("bigint")
        blank_pct = F.lit(None).cast("double")
        m.metric(c.OPS, f"null_rate_pct::{f.name}", null_pct)
        if isinstance(f.dataType, T.StringType):
            m.aggregates[blanks] = count_where(F.length(F.trim(source)) == 0)
            blank_count, blank_pct = F.col(blanks), percent(F.col(blanks), total)
            m.metric(c.OPS, f"empty_string_rate_pct::{f.name}", blank_pct)
        m.rows.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(i).alias("column_ordinal"),
                total.alias("row_count"),
                F.col(nulls).alias("null_count"),
                blank_count.alias("blank_count"),
                null_pct.alias("null_rate_pct"),
                blank_pct.alias("empty_rate_pct"),
            )
        )
    return m


def distribution_measures(sources: Sequence[tuple[str, Column]], percentiles: bool = True) -> Measures:
    """mean, population stddev, p50, p95 and non-null count per (path, expression)."""
    m = Measures()
    for i, (path, source) in enumerate(sources):
        # several aggregates read one projected value, so JSON is parsed once per row
        m.inputs[f"_value_{i}"] = source.cast("double")
        value = F.col(f"_value_{i}")
        m.aggregates |= {
            f"mean_{i}": F.avg(value),
            f"stddev_{i}": F.stddev_pop(value),
            f"n_{i}": F.count(value),
        }
        stats = {
            "mean": F.coalesce(F.col(f"mean_{i}"), F.lit(0.0)),
            "stddev": F.coalesce(F.col(f"stddev_{i}"), F.lit(0.0)),
            "count": F.col(f"n_{i}"),
        }
        if percentiles:
            # one sketch answers both quantiles
            m.aggregates[f"pct_{i}"] = quantiles.sketch(value)
            m.sketches[f"pct_{i}"] = (f"_value_{i}", f"n_{i}")
            for j, name in enumerate(("p50", "p95")):
                stats[name] = F.coalesce(F.get(F.col(f"pct_{i}"), F.lit(j)), F.lit(0.0))
        m.rows.append(
            F.struct(
                F.lit(path).alias("column_path"),
                *(stats[s].alias(s) for s in ("mean", "stddev", "p50", "p95") if s in stats),
                stats["count"].alias("sample_count"),
            )
        )
        for name in ("mean", "stddev", "p50", "p95", "count"):
            if name in stats:
                m.metric(c.DISTRIBUTION, f"{path}.{name}", stats[name])
    return m


def timestamp_measures(columns: Sequence[str], partition_date: Column) -> Measures:
    """Counts of values after the day following, or ten years before, the partition."""
    m = Measures()
    future_from = ntz(F.date_add(partition_date, c.FUTURE_TOLERANCE_DAYS))
    stale_before = ntz(F.add_months(partition_date, -12 * c.MAX_AGE_YEARS))
    for i, name in enumerate(columns):
        value = ntz(named(name))
        m.aggregates |= {
            f"ts_n_{i}": F.count(value),
            f"ts_future_{i}": count_where(value > future_from),
            f"ts_stale_{i}": count_where(value < stale_before),
        }
        n = F.col(f"ts_n_{i}")
        future, stale = share(F.col(f"ts_future_{i}"), n), share(F.col(f"ts_stale_{i}"), n)
        m.rows.append(
            F.struct(
                F.lit(name).alias("column_name"),
                n.alias("non_null_rows"),
                F.col(f"ts_future_{i}").alias("future_count"),
                F.col(f"ts_stale_{i}").alias("stale_count"),
                future.alias("future_pct"),
                stale.alias("stale_pct"),
            )
        )
        m.metric(c.TIMESTAMP_SANITY, f"future_pct.{name}", future)
        m.metric(c.TIMESTAMP_SANITY, f"stale_pct.{name}", stale)
    return m


# ---- runners ----------------------------------------------------------------

def aggregate(df: DataFrame, families: Sequence[Measures], keys: Sequence[str] = c.KEYS) -> DataFrame:
    """One wide row per key for all families; shared aggregates are computed once.

    Where a key has too many rows for exact quantiles from its sketch, the values are read again.
    """
    chosen: dict[str, Column] = {}
    inputs: dict[str, Column] = {}
    sketched: dict[str, tuple[str, str]] = {}
    for family in families:
        chosen |= family.aggregates
        inputs |= family.inputs
        sketched |= family.sketches
    if inputs:
        df = df.withColumns(inputs)
    wide = df.groupBy(*keys).agg(*(expr.alias(name) for name, expr in chosen.items()))
    if not sketched or row_counts(df, keys).filter(F.col("row_count") >= quantiles.EXACT_BELOW).isEmpty():
        return wide
    return _with_exact_quantiles(df, staged(wide, scratch_folder(df.sparkSession)), sketched, list(keys))


def _with_exact_quantiles(df: DataFrame, wide: DataFrame, sketched: dict[str, tuple[str, str]], keys: list[str]) -> DataFrame:
    """The wide rows with the exact quantiles in place of the sketched ones."""
    found = F.array(*(F.struct(F.lit(x).alias("_of"), F.col(n).alias("n"), F.col(x).alias("sketch")) for x, (_, n) in sketched.items()))
    values = F.array(*(F.struct(F.lit(x).alias("_of"), F.col(v).alias("value")) for x, (v, _) in sketched.items()))
    exact = quantiles.exact(df.select(*keys, F.inline(values)), wide.select(*keys, F.inline(found)), [*keys, "_of"])
    if exact is None:
        return wide
    per_key = exact.groupBy(*keys).agg(*(F.max(F.when(F.col("_of") == x, F.col("exact"))).alias(f"exact_{x}") for x in sketched))
    joined = wide.alias("w").join(per_key.alias("e"), quantiles.same("w", "e", keys), "left")
    return joined.select("w.*", *(f"exact_{x}" for x in sketched)).withColumns(
        {x: F.coalesce(f"exact_{x}", x) for x in sketched}).drop(*(f"exact_{x}" for x in sketched))


def rows(df: DataFrame, family: Measures, keys: Sequence[str] = c.KEYS) -> DataFrame:
    """One row per key and column of the family."""
    if not family.rows:
        raise ValueError("nothing to measure: no matching column")
    wide = aggregate(df, [family], keys)
    return wide.select(*keys, F.inline(F.array(*family.rows)))


def metrics(df: DataFrame, families: Sequence[Measures], keys: Sequence[str] = c.KEYS) -> DataFrame:
    """Long metric rows (keys, check_type, metric_name, metric_value) from one scan."""
    structs = [s for family in families for s in family.metrics]
    return aggregate(df, families, keys).select(*keys, F.inline(F.array(*structs)))


def row_counts(df: DataFrame, keys: Sequence[str] = c.KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))


def null_rates(df: DataFrame, keys: Sequence[str] = c.KEYS, columns=None) -> DataFrame:
    return rows(df, null_rate_measures(df, keys, columns), keys)


def column_stats(df: DataFrame, keys: Sequence[str] = c.KEYS, columns=None, sources=(),
                 percentiles: bool = True) -> DataFrame:
    """Statistics of plain numeric columns and of extra (path, expression) sources."""
    plain = numeric_columns(df, keys) if columns is None else columns
    listed = [(name, named(name)) for name in plain] + list(sources)
    return rows(df, distribution_measures(listed, percentiles), keys)


def timestamp_sanity(df: DataFrame, keys: Sequence[str] = c.KEYS, columns=None) -> DataFrame:
    listed = timestamp_columns(df, keys) if columns is None else columns
    return rows(df, timestamp_measures(listed, F.col(keys[-1])), keys)


def staleness(df: DataFrame, column: str, as_of, keys: Sequence[str] = c.KEYS) -> DataFrame:
    """(keys, latest_event, hours_since_update); both NULL when nothing parses."""
    return rows(df, freshness_measures(df, column, as_of), keys)


def default_families(df: DataFrame, *, freshness_column: str, as_of, json_sources=(),
                     keys: Sequence[str] = c.KEYS) -> list[Measures]:
    """Every family that applies to the schema of ``df``."""
    numeric = [(name, named(name)) for name in numeric_columns(df, keys)]
    return [
        volume_measures(),
        freshness_measures(df, freshness_column, as_of),
        null_rate_measures(df, keys),
        distribution_measures([*numeric, *json_sources]),
        timestamp_measures(timestamp_columns(df, keys), F.col(keys[-1])),
    ]


def expected_partitions(counts: DataFrame, keys: Sequence[str] = c.KEYS) -> DataFrame:
    """Every dataset on every day from the first to the last one of the whole batch.

    A dataset that is absent on the newest day is expected there too.  The two
    dates are read when the query is built.
    """
    dataset, day = keys
    first, last = counts.agg(F.min(day), F.max(day)).first()
    days = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return counts.select(dataset).distinct().select(dataset, F.explode(days).alias(day))


def per_partition_clock(hours: int, partition_date: str = "partition_date") -> Column:
    """A reproducible clock: ``hours`` after the partition's midnight."""
    return date_at_midnight(F.col(partition_date)) + F.make_dt_interval(hours=F.lit(hours))
