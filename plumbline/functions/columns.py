"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def named(name: str) -> Column:
    """Reference a column whose name may hold dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def ntz(column: Column) -> Column:
    return column.cast(T.TimestampNTZType())


def date_at_midnight(column: Column) -> Column:
    return ntz(column.cast("date"))


def day_number(column: Column) -> Column:
    """Days since 1970-01-01, so calendar windows can use RANGE frames."""
    return F.datediff(column, F.lit("1970-01-01").cast("date"))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``, both without time zone."""
    return (ntz(end) - ntz(start)).cast("interval second").cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole in [0, 100]; 0 when there is nothing to divide by."""
    pct = F.lit(100.0) * part / F.nullif(whole, F.lit(0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), pct)), F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(part.cast("double") / F.nullif(whole, F.lit(0)), F.lit(0.0))


def round_score(column: Column, digits: int = 2) -> Column:
    """Half-up rounding of an averaged DECIMAL score, returned as DOUBLE."""
    return F.round(column.cast("decimal(18,8)"), digits).cast("double")


def mean_of(total: Column, count: Column) -> Column:
    """Average of DECIMAL scores from a (sum, count) pair, NULL without scores."""
    return total.cast("decimal(28,8)") / F.nullif(count, F.lit(0)).cast("decimal(18,0)")


def count_where(condition: Column) -> Column:
    return F.count_if(condition)
