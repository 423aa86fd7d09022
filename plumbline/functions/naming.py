"""Dataset names, paths and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline.constants import PATH_PREFIX, TIME_RANGES

_SEGMENT = "src_sys_nm="


def source_system(name: Column) -> Column:
    """Text after ``src_sys_nm=`` up to the next ``/``; NULL when absent or blank."""
    found = F.regexp_extract(name, _SEGMENT + "([^/]*)", 1)
    return F.when(F.length(F.trim(found)) > 0, found)


def source_system_group(name: Column) -> Column:
    """The source whose datasets this name belongs to.

    Membership asks for ``src_sys_nm=<source>/``: a name that ends with the
    segment knows its source but is not a member of the group.
    """
    found = F.regexp_extract(name, _SEGMENT + "([^/]+)/", 1)
    return F.when(F.length(F.trim(found)) > 0, found)


def source_system_label(name: Column) -> Column:
    """The first path segment starting with ``src_sys_nm=``, else ``unknown``."""
    segments = F.filter(F.split(name, "/"), lambda s: s.startswith(_SEGMENT))
    segment = F.get(segments, F.lit(0))
    return F.coalesce(F.substr(segment, F.lit(len(_SEGMENT) + 1)), F.lit("unknown"))


def source_system_sql(name: Column) -> Column:
    """Split-based variant used by the accountability report; '' when absent."""
    tail = F.split_part(name, F.lit(_SEGMENT), F.lit(2))
    return F.split_part(tail, F.lit("/"), F.lit(1))


def partition_path(name: Column, partition_date: Column) -> Column:
    return F.concat(
        F.lit(PATH_PREFIX), name, F.lit("/partition_date="),
        F.date_format(partition_date, "yyyyMMdd"),
    )


def json_label(value: Column) -> Column:
    """Display label of a JSON string: first letter upper case, rest lower.

    Text that is not JSON is labelled as it stands; NULL becomes ``Unknown``.
    """
    variant = F.try_parse_json(value)
    text = F.coalesce(F.try_variant_get(variant, "$", "string"), value)
    label = F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))
    return F.coalesce(label, F.lit("Unknown"))


def time_range_days(time_range: str) -> int:
    return TIME_RANGES.get(time_range, 7)
