"""Check outputs as stored rows.

Every check gives rows ``(dataset_name, partition_date, check_type, name,
metric_value, detail_value, status)``: a numeric metric has a value, a detail has
a JSON payload and its status.  Both kinds come from one pass over the check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plumbline import constants as c
from plumbline.operators import checks, cross, patterns, schema

COLUMNS = (*c.KEYS, "check_type", "name", "metric_value", "detail_value", "status")


def emit(judged: DataFrame, check: str, numerics: dict[str, str] | None = None, details=()) -> DataFrame:
    """Rows of one check; names, values and conditions are SQL over ``judged``.

    ``numerics``: metric name -> value.  ``details``: (name expression, payload) or
    (name expression, payload, condition), a payload mapping field names to values.
    """
    text = "CAST(NULL AS STRING)"
    structs = [
        f"named_struct('name', '{n}', 'metric_value', CAST({v} AS DOUBLE), 'detail_value', {text}, 'status', {text})"
        for n, v in (numerics or {}).items()
    ]
    for name, payload, *when in details:
        value = "to_json(named_struct(" + ", ".join(f"'{k}', {v}" for k, v in payload.items()) + "))"
        value = f"IF({when[0]}, {value}, NULL)" if when else value
        structs.append(
            f"named_struct('name', {name}, 'metric_value', CAST(NULL AS DOUBLE), 'detail_value', {value}, 'status', status)"
        )
    return judged.selectExpr(
        *c.KEYS, f"'{check}' AS check_type", f"inline(array({', '.join(structs)}))"
    ).filter("metric_value IS NOT NULL OR detail_value IS NOT NULL")


def _same(*names: str) -> dict[str, str]:
    return {x: x for x in names}


def _payload(*same: str, **fields: str) -> dict[str, str]:
    return {"status": "status", "reason": "reason", **_same(*same), **fields}


def union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ---- partition checks over metric history -----------------------------------


def _values(history: DataFrame, check: str, metric: str, name: str) -> DataFrame:
    hit = (F.col("check_type") == check) & (F.col("metric_name") == metric)
    return history.filter(hit).select(*c.KEYS, F.col("metric_value").alias(name))


def volume(history: DataFrame) -> DataFrame:
    judged = checks.volume_status(_values(history, c.VOLUME, "row_count", "row_count"))
    # row_count itself is stored with the profile
    return emit(
        judged, c.VOLUME, _same("pct_change", "row_count_stddev"),
        [("'volume_status'", _payload(
            "row_count", "pct_change", baseline_mean_row_count="coalesce(baseline_mean, 0D)",
            baseline_stddev_row_count="row_count_stddev", baseline_count="baseline_count"))],
    )


def zero_row(history: DataFrame) -> DataFrame:
    counts = _values(history, c.VOLUME, "row_count", "row_count")
    judged = checks.zero_row_status(counts.select(*c.KEYS), counts)
    return emit(judged, c.ZERO_ROW, _same("row_count"), [("'zero_row_status'", _payload("row_count"))])


def freshness(history: DataFrame) -> DataFrame:
    hours = _values(history, c.FRESHNESS, "hours_since_update", "hours_since_update")
    known = f"baseline_count >= {c.BASELINE_MIN_SAMPLES}"
    return emit(
        checks.freshness_status(hours), c.FRESHNESS,
        details=[("'freshness_status'", _payload(
            staleness_hours="coalesce(hours_since_update, 0D)",
            baseline_mean_hours=f"IF({known}, baseline_mean, 0D)",
            baseline_stddev_hours=f"IF({known}, baseline_stddev, 0D)",
            baseline_count=f"IF({known}, baseline_count, 0)"))],
    )


def freshness_missing(partitions: DataFrame) -> DataFrame:
    return emit(
        checks.missing_freshness_column(partitions), c.FRESHNESS,
        details=[("'freshness_status'", _payload(staleness_hours="0D", baseline_count="0"))],
    )


def ops(history: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``columns`` in schema order decide which anomaly is named first."""
    order = F.array_position(F.lit(list(columns)), F.col("column_name"))
    rates = history.filter(
        (F.col("check_type") == c.OPS) & F.col("metric_name").startswith("null_rate_pct::")
    ).select(
        *c.KEYS, F.regexp_extract("metric_name", "^null_rate_pct::(.*)$", 1).alias("column_name"),
        F.col("metric_value").alias("null_rate_pct"),
    ).withColumn("column_ordinal", order)
    # one entry per flagged column of a partition
    listed = checks.ops_anomalies(rates).groupBy(*c.KEYS).agg(
        F.expr(
            "transform(array_sort(collect_list(struct(column_ordinal, named_struct("
            "'column', column_name, 'null_rate_pct', null_rate_pct, "
            "'baseline_mean', coalesce(baseline_mean, 0D), 'baseline_stddev', coalesce(baseline_stddev, 0D), "
            "'baseline_count', baseline_count, 'severity', severity, 'reason', reason) AS entry))), x -> x.entry)"
        ).alias("anomalies")
    )
    judged = checks.ops_status(rates).join(listed, list(c.KEYS), "left")
    return emit(
        judged, c.OPS,
        details=[
            ("'ops_status'", _payload("total_columns", "flagged_columns", "baseline_sample_count")),
            ("'ops_anomalies'", {"anomalies": "coalesce(anomalies, array())"}),
        ],
    )


_PATH = r"'^(.*)[.]([^.]+)$'"


def distribution(history: DataFrame, partitions: DataFrame) -> DataFrame:
    stats = history.filter(F.col("check_type") == c.DISTRIBUTION).selectExpr(
        *c.KEYS, f"regexp_extract(metric_name, {_PATH}, 1) AS column_path",
        f"regexp_extract(metric_name, {_PATH}, 2) AS stat", "metric_value",
    ).groupBy(*c.KEYS, "column_path").agg(
        F.expr("max(metric_value) FILTER (WHERE stat = 'mean')").alias("mean"),
        F.expr("max(metric_value) FILTER (WHERE stat = 'stddev')").alias("stddev"),
    )
    shifts = checks.distribution_shift(stats)
    only = lambda x: f"IF(status <> '{c.PASS}', {x}, NULL)"
    per_column = emit(
        shifts, c.DISTRIBUTION,
        details=[("concat(column_path, '.status')", _payload(
            "z_score", column="column_path", current_mean=only("mean"),
            baseline_mean=only("baseline_mean"), baseline_stddev=only("baseline_stddev")))],
    )
    summary = emit(
        checks.distribution_summary(shifts, partitions), c.DISTRIBUTION,
        details=[("'distribution_summary'", _payload("total_columns_analyzed", "shifted_columns"))],
    )
    return per_column.unionByName(summary)


def timestamp_sanity(history: DataFrame, partitions: DataFrame) -> DataFrame:
    shares = history.filter(F.col("check_type") == c.TIMESTAMP_SANITY).selectExpr(
        *c.KEYS, "regexp_extract(metric_name, '^([^.]+)[.](.*)$', 1) AS measure",
        "regexp_extract(metric_name, '^([^.]+)[.](.*)$', 2) AS column_name", "metric_value",
    ).groupBy(*c.KEYS, "column_name").agg(
        F.expr("max(metric_value) FILTER (WHERE measure = 'future_pct')").alias("future_pct"),
        F.expr("max(metric_value) FILTER (WHERE measure = 'stale_pct')").alias("stale_pct"),
    )
    judged = checks.timestamp_sanity_status(shares)
    per_column = emit(
        judged, c.TIMESTAMP_SANITY,
        details=[("concat('timestamp_sanity.', column_name)",
                  _payload("future_pct", "stale_pct", column="column_name"))],
    )
    summary = emit(
        checks.timestamp_sanity_summary(judged, partitions), c.TIMESTAMP_SANITY,
        details=[("'timestamp_sanity_summary'", _payload("total_columns_analyzed", "failed_columns"))],
    )
    return per_column.unionByName(summary)


_CHANGES = ("added", "removed", "changed")


def schema_drift(snapshots: DataFrame) -> DataFrame:
    judged = schema.schema_status(snapshots).join(
        snapshots.select(*c.KEYS, "schema_json"), list(c.KEYS)
    )
    return emit(
        judged, c.SCHEMA, {f"{k}_fields_count": f"{k}_count" for k in _CHANGES},
        [
            ("'schema_status'", _payload("schema_hash", "baseline_hash", *(f"{k}_count" for k in _CHANGES))),
            ("'schema_hash'", {"algorithm": "'SHA-256'", "hash": "schema_hash", "schema_json": "schema_json"}),
            ("'schema_diff'", _same(*(f"{k}_fields" for k in _CHANGES)),
             "added_count + removed_count + changed_count > 0"),
        ],
    )


def breaking_change(snapshots: DataFrame) -> DataFrame:
    return emit(
        schema.breaking_change(snapshots), c.BREAKING_CHANGE,
        details=[
            ("'breaking_change_status'", _payload("removed_count")),
            ("'breaking_change_fields'", _same("removed_fields"), "removed_count > 0"),
        ],
    )


# ---- checks over run history and configuration ------------------------------


def source_health(runs: DataFrame) -> DataFrame:
    return emit(
        cross.source_health(runs), c.SOURCE_SYSTEM_HEALTH, _same("aggregate_score", "dataset_count"),
        [("'source_system_health_status'", _payload(
            "src_sys_nm", "aggregate_score", "dataset_count", history_days=f"{c.SOURCE_HEALTH_DAYS}",
            threshold_fail=f"{c.SOURCE_HEALTH_FAIL_BELOW}D", threshold_warn=f"{c.SOURCE_HEALTH_WARN_BELOW}D"))],
    )


def correlation(runs: DataFrame) -> DataFrame:
    return emit(
        cross.correlation(runs), c.CORRELATION, _same("correlated_dataset_count", "correlation_ratio"),
        [("'correlation_status'", _payload(
            "src_sys_nm", "correlated_dataset_count", "total_dataset_count", "correlation_ratio",
            threshold_fail=f"{c.CORRELATION_FAIL_AT}D", threshold_warn=f"{c.CORRELATION_WARN_AT}D"))],
    )


def lineage(runs: DataFrame) -> DataFrame:
    counts = ("upstream_dataset_count", "upstream_failed_count")
    return emit(
        cross.lineage(runs), c.LINEAGE, _same(*counts),
        [("'lineage_status'", _payload(
            "src_sys_nm", *counts, upstream_fail_threshold=f"{c.UPSTREAM_FAIL_BELOW}D"))],
    )


def cross_destination(runs: DataFrame) -> DataFrame:
    counts = ("destination_count", "inconsistent_destination_count")
    return emit(
        cross.cross_destination(runs), c.CROSS_DESTINATION, _same(*counts),
        [("'cross_destination_status'", _payload(
            *counts, "mean_score", "max_deviation", threshold=f"{c.DESTINATION_MAX_DEVIATION}D"))],
    )


def sla_countdown(partitions: DataFrame, enrichment: DataFrame, as_of) -> DataFrame:
    return emit(
        cross.sla_countdown(partitions, enrichment, as_of), c.SLA_COUNTDOWN, _same("hours_remaining"),
        [("'sla_countdown_status'", _payload("hours_remaining", "sla_hours", "warn_threshold"))],
    )


def inferred_sla(history: DataFrame, enrichment: DataFrame) -> DataFrame:
    hours = _values(history, c.FRESHNESS, "hours_since_update", "hours_since_update")
    found = ("inferred_sla_hours", "deviation_from_inferred")
    return emit(
        cross.inferred_sla(hours, enrichment), c.INFERRED_SLA, _same(*found),
        [("'inferred_sla_status'", _payload(
            *found, "mean_hours", "stddev_hours", "data_points",
            current_hours="IF(inferred_sla_hours IS NOT NULL, hours_since_update, NULL)"))],
    )


def orphan_detection(partitions: DataFrame, config: DataFrame) -> DataFrame:
    judged = partitions.join(patterns.orphan_detection(partitions, config), "dataset_name")
    return emit(judged, c.ORPHAN_DETECTION, details=[("'orphan_detection_status'", _payload())])


def classification(runs: DataFrame, lob_lookup: DataFrame) -> DataFrame:
    judged = patterns.classification_weighted(runs.select(*c.KEYS, "lookup_code"), lob_lookup)
    return emit(
        judged, c.CLASSIFICATION_WEIGHTED, {"classification_weighted_score": "multiplier"},
        [("'classification_weighted_status'", _payload("classification", "multiplier"))],
    )
