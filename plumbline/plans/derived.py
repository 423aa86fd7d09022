"""Inputs of the catalogue queries, all derived from the given tables.

* monitored rows: ``events``, one dataset per event type, with nulls, blanks,
  misdated values and JSON built in by arithmetic on the row itself;
* run store: every order is a run of its customer's dataset, line items are the
  metric and detail rows of that run and the fields of its schema snapshot.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline import constants as c
from plumbline.operators.baseline import latest_rerun
from plumbline.operators.profile import per_partition_clock
from plumbline.session import spread, tasks_for
from plumbline.sources.store import active, sentinel


_SCHEMAS: dict[str, T.StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its footer is read for the schema only the first time."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _case(column: str, branches: dict, otherwise) -> str:
    """CASE over literal values, each branch an SQL string literal."""
    whens = " ".join(f"WHEN {k!r} THEN '{v}'" for k, v in branches.items())
    return f"CASE {column} {whens} ELSE '{otherwise}' END"


# ---- monitored rows ---------------------------------------------------------

EVENT_DATASETS = {
    "purchase": "lob=retail/src_sys_nm=alpha/dataset=purchase",
    "click": "lob=retail/src_sys_nm=alpha/dataset=click",
    "view": "lob=commercial/src_sys_nm=beta/dataset=view",
    "signup": "lob=commercial/src_sys_nm=gamma/dataset=signup",
}
OTHER_DATASET = "src_sys_nm=omni/dataset=error"


def monitored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        f"{_case('event_type', EVENT_DATASETS, OTHER_DATASET)} AS dataset_name",
        "CAST(ts AS DATE) AS partition_date",
        "event_id",
        "user_id",
        "IF(event_id % 11 = 0 OR (event_type = 'error' AND CAST(ts AS DATE) = DATE'2024-01-20'),"
        " NULL, value) AS value",
        "CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 = 1 THEN '   '"
        " WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS tag",
        "CASE WHEN event_type = 'error' AND event_id % 9 = 0 THEN ts + INTERVAL '40' DAY"
        " WHEN event_type = 'view' AND event_id % 8 = 0 THEN ts - INTERVAL '4000' DAY"
        " ELSE ts END AS event_ts",
        "IF(event_id % 5 = 0, 'junk', date_format(ts, 'yyyy-MM-dd HH:mm:ss')) AS source_event_timestamp",
        # keys differ by dataset, and the price is text in one of them
        """concat('{"', IF(event_type = 'click', 'clicks', 'amount'), '": ', event_id % 100, ', "details": {"price": ',"""
        """ IF(event_type = 'error', '"none"', CAST(event_id % 17 AS STRING)), ', "code": "X"}}') AS event_attribute""",
        "props",
    )


def monitored_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and the two JSON columns only."""
    return monitored(spark, sf_dir).select(*c.KEYS, "event_attribute", "props")


FRESHNESS_CLOCK_HOURS = 30


def partition_clock() -> Column:
    return per_partition_clock(FRESHNESS_CLOCK_HOURS)


# ---- run store --------------------------------------------------------------

LEGACY_SEGMENT, UNSOURCED_SEGMENT = "MACHINERY", "FURNITURE"
FOREVER = f"TIMESTAMP_NTZ'{c.ACTIVE_EXPIRY}'"
ENDED = "TIMESTAMP_NTZ'2002-01-01 00:00:00'"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run rows, active and expired: one per order."""
    who = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")
    ).selectExpr("c_custkey", "c_nationkey", "c_mktsegment", "lower(n_name) AS source")
    return (
        table(spark, sf_dir, "orders")
        .join(who, F.expr("o_custkey = c_custkey"))
        .selectExpr(
            "o_orderkey AS run_id",
            f"concat(IF(c_mktsegment = '{LEGACY_SEGMENT}', '', concat('lob=', lower(c_mktsegment), '/')),"
            f" IF(c_mktsegment = '{UNSOURCED_SEGMENT}', '', concat('src_sys_nm=', source, '/')),"
            " 'dataset=c', c_custkey) AS dataset_name",
            "CAST(o_orderdate AS DATE) AS partition_date",
            f"CASE c_mktsegment WHEN '{LEGACY_SEGMENT}' THEN 'LOB_LEGACY'"
            f" WHEN '{UNSOURCED_SEGMENT}' THEN NULL ELSE concat('LOB_', c_mktsegment) END AS lookup_code",
            "IF(o_orderkey % 29 <> 0,"
            " CAST(CAST(3000 + o_orderkey * 7919 % 7001 AS DECIMAL(10,0)) / 100 AS DECIMAL(5,2)), NULL) AS dqs_score",
            "CAST(o_orderkey % 7 AS INT) AS rerun_number",
            f"IF(c_mktsegment <> '{UNSOURCED_SEGMENT}', CAST(c_nationkey AS BIGINT) * 10000 + year(o_orderdate), NULL)"
            " AS orchestration_run_id",
            "IF(o_orderkey % 50 = 0, 'late delivery', NULL) AS error_message",
            "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP_NTZ)"
            " + make_dt_interval(0, CAST(o_orderkey % 48 AS INT), CAST(o_orderkey % 60 AS INT)) AS create_date",
            f"IF(o_orderkey % 10 = 3, {ENDED}, {FOREVER}) AS expiry_date",
        )
        .selectExpr(
            "*",
            "CASE WHEN dqs_score IS NULL THEN 'UNKNOWN' WHEN dqs_score >= 80 THEN 'PASS'"
            " WHEN dqs_score >= 50 THEN 'WARN' ELSE 'FAIL' END AS check_status",
        )
    )


def active_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return active(runs(spark, sf_dir))


def orchestrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One orchestration run per source and year that has runs."""
    r = runs(spark, sf_dir).filter(F.col("orchestration_run_id").isNotNull())
    return r.select("orchestration_run_id").distinct().select(
        "orchestration_run_id",
        F.concat(
            F.lit("/prod/nation_"),
            F.floor(F.col("orchestration_run_id") / 10000).cast("string"),
        ).alias("parent_path"),
    )


# line number -> metric and detail vocabulary of that row
METRICS = {
    1: (c.FRESHNESS, "hours_since_update"),
    2: (c.VOLUME, "row_count"),
    3: (c.SCHEMA, "added_fields_count"),
    4: (c.OPS, "null_rate_pct::value"),
    5: (c.DISTRIBUTION, "order.value.mean"),
    6: (c.TIMESTAMP_SANITY, "future_pct.event_ts"),
}
LAST_METRIC = (c.DQS_SCORE, "composite_score")
DETAILS = {
    1: (c.FRESHNESS, "freshness_status"),
    2: (c.VOLUME, "volume_status"),
    3: (c.SCHEMA, "schema_status"),
    4: (c.OPS, "ops_status"),
    5: (c.SCHEMA, "eventAttribute_format"),
    6: (c.DQS_SCORE, "dqs_score_breakdown"),
}
LAST_DETAIL = (c.BREAKING_CHANGE, "breaking_change_status")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (order, line number).

    Dealt by order, so what follows per order or run needs no further shuffle.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag", "l_linestatus")
    lines = spread(lines, tasks_for(spark, [f"{sf_dir}/lineitem.parquet"]), "l_orderkey")
    return lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_quantity").alias("qty"),
        F.max("l_tax").alias("tax"),
        F.max("l_returnflag").alias("flag"),
        F.max("l_linestatus").alias("line_status"),
    )


_LINE_EXPIRY = f"IF(tax > 0.07D, {ENDED}, {FOREVER}) AS expiry_date"


def numerics(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = {k: v[0] for k, v in METRICS.items()}
    name = {k: v[1] for k, v in METRICS.items()}
    return _lines(spark, sf_dir).selectExpr(
        "l_orderkey * 10 + l_linenumber AS metric_id",
        "l_orderkey AS run_id",
        f"{_case('l_linenumber', check, LAST_METRIC[0])} AS check_type",
        f"{_case('l_linenumber', name, LAST_METRIC[1])} AS metric_name",
        "IF(l_linenumber = 2, qty * 1000, qty) AS metric_value",
        _LINE_EXPIRY,
    )


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = {k: v[0] for k, v in DETAILS.items()}
    kind = {k: v[1] for k, v in DETAILS.items()}
    lines = _lines(spark, sf_dir).withColumn("code", F.expr("CAST(qty AS INT) % 8"))
    status = "CASE WHEN code <= 3 THEN 'PASS' WHEN code <= 5 THEN 'WARN' WHEN code = 6 THEN 'FAIL' ELSE 'NOT_RUN' END"
    return lines.selectExpr(
        "l_orderkey * 10 + l_linenumber AS detail_id",
        "l_orderkey AS run_id",
        f"{_case('l_linenumber', check, LAST_DETAIL[0])} AS check_type",
        f"{_case('l_linenumber', kind, LAST_DETAIL[1])} AS detail_type",
        """CASE WHEN l_linenumber = 5 THEN CASE WHEN code <= 4 THEN '"parquet"' WHEN code <= 6 THEN '"AVRO"' ELSE 'orc' END"""
        f""" WHEN code = 5 THEN 'not json' ELSE concat('{{"status": "', {status}, '", "reason": "r', code, '"}}') END"""
        " AS detail_value",
        _LINE_EXPIRY,
    )


def metric_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active metrics joined to active runs: the newest run per dataset, day and metric."""
    r = active_runs(spark, sf_dir).select("run_id", "dataset_name", "partition_date", "rerun_number")
    joined = active(numerics(spark, sf_dir)).drop("expiry_date", "metric_id").join(r, "run_id")
    return latest_rerun(
        joined, ["dataset_name", "partition_date", "check_type", "metric_name"],
        [F.desc("rerun_number"), F.desc("run_id")],
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema snapshots: the order's lines are the fields of the run's schema.

    Per dataset and day the newest run counts.  Every ninth snapshot stores no
    schema JSON and every thirteenth no usable one.
    """
    r = latest_rerun(
        active_runs(spark, sf_dir).select("run_id", *c.KEYS, "rerun_number"),
        list(c.KEYS), [F.desc("rerun_number"), F.desc("run_id")],
    ).select("run_id", *c.KEYS)
    kind = F.when(F.col("flag") == "A", "bigint").when(F.col("flag") == "N", "double").otherwise("string")
    nullable = F.when(F.col("line_status") == "O", "true").otherwise("false")
    per_run = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").alias("run_id")).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("path"),
                    F.concat(F.lit("type="), kind, F.lit(",nullable="), nullable).alias("descriptor"),
                )
            )
        ).alias("f")
    )
    listed = F.array_join(
        F.transform("f", lambda x: F.concat(x["path"], F.lit(":"), x["descriptor"])), ";"
    )
    stored = F.concat(F.lit('{"type": "struct", "fields": "'), listed, F.lit('"}'))
    return per_run.join(r, "run_id").select(
        *c.KEYS,
        F.concat(F.lit("sha256:"), F.sha2(stored, 256)).alias("schema_hash"),
        F.when(F.col("run_id") % 9 == 0, None)
        .when(F.col("run_id") % 13 == 0, F.lit('"text"')).otherwise(stored).alias("schema_json"),
        F.map_from_entries("f").alias("fields"),
    )


def delivery_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours since update per supplier dataset and shipping day."""
    return table(spark, sf_dir, "lineitem").groupBy(
        F.concat(
            F.lit("lob=supply/src_sys_nm=s"), F.col("l_suppkey").cast("string"), F.lit("/dataset=delivery")
        ).alias("dataset_name"),
        F.col("l_shipdate").cast("date").alias("partition_date"),
    ).agg(F.max("l_quantity").alias("hours_since_update"))


def order_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per source nation and day; days without orders are absent."""
    who = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
        .join(who, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(
            F.concat(F.lit("src_sys_nm=n"), F.col("c_nationkey").cast("string")).alias("dataset_name"),
            F.col("o_orderdate").cast("date").alias("partition_date"),
        )
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def dataset_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dataset name of the monitored rows and of the run store."""
    return (
        monitored(spark, sf_dir).select("dataset_name")
        .unionByName(runs(spark, sf_dir).select("dataset_name"))
        .distinct()
    )


# ---- configuration dimensions ----------------------------------------------

_ENDED = "2000-01-01 00:00:00"

CHECK_CONFIG = [
    # id, dataset_pattern, check_type, enabled, explosion_level, expiry_date
    (1, "%/dataset=signup", c.OPS, False, 0, None),
    (2, "lob=commercial/src_sys_nm=gamma/%", c.FRESHNESS, True, 2, None),
    (3, "lob=r%/dataset=click", c.SCHEMA, True, 1, None),
    (4, "%src_sys_nm=alpha/dataset=_urchase", c.VOLUME, True, 0, None),
    (5, "lob=automobile/%", c.VOLUME, True, 0, None),
    (6, "lob=building/src_sys_nm=nation_1%", c.DISTRIBUTION, True, 1, None),
    (7, "lob=building/%", c.DISTRIBUTION, True, 2, None),
    (8, "lob=household/src_sys_nm=nation__/%", c.FRESHNESS, True, 0, None),
    (9, "%/src_sys_nm=nation_2/dataset=c1%", c.OPS, True, 0, None),
    (10, "%/dataset=c9_", c.ZERO_ROW, True, 0, None),
    (11, "src_sys_nm=nation_3/%", c.DISTRIBUTION, True, 7, None),
    (12, "src-sys-nm=nation-3/%", c.SCHEMA, True, 0, None),
    (13, "lob=automobile/%", "NOT_DEPLOYED", True, 0, None),
    (14, "lob=furniture/%", c.FRESHNESS, True, 0, _ENDED),
    (15, "lob=furniture/%", c.VOLUME, False, 0, None),
    (16, "%", c.LINEAGE, False, 0, None),
    (17, "lob=retail/%", c.DISTRIBUTION, True, 1, None),
    (18, "lob=commercial/%", c.DISTRIBUTION, True, 2, None),
]

ENRICHMENT = [
    # id, dataset_pattern, lookup_code, custom_weights, sla_hours, explosion_level, expiry_date
    (1, "lob=retail/%/dataset=click", "LOB_CLICKS",
     '{"OPS":0.7,"VOLUME":0.2,"FRESHNESS":0.1}', 5.0, 1, None),
    (2, "%/src_sys_nm=gamma/%", "LOB_SIGNUPS", None, 30.0, 2, None),
    (3, "lob=commercial/%", "LOB_TRADE",
     '{"SCHEMA":0.35,"FRESHNESS":0.35,"OPS":0.3}', 13.0, 0, None),
    (4, "src_sys_nm=nation_1_", "LOB_TEENS", None, None, 0, None),
    (5, "src_sys_nm=nation_1%", "LOB_ONES", None, 36.0, 0, None),
    (6, "lob=building/%", None, '{"FRESHNESS":0.5,"VOLUME":0.5}', 24.0, 0, None),
    (7, "lob=building/src_sys_nm=nation_1/%", "LOB_LATE",
     '{"FRESHNESS":1.0}', 2.0, 0, None),
    (8, "lob=automobile/src_sys_nm=nation_%/%", "LOB_AUTO", '{"SCHEMA":0.0,"OPS":0.0}', 12.0, 0, None),
    (9, "lob=household/%", "LOB_OLD", None, 48.0, 0, _ENDED),
    (10, "%_nm=nation_7/%", "LOB_SEVEN", None, 8.0, 0, None),
    (11, "lob=supply/src_sys_nm=s2_/%", None, None, 24.0, 0, None),
]

LOB_LOOKUP = [
    # id, lookup_code, lob_name, owner, classification, expiry_date
    (1, "LOB_BUILDING", "House building", "team north", "Tier 1 Critical", None),
    (2, "LOB_AUTOMOBILE", "Cars", "team south", "Tier 2 Standard", None),
    (3, "LOB_HOUSEHOLD", "Home goods", "team west", "Tier 3 Low", None),
    (4, "LOB_LEGACY", "Old machines", "team east", "Tier 1 Critical", _ENDED),
    (5, "LOB_CLICKS", "Web clicks", "team web", "Tier 1 Critical", None),
    (6, "LOB_TRADE", "Trade", "team trade", "Tier 3 Low", None),
]

# every check for every dataset, but for time stamps of one source, and JSON levels by business
FULL_CONFIG = [
    *((k, "%", check, True, 0, None) for k, check in enumerate(c.CHECK_TYPES) if check not in (c.TIMESTAMP_SANITY, c.DISTRIBUTION)),
    (101, "lob=%", c.TIMESTAMP_SANITY, True, 0, None),
    (102, "lob=retail/%", c.DISTRIBUTION, True, 1, None),
    (103, "lob=commercial/%", c.DISTRIBUTION, True, 2, None),
    (104, "src_sys_nm=%", c.DISTRIBUTION, True, 0, None),
]


def _dimension(spark: SparkSession, rows, names: str, types) -> DataFrame:
    columns = names.split()
    schema = pa.schema([*zip(columns, types), ("ended", pa.string())])
    # an Arrow table becomes a local relation, so its size is known to the planner
    data = pa.Table.from_pylist([dict(zip(schema.names, row)) for row in rows], schema)
    return spark.createDataFrame(data).withColumn(
        "expiry_date", F.coalesce(F.col("ended").cast("timestamp_ntz"), sentinel())
    ).drop("ended")


def check_config(spark: SparkSession, rows=None) -> DataFrame:
    return _dimension(
        spark, CHECK_CONFIG if rows is None else rows, "id dataset_pattern check_type enabled explosion_level",
        [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32()],
    )


def enrichment(spark: SparkSession) -> DataFrame:
    return _dimension(
        spark, ENRICHMENT,
        "id dataset_pattern lookup_code custom_weights sla_hours explosion_level",
        [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32()],
    )


def lob_lookup(spark: SparkSession) -> DataFrame:
    return _dimension(
        spark, LOB_LOOKUP, "id lookup_code lob_name owner classification",
        [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()],
    )
