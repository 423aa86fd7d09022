"""From partition directories to a stored run: schema families and failure isolation.

Every dataset directory has its own format and schema.  Directories with the same
format and schema form a family, which is read and profiled in one aggregation; the
long metric rows of all families are then judged and stored together.  A column that
a dataset does not have gives no rows for it.

A directory that can't be read does not stop the others.  Unknown formats are known
from the listing; broken headers show when the executors read them; data that fails
later shows when its family is profiled.  A family that fails is halved until the bad
directories stand alone, which takes some 2 log2(n) jobs for one among n.  Such partitions
get a NOT_RUN run row with the reason.  Failures of the cluster are raised.
"""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline import constants as c
from plumbline.functions.columns import named
from plumbline.operators import profile, schema
from plumbline.plans import daily_run
from plumbline.session import scratch_folder, staged
from plumbline.sources import files, headers, store

UNSUPPORTED_FORMAT, EXECUTION_ERROR = "unsupported_format", "execution_error"
_FAILURES = (PySparkException, Py4JJavaError)
_NOT_RUN = "dataset_name string, partition_date date, reason string"
#: Error conditions that speak of the data of a file, and not of the cluster.
_DATA_CONDITIONS = (
    "FAILED_READ_FILE", "CANNOT_READ_FILE", "PARQUET_", "MALFORMED_", "UNABLE_TO_INFER_SCHEMA", "CANNOT_MERGE_SCHEMAS",
    "CANNOT_LOAD_", "UNSUPPORTED_", "INVALID_PARQUET", "CAST_INVALID_INPUT", "ARITHMETIC_OVERFLOW", "FIELD_NOT_FOUND",
    "DATATYPE_MISMATCH", "COLUMN_ALREADY_EXISTS", "AMBIGUOUS_",
)
#: The same as messages of causes that carry no condition.
_DATA_MESSAGES = ("is not a Parquet file", "Could not read footer", "Not an Avro data file", "ParquetDecodingException")
#: Causes that lie with the cluster, whatever else an error says.
_CLUSTER_MESSAGES = ("ExecutorLostFailure", "No space left on device", "OutOfMemoryError", "FetchFailed", "was cancelled", "SparkContext was shut down")


def is_data_fault(error: Exception) -> bool:
    """Whether an error is about the data that was read; others are not to be hidden."""
    text = str(error)
    if any(x in text for x in _CLUSTER_MESSAGES):
        return False
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    if condition and condition.startswith(_DATA_CONDITIONS):
        return True
    return any(f"[{x}" in text for x in _DATA_CONDITIONS) or any(x in text for x in _DATA_MESSAGES)


def isolate(rows: Sequence, attempt: Callable[[Sequence], object]) -> tuple[list, list]:
    """Results of ``attempt`` over parts of the rows, and the rows that fail alone.

    A part that fails over its data is halved; rows that are fine are tried together.
    """
    results, bad, waiting = [], [], [list(rows)]
    while waiting:
        part = waiting.pop()
        try:
            results.append((attempt(part), part))
        except _FAILURES as error:
            if not is_data_fault(error):
                raise
            if len(part) == 1:
                bad += part
            else:
                middle = len(part) // 2
                waiting += [part[middle:], part[:middle]]
    return results, bad


def _directory(parent: str, row) -> str:
    return f"{parent.rstrip('/')}/partition_date={row['raw_date']}/src_sys_nm={row['directory']}"


def families(spark: SparkSession, parent: str, dates: Sequence[dt.date] | None = None) -> tuple[dict[tuple[str, str], list], list]:
    """Directories by (format, schema fingerprint), and those that can't be read with the reason.

    The driver gets a row per directory, as its listing of files does anyway, and opens none.
    """
    found = headers.fingerprints(headers.directories(files.inventory(spark, parent, dates))).collect()
    groups, bad = defaultdict(list), []
    for row in sorted(found, key=lambda r: (r["dataset_name"], r["raw_date"])):
        key = (row["dataset_name"], row["partition_date"])
        if row["format"] not in files.READERS:
            bad.append((*key, UNSUPPORTED_FORMAT))
        elif row["problem"] == headers.NO_STORE:
            groups[(row["format"], _spark_schema(spark, parent, row).json())].append(row)
        elif row["problem"]:
            bad.append((*key, EXECUTION_ERROR))
        else:
            groups[(row["format"], row["fingerprint"])].append(row)
    return groups, bad


def _spark_schema(spark: SparkSession, parent: str, row) -> T.StructType:
    return spark.read.format(files.READERS[row["format"]]).load(_directory(parent, row)).schema


def read_family(spark: SparkSession, parent: str, own: T.StructType, rows: list) -> DataFrame:
    """The rows of directories of one schema with the keys."""
    text = [T.StructField("partition_date", T.StringType()), T.StructField("src_sys_nm", T.StringType())]
    fields = [f for f in own.fields if f.name not in ("partition_date", "src_sys_nm", "dataset_name")]
    reader = spark.read.format(files.READERS[rows[0]["format"]]).schema(T.StructType([*fields, *text])).option("basePath", parent)
    df = reader.load([_directory(parent, row) for row in rows])
    return df.select(
        F.concat(F.lit("src_sys_nm="), "src_sys_nm").alias("dataset_name"),
        F.to_date("partition_date", "yyyyMMdd").alias("partition_date"), *[named(f.name) for f in fields],
    )


def run(spark: SparkSession, parent: str, folder: str, *, dates: Sequence[dt.date] | None = None,
        freshness_column: str = "source_event_timestamp", as_of: Column | None = None,
        json_columns: Sequence[str] = ("eventAttribute",), enrichment: DataFrame, at: Column, **options) -> None:
    """Check every partition directory below ``parent`` and store the results.

    Text columns named in ``json_columns`` are opened as far as the configuration says.
    """
    work = scratch_folder(spark)
    clock = profile.per_partition_clock(24) if as_of is None else as_of
    seen = store.last_commit(spark, folder)
    groups, bad = families(spark, parent, dates)
    parts, snapshots, columns, timeless = [], [], [], []
    config, tries = options.get("config"), [0]

    def measured(rows: list) -> tuple[DataFrame, T.StructType]:
        tries[0] += 1
        own = _spark_schema(spark, parent, rows[0])
        df = read_family(spark, parent, own, rows)
        measures = profile.default_families(df, freshness_column=freshness_column, as_of=clock)
        plain = staged(profile.metrics(df, [m for m in measures if m.metrics]), f"{work}/family-{tries[0]}")
        leaves = daily_run.leaf_metrics(df, plain, [x for x in json_columns if x in df.columns and isinstance(df.schema[x].dataType, T.StringType)], config)
        return (plain if leaves is None else plain.unionByName(staged(leaves, f"{work}/leaves-{tries[0]}"))), own

    for rows in groups.values():
        results, broken = isolate(rows, measured)
        bad += [(row["dataset_name"], row["partition_date"], EXECUTION_ERROR) for row in broken]
        if not results:
            continue
        parts += [found for (found, _), _ in results]
        good = [row for _, some in results for row in some]
        df = read_family(spark, parent, results[0][0][1], good[:1])
        own = spark.createDataFrame([(r["dataset_name"], r["partition_date"]) for r in good], "dataset_name string, partition_date date")
        snapshots.append(schema.snapshot_of(df, own))
        columns += [f.name for f in profile.value_columns(df, c.KEYS) if f.name not in columns]
        if freshness_column not in df.columns:
            timeless.append(own)
    not_run = spark.createDataFrame(bad, _NOT_RUN)
    if not parts:
        empty = spark.createDataFrame([], "dataset_name string, partition_date date, check_type string, metric_name string, metric_value double")
        parts, snapshots = [empty], [schema.snapshot_of(spark.createDataFrame([], "dataset_name string, partition_date date, x int"), empty.select(*c.KEYS))]
    union = lambda some: some[0] if len(some) == 1 else union(some[:len(some) // 2]).unionByName(union(some[len(some) // 2:]))
    daily_run.judge_and_store(
        spark, union(parts), folder, work, snapshots_of=lambda batch: union(snapshots).join(batch, list(c.KEYS), "left_semi"),
        columns=columns, has_event_time=union(timeless) if timeless else True, enrichment=enrichment, at=at, not_run=not_run, seen=seen, **options,
    )


def run_orchestrated(spark: SparkSession, parents: Sequence[str], folder: str, *, start: Column, end: Column, **options) -> None:
    """Runs of several parent paths with their orchestration runs, from running to final.

    A parent path whose run fails over its data as a whole is finalized with the error; the
    others go on.
    """
    started = staged(store.start_orchestration(spark, parents, start), scratch_folder(spark))
    store.write_running(folder, started)
    errors = []
    for parent in parents:
        number = store.orchestration_id(F.lit(parent), start.cast("timestamp_ntz"))
        try:
            run(spark, parent, folder, orchestration_run_id=number, **options)
        except _FAILURES as error:
            if not is_data_fault(error):
                raise
            errors.append((parent, str(error).splitlines()[0][:500]))
    failed = spark.createDataFrame(errors, "parent_path string, error_summary string").join(started, "parent_path")
    store.finalize(spark, folder, end, failed, started)
