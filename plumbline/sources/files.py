"""Dataset discovery and reads over ``partition_date=yyyyMMdd/src_sys_nm=x`` trees."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline import constants as c
from plumbline.operators import patterns

AVRO, PARQUET, UNSUPPORTED = "AVRO", "PARQUET", "UNKNOWN"
READERS = {AVRO: "avro", PARQUET: "parquet"}

_NO_FILES = (
    "path string, file_name string, length bigint, modified timestamp, "
    "raw_date string, src_sys_nm string"
)


def _day(date: dt.date) -> str:
    return date.strftime("%Y%m%d")


def inventory(spark: SparkSession, parent: str, dates: Sequence[dt.date] | None = None) -> DataFrame:
    """Visible files of every dataset directory of the dates (all dates without).

    The binaryFile source lists in parallel and, with ``content`` pruned, opens
    no file.  It skips names starting with ``.`` or ``_``, as wanted; directories
    without files, other directory names and absent dates give no rows.
    """
    found = _list(spark, f"{_partition_glob(parent, dates)}/src_sys_nm=*/*")
    return spark.createDataFrame([], _NO_FILES) if found is None else found


def _partition_glob(parent: str, dates: Sequence[dt.date] | None) -> str:
    """Only the wanted date directories are listed; absent ones are passed over."""
    days = "*" if dates is None else "{" + ",".join(_day(d) for d in dates) + "}"
    return f"{parent.rstrip('/')}/partition_date={days}"


def _list(spark: SparkSession, glob: str) -> DataFrame | None:
    try:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    path = F.col("path")
    files = raw.select(
        "path",
        F.regexp_extract(path, r"([^/]+)$", 1).alias("file_name"),
        F.col("length"),
        F.col("modificationTime").alias("modified"),
        F.regexp_extract(path, r"/partition_date=([^/]+)/src_sys_nm=[^/]+/[^/]+$", 1).alias("raw_date"),
        F.url_decode(
            F.regexp_extract(path, r"/partition_date=[^/]+/src_sys_nm=([^/]+)/[^/]+$", 1)
        ).alias("src_sys_nm"),
    )
    # a file deeper down belongs to a sub-directory, not to the dataset directory
    return files.filter(F.col("src_sys_nm") != "")


def datasets(files: DataFrame, enrichment: DataFrame | None = None) -> DataFrame:
    """One row per dataset and date with its name, lookup code, size and format.

    The format is that of the first file by path with a known extension; only
    unknown extensions give UNKNOWN and the dataset is marked as not runnable.
    """
    kind = F.when(F.col("file_name").endswith(".avro"), AVRO).when(
        F.col("file_name").endswith(".parquet"), PARQUET
    )
    grouped = files.groupBy("raw_date", "src_sys_nm").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("length").alias("total_bytes"),
        F.coalesce(
            F.min_by(kind, F.when(kind.isNotNull(), F.col("path"))), F.lit(UNSUPPORTED)
        ).alias("format"),
    )
    named = grouped.select(
        F.concat(F.lit("src_sys_nm="), "src_sys_nm").alias("dataset_name"),
        F.to_date("raw_date", "yyyyMMdd").alias("partition_date"),
        F.col("src_sys_nm").alias("raw_code"),
        "file_count", "total_bytes", "format",
        F.when(F.col("format") == UNSUPPORTED, c.NOT_RUN).alias("status"),
        F.when(F.col("format") == UNSUPPORTED, "unsupported_format").alias("reason"),
    )
    if enrichment is None:
        return named.withColumn("lookup_code", F.col("raw_code"))
    return named.join(patterns.lookup_codes(named, enrichment), "raw_code", "left")


def read_partitions(spark: SparkSession, parent: str, dates: Sequence[dt.date] | None = None,
                    file_format: str = PARQUET, sources: Sequence[str] | None = None) -> DataFrame:
    """Rows of the partitions with ``dataset_name`` and ``partition_date`` keys.

    Only the directories of the dates are listed; sources filter the partition
    column, so only their files are read.  Directory names stay text, so codes
    keep their leading zeros.
    """
    reader = spark.read.format(READERS[file_format]).option("basePath", parent)
    path = _partition_glob(parent, dates)
    found = reader.load(path).schema
    text = {"partition_date", "src_sys_nm"}
    as_text = T.StructType(
        [T.StructField(f.name, T.StringType()) if f.name in text else f for f in found.fields]
    )
    df = reader.schema(as_text).load(path)
    if sources is not None:
        df = df.filter(F.col("src_sys_nm").isin(*sources))
    return df.withColumns(
        {
            "dataset_name": F.concat(F.lit("src_sys_nm="), "src_sys_nm"),
            "partition_date": F.to_date("partition_date", "yyyyMMdd"),
        }
    ).drop("src_sys_nm")


def write_partitions(df: DataFrame, parent: str, source: str = "src_sys_nm") -> None:
    """Write rows as ``partition_date=yyyyMMdd/src_sys_nm=x`` Parquet directories.

    Rebalancing by the partition columns keeps files per directory few, and lets
    adaptive execution split a directory that holds most of the rows.
    """
    out = df.withColumn("partition_date", F.date_format("partition_date", "yyyyMMdd"))
    (
        out.hint("rebalance", "partition_date", source)
        .write.mode("errorifexists").partitionBy("partition_date", source).parquet(parent)
    )
