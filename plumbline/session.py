"""Session and shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # call sites of DataFrame methods are for notebooks; recording them slows plan building
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", memory: str = "8g", **settings: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plumbline")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/plumbline-{uuid.uuid4().hex}"


#: Bytes of Parquet files that one task takes after a shuffle; rows in memory are several times as large.
TASK_BYTES = 8 << 20


def tasks_for(spark: SparkSession, paths: Iterable[str]) -> int:
    """How many tasks a shuffle of these files needs so that none grows with the input."""
    total = 0
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return total // TASK_BYTES + 1


def spread(df: DataFrame, tasks: int, *columns: str) -> DataFrame:
    """Rows dealt by the columns to ``tasks`` tasks; few are left to Spark."""
    return df.repartition(tasks, *columns) if tasks > 1 else df


def staged(df: DataFrame, folder: str, *partition_by: str) -> DataFrame:
    """Write once, read back: several readers share one computation and its lineage ends."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
