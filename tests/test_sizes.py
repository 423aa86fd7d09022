"""Shuffles that take more tasks where there are more files, so that no task grows with the input."""

import datetime as dt
import re

from pyspark.sql import functions as F

from plumbline import session
from plumbline.operators import baseline
from plumbline.plans import derived as d
from plumbline.sources import store

SF_DIR = "/root/testdata/sf0.001"


def dealt(df) -> set[int]:
    """Task numbers of the shuffles in the plan."""
    return {int(x) for x in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().executedPlan().toString())}


def test_line_shuffle_follows_the_files(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_BYTES", 20_000)
    tasks = session.tasks_for(spark, [f"{SF_DIR}/lineitem.parquet"])
    assert tasks > 2 and dealt(d.numerics(spark, SF_DIR)) == {tasks}


def test_expiry_shuffle_follows_the_store(spark, monkeypatch, tmp_path):
    folder, day = str(tmp_path / "store"), F.lit(dt.date(2026, 3, 30)).alias("partition_date")
    runs = spark.range(50).select(
        F.col("id").alias("run_id"), F.concat(F.lit("d"), "id").alias("dataset_name"), day, F.lit(0).alias("rerun_number"),
        store.sentinel().alias("expiry_date"))
    metrics = runs.drop("rerun_number")
    store.write_metrics(folder, runs, metrics, metrics)
    store.apply_expiry(spark, folder, runs.filter("run_id < 20"), "2026-04-01 00:00:00")
    monkeypatch.setattr(session, "TASK_BYTES", 200)
    rows = store.read_table(spark, folder, store.NUMERICS)
    assert max(dealt(rows)) > 2
    assert store.active(rows).count() == 30 and rows.count() == 50


def test_kept_rows_take_one_shuffle_a_batch(spark):
    """Batch after batch gives the baselines of the whole history, and a day sent again is replaced."""
    day = F.date_add(F.lit(dt.date(2026, 1, 1)), F.col("id").cast("int")).alias("partition_date")
    name = F.concat(F.lit("d"), F.col("k")).alias("dataset_name")
    history = spark.range(60).crossJoin(spark.range(3).withColumnRenamed("id", "k")).filter("id % (k + 1) = 0").select(
        name, F.lit("VOLUME").alias("check_type"), F.lit("row_count").alias("metric_name"), day,
        F.when(F.col("id") % 7 != 0, F.col("id") * (F.col("k") + 1)).alias("metric_value"))
    early = F.col("partition_date") < dt.date(2026, 2, 20)
    first = baseline.rolled(None, history.filter(early))
    wrong = history.filter(early & (F.col("partition_date") > dt.date(2026, 2, 15))).withColumn("metric_value", F.lit(-1.0))
    spoilt = baseline.rolled(first.filter("is_kept"), wrong)
    again = baseline.rolled(spoilt.filter("is_kept"), history.filter(F.col("partition_date") > dt.date(2026, 2, 15)))
    assert again.groupBy("dataset_name").agg(F.count_if("is_kept").alias("n")).agg(F.max("n")).first()[0] == 40

    columns = ["dataset_name", "partition_date", "metric_value", "baseline_mean", "baseline_stddev", "baseline_count"]
    want = baseline.rolling_baseline(history).filter(F.col("partition_date") > dt.date(2026, 2, 15))
    found = again.filter("is_new").select(columns)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.withColumn("metric_value", F.col("metric_value").cast("double")).select(columns).collect()))
    plan = baseline.rolled(first.localCheckpoint().filter("is_kept"), wrong.localCheckpoint())._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(", plan)) == 1
