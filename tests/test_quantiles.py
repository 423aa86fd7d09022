"""Quantiles of groups that a sketch does not hold whole."""

import datetime as dt

from pyspark.sql import functions as F

from plumbline.operators import json_paths, profile, quantiles

DAY = dt.date(2026, 3, 30)
N = 60_011


def numbers(spark):
    """Every number below N once under one key, and under a NULL key halves of a few numbers."""
    rows = spark.range(N, numPartitions=7).select(
        F.when(F.col("id") % 2 == 0, F.lit("d")).alias("dataset_name"), F.lit(DAY).alias("partition_date"),
        (F.col("id") * 7919 % N).alias("a"), (F.col("id") % 9 / 2).alias("b"), F.col("id"))
    return rows.select("*", F.when(F.col("id") % 11 != 0, F.col("a")).alias("gaps"))


def least(values, percent):
    """The least value whose rank reaches the share, in integers."""
    ordered = sorted(v for v in values if v is not None)
    return float(ordered[-(-len(ordered) * percent // 100) - 1])


def test_quantiles_of_large_groups_are_exact(spark):
    df = numbers(spark).cache()
    rows = df.collect()
    found = {(r.dataset_name, r.column_path): (r.p50, r.p95) for r in profile.column_stats(df, columns=["a", "b", "gaps"]).collect()}
    want = {
        (name, x): tuple(least([r[x] for r in rows if r.dataset_name == name], p) for p in quantiles.PERCENTS)
        for name in ("d", None) for x in ("a", "b", "gaps")
    }
    assert found == want


def test_bounds_beside_the_quantile_are_widened(spark):
    df = numbers(spark).select("dataset_name", F.col("a").cast("double").alias("value"))
    # bounds that all lie below or above the quantiles
    wrong = F.array(*(F.lit(float(x)) for x in (0, 0, 1, 2, 1, 2, 3, 4, N - 5, N - 2)))
    found = df.groupBy("dataset_name").agg(F.count("value").alias("n"), F.max(wrong).alias("sketch"))
    exact = {r.dataset_name: tuple(r.exact) for r in quantiles.exact(df, found, ["dataset_name"]).collect()}
    rows = df.collect()
    assert exact == {name: tuple(least([r.value for r in rows if r.dataset_name == name], p) for p in quantiles.PERCENTS) for name in ("d", None)}


def test_quantiles_of_large_json_groups_are_exact(spark):
    df = numbers(spark).filter(F.col("dataset_name").isNotNull()).select(
        "dataset_name", "partition_date", F.format_string('{"x": %d, "in": {"y": %d}}', "a", F.col("id") % 5).alias("j"), "a", "id").cache()
    rows = df.collect()
    found = {r.column_path: (r.p50, r.p95) for r in json_paths.leaf_stats(df.drop("a", "id"), ["j"]).collect()}
    assert found == {
        "j.x": tuple(least([r.a for r in rows], p) for p in quantiles.PERCENTS),
        "j.in.y": tuple(least([r.id % 5 for r in rows], p) for p in quantiles.PERCENTS),
    }


def test_small_groups_are_read_once(spark):
    df = numbers(spark).limit(quantiles.EXACT_BELOW - 1)
    assert quantiles.exact(df.select("dataset_name", F.col("a").cast("double").alias("value")), df.groupBy("dataset_name").agg(
        F.count("a").alias("n"), quantiles.sketch(F.col("a").cast("double")).alias("sketch")), ["dataset_name"]) is None
