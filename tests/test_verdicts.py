"""Status rules, with rows exactly on every threshold."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import verdicts as v


def judge(spark, rule, *values):
    names = [f"x{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} double" for n in names))
    return tuple(df.select(rule(*map(F.col, names)).alias("v")).select("v.*").first())


@pytest.mark.parametrize(
    "value, mean, stddev, n, want",
    [
        (104, 100, 10, 5, ("PASS", "within_baseline")),
        (110, 100, 10, 5, ("PASS", "within_baseline")),           # deviation = sigma
        (110.5, 100, 10, 5, ("WARN", "above_warn_threshold")),
        (120, 100, 10, 5, ("WARN", "above_warn_threshold")),      # deviation = 2 sigma
        (120.5, 100, 10, 5, ("FAIL", "above_fail_threshold")),
        (79.5, 100, 10, 5, ("FAIL", "above_fail_threshold")),     # two-sided
        (105, 100, 0, 5, ("PASS", "within_baseline")),            # 5 % of the mean
        (110, 100, 0, 5, ("WARN", "above_warn_threshold")),       # 10 % of the mean
        (1, 0, 0, 2, ("PASS", "within_baseline")),                # at least one row either way
        (2, 0, 0, 2, ("FAIL", "above_fail_threshold")),
        (999, 100, 10, 1, ("PASS", "baseline_unavailable")),
    ],
)
def test_volume(spark, value, mean, stddev, n, want):
    assert judge(spark, v.volume, *map(float, (value, mean, stddev, n))) == want


@pytest.mark.parametrize(
    "hours, mean, stddev, n, want",
    [
        (5.0, 4, 1, 3, ("PASS", "within_baseline")),
        (5.5, 4, 1, 3, ("WARN", "above_warn_threshold")),
        (6.0, 4, 1, 3, ("WARN", "above_warn_threshold")),
        (8.0, 4, 1, 3, ("FAIL", "above_fail_threshold")),
        (0.0, 4, 1, 3, ("PASS", "within_baseline")),              # one-sided
        (4.5, 4, 0, 3, ("PASS", "within_baseline")),
        (5.0, 4, 0, 3, ("WARN", "above_warn_threshold")),
        (99.0, 4, 1, 1, ("PASS", "baseline_unavailable")),
        (None, 4, 1, 3, ("NOT_RUN", "no_parseable_timestamps")),
    ],
)
def test_freshness(spark, hours, mean, stddev, n, want):
    assert judge(spark, v.freshness, hours, float(mean), float(stddev), float(n)) == want


@pytest.mark.parametrize(
    "pct, mean, stddev, n, want",
    [
        (100 / 7, 10, 2, 5, ("WARN", "above_warn_threshold")),
        (20.0, 5, 2, 5, ("FAIL", "above_fail_threshold")),
        (12.0, 10, 2, 5, ("PASS", "within_baseline")),
        (15.0, 10, 2, 5, ("WARN", "above_warn_threshold")),
        (11.0, 10, 0, 5, ("PASS", "within_baseline")),
        (100.0, 0, 0, 0, ("FAIL", "all_null_column")),            # even without a baseline
        (99.9, 0, 0, 1, ("PASS", "baseline_unavailable")),
    ],
)
def test_null_rate(spark, pct, mean, stddev, n, want):
    assert judge(spark, v.null_rate, pct, float(mean), float(stddev), float(n)) == want


@pytest.mark.parametrize(
    "mean, base_mean, base_stddev, want",
    [
        (130, 100, 5, ("FAIL", "distribution_shift_detected")),
        (112, 100, 5, ("WARN", "distribution_shift_detected")),
        (115, 100, 5, ("WARN", "distribution_shift_detected")),   # z = 3
        (110, 100, 5, ("PASS", "within_baseline")),               # z = 2
        (100, 100, 0, ("PASS", "within_baseline")),
        (100.1, 100, 0, ("WARN", "distribution_shift_detected")),
        (100, None, None, ("PASS", "baseline_unavailable")),
    ],
)
def test_shift(spark, mean, base_mean, base_stddev, want):
    as_float = lambda x: None if x is None else float(x)
    assert judge(spark, v.shift, *map(as_float, (mean, base_mean, base_stddev))) == want


@pytest.mark.parametrize(
    "future, stale, want",
    [
        (0.05, 0.05, ("PASS", None)),
        (0.6, 0.0, ("FAIL", "future_timestamps_exceed_threshold")),
        (0.0, 0.6, ("FAIL", "stale_timestamps_exceed_threshold")),
        (0.6, 0.6, ("FAIL", "future_timestamps_exceed_threshold_and_stale_timestamps_exceed_threshold")),
    ],
)
def test_timestamp_sanity(spark, future, stale, want):
    assert judge(spark, v.timestamp_sanity, future, stale) == want


@pytest.mark.parametrize(
    "remaining, sla, want",
    [(-1.0, 10.0, "FAIL"), (0.0, 10.0, "WARN"), (2.0, 10.0, "WARN"), (3.0, 10.0, "PASS")],
)
def test_sla_countdown(spark, remaining, sla, want):
    assert judge(spark, v.sla_countdown, remaining, sla)[0] == want


@pytest.mark.parametrize(
    "score, want",
    [(80.0, "PASS"), (79.99, "WARN"), (50.0, "WARN"), (49.99, "FAIL"), (None, "NOT_RUN")],
)
def test_composite(spark, score, want):
    df = spark.createDataFrame([(score,)], "x double")
    assert df.select(v.composite(F.col("x"))).first()[0] == want


@pytest.mark.parametrize("score, want", [(80.0, "healthy"), (60.0, "degraded"), (59.9, "critical"), (None, None)])
def test_score_band(spark, score, want):
    df = spark.createDataFrame([(score,)], "x double")
    assert df.select(v.score_band(F.col("x"))).first()[0] == want
