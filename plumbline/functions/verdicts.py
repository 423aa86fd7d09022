"""Status rules as column expressions.

Each rule returns a ``struct<status, reason>`` so that one expression decides
both.  Rules are listed in order; the first that holds wins.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plumbline import constants as c


def _verdict(status: str, reason: str | Column) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(status).alias("status"), reason.alias("reason"))


def decide(rules, otherwise) -> Column:
    """``rules`` is a list of (condition, status, reason); ``otherwise`` (status, reason)."""
    chain = None
    for condition, status, reason in rules:
        outcome = _verdict(status, reason)
        chain = F.when(condition, outcome) if chain is None else chain.when(condition, outcome)
    return chain.otherwise(_verdict(*otherwise))


def _banded(deviation: Column, warn: Column, fail: Column, samples: Column, before=()) -> Column:
    return decide(
        [
            *before,
            (samples < c.BASELINE_MIN_SAMPLES, c.PASS, "baseline_unavailable"),
            (deviation <= warn, c.PASS, "within_baseline"),
            (deviation <= fail, c.WARN, "above_warn_threshold"),
        ],
        (c.FAIL, "above_fail_threshold"),
    )


def volume(value: Column, mean: Column, stddev: Column, samples: Column) -> Column:
    """Two-sided: distance from the mean against sigma and a share of the mean."""
    return _banded(
        F.abs(value - mean),
        F.greatest(stddev, F.lit(1.0), mean * 0.05),
        F.greatest(stddev * 2.0, F.lit(1.0), mean * 0.10),
        samples,
    )


def freshness(hours: Column, mean: Column, stddev: Column, samples: Column) -> Column:
    """One-sided: only later than usual counts."""
    return _banded(
        hours,
        mean + F.greatest(stddev, F.lit(0.5)),
        mean + F.greatest(stddev * 2.0, F.lit(1.0)),
        samples,
        before=[(hours.isNull(), c.NOT_RUN, "no_parseable_timestamps")],
    )


def null_rate(pct: Column, mean: Column, stddev: Column, samples: Column) -> Column:
    return _banded(
        pct,
        mean + F.greatest(stddev, F.lit(1.0)),
        mean + F.greatest(stddev * 2.0, F.lit(5.0)),
        samples,
        before=[(pct == 100.0, c.FAIL, "all_null_column")],
    )


def shift_score(mean: Column, base_mean: Column, base_stddev: Column) -> Column:
    """z-score; the plain distance where the baseline has no spread."""
    distance = F.abs(mean - base_mean)
    return F.when(base_stddev == 0.0, distance).otherwise(
        F.abs((mean - base_mean) / F.nullif(base_stddev, F.lit(0.0)))
    )


def shift(mean: Column, base_mean: Column, base_stddev: Column) -> Column:
    z = shift_score(mean, base_mean, base_stddev)
    return decide(
        [
            (base_mean.isNull(), c.PASS, "baseline_unavailable"),
            ((base_stddev == 0.0) & (mean == base_mean), c.PASS, "within_baseline"),
            (base_stddev == 0.0, c.WARN, "distribution_shift_detected"),
            (z > c.Z_FAIL, c.FAIL, "distribution_shift_detected"),
            (z > c.Z_WARN, c.WARN, "distribution_shift_detected"),
        ],
        (c.PASS, "within_baseline"),
    )


def timestamp_sanity(future_pct: Column, stale_pct: Column) -> Column:
    limit = c.BAD_TIMESTAMP_SHARE
    future = "future_timestamps_exceed_threshold"
    stale = "stale_timestamps_exceed_threshold"
    none = F.lit(None).cast("string")
    return decide(
        [
            ((future_pct > limit) & (stale_pct > limit), c.FAIL, f"{future}_and_{stale}"),
            (future_pct > limit, c.FAIL, future),
            (stale_pct > limit, c.FAIL, stale),
        ],
        (c.PASS, none),
    )


def sla_countdown(remaining: Column, sla_hours: Column) -> Column:
    return decide(
        [
            (remaining < 0.0, c.FAIL, "sla_breached"),
            (remaining <= sla_hours * c.SLA_WARN_SHARE, c.WARN, "approaching_sla"),
        ],
        (c.PASS, "within_sla"),
    )


def inferred_sla(points: Column, deviation: Column, inferred: Column) -> Column:
    """Hours exactly at a limit are within it, whatever the last bits of mean and deviation are."""
    none = F.lit(None).cast("string")
    tie = F.abs(inferred) * c.INFERRED_SLA_TIE
    return decide(
        [
            (points < c.INFERRED_SLA_MIN_POINTS, c.PASS, "insufficient_history"),
            (deviation > tie, c.FAIL, none),
            ((inferred > 0.0) & (deviation + inferred * c.SLA_WARN_SHARE > tie), c.WARN, none),
        ],
        (c.PASS, none),
    )


def composite(score: Column) -> Column:
    return (
        F.when(score >= c.SCORE_PASS_AT, c.PASS)
        .when(score >= c.SCORE_WARN_AT, c.WARN)
        .when(score.isNotNull(), c.FAIL)
        .otherwise(c.NOT_RUN)
    )


def score_band(score: Column, bands=c.SCORE_BANDS) -> Column:
    healthy, degraded = bands
    return (
        F.when(score >= healthy, "healthy")
        .when(score >= degraded, "degraded")
        .when(score.isNotNull(), "critical")
    )


def severity(status: Column) -> Column:
    return (
        F.when(status == c.FAIL, c.SEVERITY[c.FAIL])
        .when(status == c.WARN, c.SEVERITY[c.WARN])
        .otherwise(c.SEVERITY[c.PASS])
    )


def from_severity(rank: Column) -> Column:
    return (
        F.when(rank == c.SEVERITY[c.FAIL], c.FAIL)
        .when(rank == c.SEVERITY[c.WARN], c.WARN)
        .otherwise(c.PASS)
    )
