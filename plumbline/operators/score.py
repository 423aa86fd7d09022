"""Composite quality score from check statuses.

The four scored checks become columns of one row per run in a single grouping;
weights are renormalised over the checks that are available.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import constants as c
from plumbline.functions.verdicts import composite


def status_score(status: Column) -> Column:
    chain = None
    for name, score in c.STATUS_SCORES.items():
        chain = (F.when(status == name, F.lit(score)) if chain is None
                 else chain.when(status == name, F.lit(score)))
    return chain


def detail_status(detail_value: Column) -> Column:
    """``$.status`` of a JSON detail; NULL for bad JSON."""
    return F.get_json_object(detail_value, "$.status")


def statuses_from_details(details: DataFrame) -> DataFrame:
    """(run_id, check_type, status) of the detail rows that carry a scored status."""
    pairs = None
    for check, detail in c.SCORED_DETAILS.items():
        hit = (F.col("check_type") == check) & (F.col("detail_type") == detail)
        pairs = hit if pairs is None else pairs | hit
    return details.filter(pairs).select(
        "run_id", "check_type", detail_status(F.col("detail_value")).alias("status")
    )


def _wide(statuses: DataFrame, keys: Sequence[str]) -> DataFrame:
    score = status_score(F.col("status"))
    return statuses.groupBy(*keys).agg(
        *(F.max(F.when(F.col("check_type") == k, score)).alias(f"score_{k}") for k in c.DEFAULT_WEIGHTS)
    )


def _weighted(wide: DataFrame, weights: DataFrame | None, on: Sequence[str]) -> DataFrame:
    """Add weight_X, norm_X and contribution_X for every available check X."""
    if weights is None:
        raw = {k: F.lit(w) for k, w in c.DEFAULT_WEIGHTS.items()}
    else:
        wide = wide.join(weights, list(on), "left")
        raw = {
            k: F.coalesce(F.col("weights")[k], F.when(F.col("weights").isNull(), F.lit(w)), F.lit(0.0))
            for k, w in c.DEFAULT_WEIGHTS.items()
        }
    available = {k: F.col(f"score_{k}").isNotNull() for k in raw}
    wide = wide.withColumns({f"_raw_{k}": F.when(available[k], raw[k]) for k in raw})
    total = sum((F.coalesce(f"_raw_{k}", F.lit(0.0)) for k in raw), F.lit(0.0))
    wide = wide.withColumn("_total", total)
    # no weight at all: every available check counts the same
    flat = F.col("_total") <= 0.0
    wide = wide.withColumns(
        {f"weight_{k}": F.when(available[k], F.when(flat, F.lit(1.0)).otherwise(F.col(f"_raw_{k}")))
         for k in raw}
    )
    n = sum((F.when(available[k], 1.0).otherwise(0.0) for k in raw), F.lit(0.0))
    wide = wide.withColumn("_total", F.when(flat, n).otherwise(F.col("_total")))
    wide = wide.withColumns(
        {f"norm_{k}": F.col(f"weight_{k}") / F.nullif(F.col("_total"), F.lit(0.0)) for k in raw}
    )
    wide = wide.withColumns({f"contribution_{k}": F.col(f"norm_{k}") * F.col(f"score_{k}") for k in raw})
    return wide.withColumn("available_checks", n.cast("int"))


def dq_score(statuses: DataFrame, weights: DataFrame | None = None,
             keys: Sequence[str] = ("run_id",), on: Sequence[str] = ("run_id",)) -> DataFrame:
    """Score, status and reason per run.

    ``statuses``: (keys, check_type, status).  ``weights``: (on, weights MAP);
    runs without a row use the default weights.
    """
    w = _weighted(_wide(statuses, keys), weights, on)
    total = sum((F.coalesce(f"contribution_{k}", F.lit(0.0)) for k in c.DEFAULT_WEIGHTS), F.lit(0.0))
    none = F.col("available_checks") == 0
    clamped = F.when(~none, F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)))
    missing = F.concat_ws(
        ",", *(F.when(F.col(f"score_{k}").isNull(), k) for k in c.DEFAULT_WEIGHTS)
    )
    out = w.select(*keys, clamped.alias("composite_score"), "available_checks",
                   missing.alias("unavailable_checks"))
    return out.withColumns(
        {
            "status": composite(F.col("composite_score")),
            "reason": F.when(none, "all_checks_unavailable")
            .when(F.col("available_checks") == len(c.DEFAULT_WEIGHTS), "composite_computed")
            .otherwise("partial_checks"),
        }
    )


def breakdown(statuses: DataFrame, weights: DataFrame | None = None,
              keys: Sequence[str] = ("run_id",), on: Sequence[str] = ("run_id",)) -> DataFrame:
    """One row per run and available check: score, weight, normalized weight, contribution."""
    w = _weighted(_wide(statuses, keys), weights, on)
    parts = F.array(
        *(
            F.struct(
                F.lit(k).alias("check_type"),
                F.col(f"score_{k}").alias("score"),
                F.col(f"weight_{k}").alias("weight"),
                F.col(f"norm_{k}").alias("normalized_weight"),
                F.col(f"contribution_{k}").alias("contribution"),
            )
            for k in c.DEFAULT_WEIGHTS
        )
    )
    return w.select(*keys, F.inline(parts)).filter(F.col("score").isNotNull())


def run_status(runs: DataFrame, details: DataFrame, numerics: DataFrame) -> DataFrame:
    """Run status and score from its score detail and metric; UNKNOWN without one.

    The first stored row decides when there are several.
    """
    status = (
        details.filter(
            (F.col("check_type") == c.DQS_SCORE) & (F.col("detail_type") == "dqs_score_breakdown")
        )
        .groupBy("run_id")
        .agg(F.min_by(detail_status(F.col("detail_value")), "detail_id").alias("check_status"))
    )
    score = (
        numerics.filter(
            (F.col("check_type") == c.DQS_SCORE) & (F.col("metric_name") == "composite_score")
        )
        .groupBy("run_id")
        .agg(F.min_by(F.col("metric_value"), "metric_id").alias("dqs_score"))
    )
    return (
        runs.select("run_id").distinct()
        .join(status, "run_id", "left")
        .join(score, "run_id", "left")
        .select(
            "run_id",
            F.coalesce("check_status", F.lit(c.UNKNOWN)).alias("check_status"),
            F.col("dqs_score").cast("decimal(5,2)").alias("dqs_score"),
        )
    )
