"""The daily run: profile, judge, score and store all partitions of a batch at once.

The monitored rows are read once, and a second time for the quantiles of large partitions.  Their metrics, a few rows per
partition and column, are written to a staging folder; every check, the score
and the stored tables read that copy.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline import constants as c
from plumbline.operators import baseline, json_paths, patterns, profile, schema, score, sketches
from plumbline.plans import results
from plumbline.session import scratch_folder, staged
from plumbline.sources import store

METRIC_COLUMNS = (*c.KEYS, "check_type", "metric_name", "metric_value")


def judge(history: DataFrame, columns: Sequence[str], snapshots: DataFrame,
          partitions: DataFrame, has_event_time: bool | DataFrame = True) -> DataFrame:
    """Result rows of all partition checks for every date of the history.

    ``has_event_time``: a flag, or the partitions whose schema has no event time.
    """
    timeless = [] if has_event_time is True else [
        results.freshness_missing(partitions if has_event_time is False else has_event_time)
    ]
    return results.union([
        results.volume(history),
        results.zero_row(history),
        *([] if has_event_time is False else [results.freshness(history)]),
        *timeless,
        results.ops(history, columns),
        results.distribution(history, partitions),
        results.timestamp_sanity(history, partitions),
        results.schema_drift(snapshots),
        results.breaking_change(snapshots),
    ])


def judge_across(runs: DataFrame, history: DataFrame, partitions: DataFrame, *,
                 enrichment: DataFrame, config: DataFrame, lob_lookup: DataFrame, as_of) -> DataFrame:
    """Result rows of the checks over run history and configuration.

    ``runs``: active runs, those of the batch included.
    """
    return results.union([
        results.source_health(runs),
        results.correlation(runs),
        results.lineage(runs),
        results.cross_destination(runs),
        results.classification(runs, lob_lookup),
        results.sla_countdown(partitions, enrichment, as_of),
        results.inferred_sla(history, enrichment),
        results.orphan_detection(partitions, config),
    ])


def _empty_partition_metrics(partitions: DataFrame) -> DataFrame:
    """What profiling an empty partition gives: no rows and no event time."""
    rows = F.array(
        *(
            F.struct(
                F.lit(check).alias("check_type"), F.lit(name).alias("metric_name"),
                F.lit(value).cast("double").alias("metric_value"),
            )
            for check, name, value in (
                (c.VOLUME, "row_count", 0.0), (c.FRESHNESS, "hours_since_update", None),
            )
        )
    )
    return partitions.select(*c.KEYS, F.inline(rows))


def run(
    spark: SparkSession,
    monitored: DataFrame,
    folder: str,
    *,
    families: Sequence[profile.Measures],
    enrichment: DataFrame,
    at: Column,
    history: DataFrame | None = None,
    schema_history: DataFrame | None = None,
    expected: DataFrame | None = None,
    past_runs: DataFrame | None = None,
    config: DataFrame | None = None,
    lob_lookup: DataFrame | None = None,
    rerun_number: int = 0,
    orchestration_run_id: Column | None = None,
    json_columns: Sequence[str] = (),
    rerun: bool = False,
    keep_baselines: bool = False,
    keep_sketches: bool = False,
) -> None:
    """Check the partitions of ``monitored`` against ``history`` and store the results.

    ``history`` holds earlier metric rows, newest rerun per date; dates present
    in the batch replace theirs.  ``schema_history`` holds earlier snapshots.
    ``expected`` partitions without rows are checked with a row count of 0.
    With ``config`` only the enabled check types of a dataset are kept; with
    ``config`` and ``lob_lookup`` the checks across datasets run too, over
    ``past_runs`` (active run rows) and the runs of the batch.
    ``json_columns``: JSON text columns whose numeric leaves are measured too, as far as the
    explosion level that ``config`` gives a dataset says.
    With ``rerun`` active runs of the same datasets and dates end in the commit that shows the
    new ones, which take the rerun numbers that follow.
    With ``keep_baselines`` the newest values of every metric are kept in the store and the next
    batch reads them and no history; batches then come in date order, but for the last ten days.
    With ``keep_sketches`` a quantile sketch of every numeric column is stored too.
    """
    work = scratch_folder(spark)
    seen = store.last_commit(spark, folder)
    measured = staged(profile.metrics(monitored, families), f"{work}/metrics")
    leaves = leaf_metrics(monitored, measured, json_columns, config)
    if leaves is not None:
        measured = measured.unionByName(staged(leaves, f"{work}/leaves"))
    judge_and_store(
        spark, measured, folder, work,
        snapshots_of=lambda batch: schema.snapshot_of(monitored, batch),
        columns=[f.name for f in profile.value_columns(monitored, c.KEYS)],
        has_event_time=any("latest_event" in f.aggregates for f in families),
        enrichment=enrichment, at=at, history=history, schema_history=schema_history, expected=expected,
        past_runs=past_runs, config=config, lob_lookup=lob_lookup, rerun_number=rerun_number,
        orchestration_run_id=orchestration_run_id, rerun=rerun, keep_baselines=keep_baselines, seen=seen,
        sketch_rows=sketches.column_sketches(monitored) if keep_sketches else None,
    )


def leaf_metrics(df: DataFrame, named: DataFrame, json_columns: Sequence[str], config: DataFrame | None) -> DataFrame | None:
    """Metric rows of the JSON leaves that the configured levels ask for; None without any.

    ``named`` holds every dataset name of ``df``; without a configuration all levels are OFF.
    """
    present = [x for x in json_columns if x in df.columns]
    if not present or config is None:
        return None
    levels = patterns.explosion_levels(named.select("dataset_name").distinct(), config)
    return json_paths.leaf_metrics(json_paths.leaf_stats(df, present, levels))


def judge_and_store(
    spark: SparkSession,
    measured: DataFrame,
    folder: str,
    work: str,
    *,
    snapshots_of: Callable[[DataFrame], DataFrame],
    columns: Sequence[str],
    has_event_time: bool | DataFrame,
    enrichment: DataFrame,
    at: Column,
    history: DataFrame | None = None,
    schema_history: DataFrame | None = None,
    expected: DataFrame | None = None,
    past_runs: DataFrame | None = None,
    config: DataFrame | None = None,
    lob_lookup: DataFrame | None = None,
    rerun_number: int = 0,
    orchestration_run_id: Column | None = None,
    not_run: DataFrame | None = None,
    rerun: bool = False,
    keep_baselines: bool = False,
    seen: int | None = None,
    sketch_rows: DataFrame | None = None,
) -> None:
    """Judge the metric rows ``measured`` of a batch and store everything.

    ``not_run``: partitions that could not be checked (keys and ``reason``); each gets a
    run row without metrics.  ``seen``: the last commit of the store that the batch knows.
    """
    keys = list(c.KEYS)
    orchestration = (F.lit(None).cast("bigint") if orchestration_run_id is None else orchestration_run_id).alias("orchestration_run_id")
    fresh = measured
    if expected is not None:
        empty = expected.select(*keys).join(measured.select(*keys).distinct(), keys, "left_anti")
        fresh = measured.unionByName(_empty_partition_metrics(empty))
    batch = staged(fresh.select(*keys).distinct(), f"{work}/batch")
    seen = store.last_commit(spark, folder) if seen is None else seen
    kept = store.read_baselines(spark, folder, seen) if keep_baselines else None
    if kept is not None and history is None:
        first = batch.agg(F.min("partition_date")).first()[0]
        if first is not None and not baseline.reaches(kept, first):
            raise ValueError(f"the kept values do not reach back before {first}; pass the history")
        history = baseline.kept_history(kept)
    if history is None:
        known = fresh
    else:
        # one row per partition and metric remains, whichever side it came from
        older = _recent(history, batch, ["dataset_name", "check_type", "metric_name"], c.BASELINE_ROWS)
        both = older.select(*METRIC_COLUMNS).withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
        known = staged(baseline.latest_rerun(
            both, [*keys, "check_type", "metric_name"], [F.desc("_new")]
        ).drop("_new"), f"{work}/known")
    snapshots = snapshots_of(batch)
    if schema_history is not None:
        snapshots = snapshots.unionByName(
            _recent(schema_history, batch, ["dataset_name"], 1).join(batch, keys, "left_anti"), allowMissingColumns=True
        )
    checked = judge(known, columns, snapshots, batch, has_event_time).join(batch, keys, "left_semi")
    checked = staged(_enabled_only(checked, config), f"{work}/checked")

    scored = score.dq_score(
        checked.filter(F.col("name").isin(*c.SCORED_DETAILS.values())).select(*keys, "check_type", "status"),
        patterns.score_weights(batch, enrichment), keys=c.KEYS, on=["dataset_name"],
    )
    codes = patterns.lookup(
        batch, "dataset_name",
        patterns.active(enrichment).filter(F.col("lookup_code").isNotNull()), "lookup_code",
    )
    # every partition gets a run, also one without any scored check
    scored = staged(
        batch.join(scored, keys, "left").join(codes, "dataset_name", "left"), f"{work}/scores"
    )
    runs = scored.select(
        *keys, "lookup_code",
        F.coalesce("status", F.lit(c.NOT_RUN)).alias("check_status"),
        F.col("composite_score").cast("decimal(5,2)").alias("dqs_score"),
        orchestration,
        F.lit(None).cast("string").alias("error_message"),
    )
    parts = [
        checked,
        results.emit(
            scored.withColumns({
                "status": F.coalesce("status", F.lit(c.NOT_RUN)),
                "reason": F.coalesce("reason", F.lit("all_checks_unavailable")),
            }),
            c.DQS_SCORE, {"composite_score": "composite_score"},
            [("'dqs_score_breakdown'", {x: x for x in ("status", "composite_score", "reason", "unavailable_checks")})],
        ),
    ]
    if config is not None and lob_lookup is not None:
        active = runs.select(*keys, "lookup_code", "check_status", "dqs_score")
        if past_runs is not None:
            active = active.unionByName(
                past_runs.select(active.columns).join(batch, keys, "left_anti")
            )
        across = judge_across(active, known, batch, enrichment=enrichment, config=config,
                              lob_lookup=lob_lookup, as_of=at).join(batch, keys, "left_semi")
        parts.append(_enabled_only(across, config, always=[c.ORPHAN_DETECTION]))
    stored = staged(results.union(parts), f"{work}/results")

    identity = {
        "run_id": store.run_id(*keys, "rerun_number"),
        "create_date": at,
        "expiry_date": store.sentinel(),
    }
    values = _enabled_only(fresh, config).filter(F.col("metric_value").isNotNull()).unionByName(
        stored.filter(F.col("metric_value").isNotNull())
        .select(*keys, "check_type", F.col("name").alias("metric_name"), "metric_value")
    )
    texts = stored.filter(F.col("detail_value").isNotNull()).select(
        *keys, "check_type", F.col("name").alias("detail_type"), "detail_value"
    )
    if not_run is not None:
        absent = not_run.join(patterns.lookup(
            not_run, "dataset_name", patterns.active(enrichment).filter(F.col("lookup_code").isNotNull()), "lookup_code",
        ), "dataset_name", "left")
        runs = runs.unionByName(absent.select(
            *keys, "lookup_code", F.lit(c.NOT_RUN).alias("check_status"), F.lit(None).cast("decimal(5,2)").alias("dqs_score"),
            orchestration, F.col("reason").alias("error_message"),
        ))
    again = runs.select(*keys) if rerun else None
    if rerun and store.has_table(spark, folder, store.RUNS, seen):
        numbers = store.rerun_numbers(store.read_table(spark, folder, store.RUNS, seen), again)
        first = F.when(F.col("previous_rerun_number").isNull(), rerun_number).otherwise(F.col("rerun_number"))
        numbers = staged(numbers.select(*keys, first.alias("rerun_number")), f"{work}/numbers")
        numbered = lambda df: df.join(numbers, keys)
    else:
        numbered = lambda df: df.withColumn("rerun_number", F.lit(rerun_number))
    store.write_metrics(
        folder,
        numbered(runs).withColumns(identity),
        numbered(values).withColumns(identity).drop("rerun_number"),
        numbered(texts).withColumns(identity).drop("rerun_number"),
        sketches=None if sketch_rows is None else numbered(sketch_rows).withColumns(identity).drop("rerun_number"),
        replace=again, at=at, seen=seen, baselines=baseline.advanced(kept, fresh) if keep_baselines else None,
    )


def _recent(history: DataFrame, batch: DataFrame, group: Sequence[str], count: int) -> DataFrame:
    """History the batch can look at: the newest ``count`` rows of a group before the
    batch's first date, and everything since.  The limit is applied before the shuffle."""
    first = batch.agg(F.min("partition_date")).first()[0]
    if first is None:
        return history.limit(0)
    newest = Window.partitionBy(*group).orderBy(F.desc("partition_date"))
    before = history.filter(F.col("partition_date") < F.lit(first))
    before = before.withColumn("_nth", F.row_number().over(newest)).filter(F.col("_nth") <= count).drop("_nth")
    return before.unionByName(history.filter(F.col("partition_date") >= F.lit(first)))


def _enabled_only(rows: DataFrame, config: DataFrame | None, always: Sequence[str] = ()) -> DataFrame:
    """Rows of check types the configuration enables for the dataset.

    Orphan detection is about datasets without configuration and always stays.
    """
    if config is None:
        return rows
    enabled = patterns.enabled_checks(rows, config).withColumn("_on", F.lit(True))
    kept = rows.join(enabled, ["dataset_name", "check_type"], "left")
    return kept.filter(F.col("_on").isNotNull() | F.col("check_type").isin(*always)).drop("_on")
