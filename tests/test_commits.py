"""Several writers, crashes, expiry with rerun, compaction and orchestration versions of the store."""

import datetime as dt
import json

import pytest

from plumbline.session import scratch_folder
from plumbline.sources import store

DAY = dt.date(2026, 3, 30)
FOREVER = dt.datetime(9999, 12, 31, 23, 59, 59)
AT, LATER = dt.datetime(2026, 4, 1), dt.datetime(2026, 4, 2)
RUNS = ("run_id bigint, dataset_name string, partition_date date, rerun_number int, check_status string, "
        "orchestration_run_id bigint, expiry_date timestamp_ntz")


def batch(spark, first_id, *names, rerun=0, status="PASS", orchestration=None):
    runs = spark.createDataFrame([(first_id + k, n, DAY, rerun, status, orchestration, FOREVER) for k, n in enumerate(names)], RUNS)
    rest = runs.selectExpr("run_id", "dataset_name", "partition_date", "'m' AS metric_name", "1.5D AS metric_value", "expiry_date")
    return runs, rest, rest.selectExpr("run_id", "dataset_name", "partition_date", "'d' AS detail_type", "expiry_date")


def keys(*names, spark):
    return spark.createDataFrame([(n, DAY) for n in names], "dataset_name string, partition_date date")


def active_ids(spark, folder, name=store.RUNS, **options):
    return sorted(r.run_id for r in store.active(store.read_table(spark, folder, name, **options)).collect())


def test_interleaved_writers(spark):
    """Both begin at the same state: different datasets both go in, equal ones do not."""
    folder = scratch_folder(spark)
    store.write_metrics(folder, *batch(spark, 1, "a"))
    seen = store.last_commit(spark, folder)
    assert store.write_metrics(folder, *batch(spark, 10, "b"), seen=seen) == seen + 1
    assert store.write_metrics(folder, *batch(spark, 20, "c"), seen=seen) == seen + 2
    with pytest.raises(store.Conflict):
        store.write_metrics(folder, *batch(spark, 30, "b"), replace=keys("b", spark=spark), at=AT, seen=seen)
    assert active_ids(spark, folder) == [1, 10, 20]
    # begun again from the present state it is a rerun
    store.write_metrics(folder, *batch(spark, 30, "b", rerun=1), replace=keys("b", spark=spark), at=AT)
    assert active_ids(spark, folder) == [1, 20, 30] == active_ids(spark, folder, store.NUMERICS) == active_ids(spark, folder, store.DETAILS)
    old = store.read_table(spark, folder, store.RUNS).filter("run_id = 10").first()
    assert (old.expiry_date, old.next_rerun_number) == (AT, 1)
    assert active_ids(spark, folder, as_of=seen + 2) == [1, 10, 20]


def test_crash_before_the_commit_changes_nothing(spark, monkeypatch):
    folder = scratch_folder(spark)
    store.write_metrics(folder, *batch(spark, 1, "a"))
    monkeypatch.setattr(store, "_claim", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.write_metrics(folder, *batch(spark, 2, "a", rerun=1), replace=keys("a", spark=spark), at=AT)
    monkeypatch.undo()
    assert active_ids(spark, folder) == [1]
    store.write_metrics(folder, *batch(spark, 2, "a", rerun=1), replace=keys("a", spark=spark), at=AT)
    assert active_ids(spark, folder) == [2]


def test_unfinished_commit_file_is_passed_over(spark, monkeypatch):
    monkeypatch.setattr(store, "_SETTLE_TENTHS", 1)
    folder = scratch_folder(spark)
    store.write_metrics(folder, *batch(spark, 1, "a"))
    for text in ("", '{"batch_id": "b-x", "se'):
        path, system = store._path(spark, f"{folder}/commits/{store.last_commit(spark, folder) + 1:012d}.json")
        out = system.create(path, False)
        out.write(bytearray(text.encode()))
        out.close()
    assert active_ids(spark, folder) == [1]
    assert store.write_metrics(folder, *batch(spark, 2, "b"), seen=0) == 3
    assert active_ids(spark, folder) == [1, 2]
    assert not store._claim(spark, folder, 3, {}) and json.dumps({}) == "{}"


def test_compaction(spark):
    folder = scratch_folder(spark)
    store.write_metrics(folder, *batch(spark, 1, "a", "b"))
    store.apply_expiry(spark, folder, keys("a", spark=spark), AT)
    seen = store.last_commit(spark, folder)
    before = sorted(map(tuple, store.read_table(spark, folder, store.RUNS).collect()))
    # a writer that commits while the compaction reads stays visible
    store.write_metrics(folder, *batch(spark, 5, "late"))
    tables = {n: store.read_table(spark, folder, n, seen) for n in (store.NUMERICS, store.DETAILS, store.RUNS)}
    store._commit(spark, folder, tables, seen, covers=seen)
    rows = sorted(map(tuple, store.read_table(spark, folder, store.RUNS).collect()))
    assert [r for r in rows if r[0] != 5] == before and len(rows) == 3
    store.compact(spark, folder)
    assert sorted(map(tuple, store.read_table(spark, folder, store.RUNS).collect())) == rows
    assert len(store._commits(spark, folder)) == 1
    store.apply_expiry(spark, folder, keys("b", "a", spark=spark), LATER)
    ends = {r.run_id: r.expiry_date for r in store.read_table(spark, folder, store.RUNS).collect()}
    assert ends == {1: AT, 2: LATER, 5: FOREVER}


def test_orchestration_versions(spark):
    folder = scratch_folder(spark)
    started = store.start_orchestration(spark, ["p/a", "p/b", "p/none"], AT)
    ids = {r.parent_path: r.orchestration_run_id for r in started.collect()}
    store.write_running(folder, started)
    store.write_metrics(folder, *batch(spark, 1, "x", orchestration=ids["p/a"]))
    store.write_metrics(folder, *batch(spark, 2, "y", status="NOT_RUN", orchestration=ids["p/a"]))
    store.write_metrics(folder, *batch(spark, 3, "z", status="WARN", orchestration=ids["p/b"]))
    begun = store.last_commit(spark, folder)
    errors = spark.createDataFrame([(ids["p/none"], "no such folder")], "orchestration_run_id bigint, error_summary string")
    store.finalize(spark, folder, LATER, errors)
    got = {r.parent_path: r for r in store.read_orchestrations(spark, folder).collect()}
    assert [(got[p].run_status, got[p].total_datasets, got[p].passed_datasets, got[p].failed_datasets, got[p].not_run_datasets, got[p].error_summary)
            for p in ("p/a", "p/b", "p/none")] == [
        ("completed_with_errors", 2, 1, 0, 1, "1 not run"), ("completed", 1, 0, 0, 0, None), ("completed_with_errors", 0, 0, 0, 0, "no such folder")]
    assert {r.run_status for r in store.read_orchestrations(spark, folder, begun).collect()} == {"running"}
    store.compact(spark, folder)
    store.write_running(folder, store.start_orchestration(spark, ["p/a"], LATER))
    again = sorted((r.parent_path, r.run_status, r.expiry_date) for r in store.read_orchestrations(spark, folder).collect())
    assert again[:2] == [("p/a", "completed_with_errors", LATER), ("p/a", "running", FOREVER)] and len(again) == 4
    assert store.read_orchestrations(spark, scratch_folder(spark)).count() == 0
