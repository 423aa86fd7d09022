"""Headers read by executors, families by fingerprint, halving of failing families, JSON in runs."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.plans import derived as d, file_run
from plumbline.session import scratch_folder
from plumbline.sources import files, headers, store

FOREVER = dt.datetime(9999, 12, 31, 23, 59, 59)
CONFIG = "id bigint, dataset_pattern string, check_type string, enabled boolean, explosion_level int, expiry_date timestamp_ntz"


def at():
    return F.lit("2026-04-01 06:00:00").cast("timestamp_ntz")


def write(spark, root, source, frame, day="20260330"):
    frame.coalesce(1).write.parquet(f"{root}/partition_date={day}/src_sys_nm={source}")


def junk(root, source, data=b"PAR1 nothing", name="part-0.parquet"):
    folder = f"{root}/partition_date=20260330/src_sys_nm={source}"
    os.makedirs(folder)
    with open(f"{folder}/{name}", "wb") as f:
        f.write(data)


def avro_header(schema: dict) -> bytes:
    def number(n):
        n, out = n << 1, bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes(out) + bytes([n])
    pairs = [(b"avro.codec", b"null"), (b"avro.schema", json.dumps(schema).encode())]
    return b"Obj\x01" + number(len(pairs)) + b"".join(number(len(x)) + x for p in pairs for x in p) + number(0) + b"0" * 16


@pytest.fixture()
def root():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_headers(spark, root):
    one = spark.range(3).selectExpr("id", "id * 1.5D AS x")
    write(spark, root, "a", one)
    write(spark, root, "b b", one.selectExpr("id", "cast(NULL AS double) AS x"))
    write(spark, root, "c", one.selectExpr("x", "id"))
    write(spark, root, "t", one.selectExpr("id", "timestamp_seconds(id) AS x"))
    write(spark, root, "n", one.selectExpr("id", "cast(timestamp_seconds(id) AS timestamp_ntz) AS x"))
    junk(root, "bad")
    junk(root, "csv", b"1,2", "part.csv")
    junk(root, "av", avro_header({"type": "record", "name": "r", "doc": "x" * 200_000, "fields": [{"name": "id", "type": "long", "default": 1}]}), "p.avro")
    junk(root, "av2", avro_header({"type": "record", "name": "r", "fields": [{"name": "id", "type": "long"}]}), "p.avro")
    junk(root, "avbad", b"Obj\x01\x02", "p.avro")
    found = {r.directory: r for r in headers.fingerprints(headers.directories(files.inventory(spark, root))).collect()}
    prints = {k: r.fingerprint for k, r in found.items()}
    assert prints["a"] == prints["b b"] and len({prints[x] for x in "actn"}) == 4
    assert prints["av"] == prints["av2"] != prints["a"] and found["av"].format == files.AVRO
    assert found["csv"].format == files.UNSUPPORTED and prints["csv"] is None
    assert found["bad"].problem and found["avbad"].problem and not found["a"].problem


def test_families_open_no_directory_on_the_driver(spark, root, monkeypatch):
    for k in range(6):
        write(spark, root, f"s{k}", spark.range(2).selectExpr("id", "id AS x" if k % 2 else "cast(id AS string) AS x"))
    monkeypatch.setattr(file_run, "_spark_schema", lambda *_: pytest.fail("opened on the driver"))
    groups, bad = file_run.families(spark, root)
    assert sorted(len(x) for x in groups.values()) == [3, 3] and not bad


def test_halving_takes_few_attempts():
    class Data(PySparkException):
        def __init__(self):
            super().__init__("[FAILED_READ_FILE.NO_HINT] in a file", errorClass="FAILED_READ_FILE.NO_HINT", messageParameters={})
        def getCondition(self):
            return "FAILED_READ_FILE.NO_HINT"
        def __str__(self):
            return "[FAILED_READ_FILE.NO_HINT] in a file"

    tries = []
    def attempt(rows):
        tries.append(len(rows))
        if 617 in rows:
            raise Data()
        return sum(rows)
    results, bad = file_run.isolate(range(1000), attempt)
    assert bad == [617] and len(tries) <= 22
    assert sum(r for r, _ in results) == sum(range(1000)) - 617 and sum(len(p) for _, p in results) == 999


@pytest.mark.parametrize("message", ["ExecutorLostFailure (executor 3)", "No space left on device", "something unknown"])
def test_cluster_faults_are_raised(message):
    class Fault(PySparkException):
        def getCondition(self):
            return None
        def __str__(self):
            return message

    def attempt(rows):
        raise Fault("x")
    with pytest.raises(Fault):
        file_run.isolate([1, 2], attempt)


def test_a_file_that_breaks_late(spark, root):
    """Its footer is whole and its pages are not: the header passes, the profile fails."""
    frame = spark.range(5000).selectExpr("id", "uuid() AS note")
    for k in range(5):
        write(spark, root, f"s{k}", frame)
    folder = f"{root}/partition_date=20260330/src_sys_nm=s3"
    name = next(x for x in os.listdir(folder) if x.endswith(".parquet") and not x.startswith("."))
    with open(f"{folder}/{name}", "r+b") as f:
        f.seek(4)
        f.write(b"\xff" * 20000)
    os.remove(f"{folder}/.{name}.crc")
    store_folder = scratch_folder(spark)
    file_run.run_orchestrated(spark, [root], store_folder, start=at(), end=at(), enrichment=d.enrichment(spark), at=at())
    runs = {r.dataset_name: r for r in store.read_table(spark, store_folder, store.RUNS).collect()}
    assert {k: r.error_message for k, r in runs.items() if r.error_message} == {"src_sys_nm=s3": file_run.EXECUTION_ERROR}
    assert len(runs) == 5 and runs["src_sys_nm=s3"].check_status == "NOT_RUN"
    final = store.read_orchestrations(spark, store_folder).first()
    assert (final.run_status, final.total_datasets, final.not_run_datasets) == ("completed_with_errors", 5, 1)


def test_json_levels_of_a_run(spark, root):
    """OFF, TOP_LEVEL and ALL by configuration; the statistics are stored and judged."""
    text = "'{\"a\": 2, \"b\": {\"c\": 4}}' AS eventAttribute"
    for source in ("off", "top", "all"):
        write(spark, root, source, spark.range(4).selectExpr("id", text))
    config = spark.createDataFrame([
        (1, "src_sys_nm=top", "DISTRIBUTION", True, 1, FOREVER), (2, "src_sys_nm=all", "DISTRIBUTION", True, 2, FOREVER),
        (3, "src_sys_nm=off", "DISTRIBUTION", True, 0, FOREVER)], CONFIG)
    folder = scratch_folder(spark)
    file_run.run(spark, root, folder, enrichment=d.enrichment(spark), config=config, at=at())
    rows = store.read_table(spark, folder, store.NUMERICS).filter("metric_name LIKE 'eventAttribute.%'").collect()
    assert {(r.dataset_name, r.metric_name): r.metric_value for r in rows if r.metric_name.endswith(".mean")} == {
        ("src_sys_nm=top", "eventAttribute.a.mean"): 2.0, ("src_sys_nm=all", "eventAttribute.a.mean"): 2.0,
        ("src_sys_nm=all", "eventAttribute.b.c.mean"): 4.0}
    kinds = {r.detail_type for r in store.read_table(spark, folder, store.DETAILS).filter("dataset_name = 'src_sys_nm=all'").collect()}
    assert "eventAttribute.b.c.status" in kinds


def test_rerun_in_one_commit(spark, root):
    write(spark, root, "a", spark.range(3))
    folder = scratch_folder(spark)
    options = {"enrichment": d.enrichment(spark), "at": at(), "rerun": True}
    for _ in range(3):
        file_run.run(spark, root, folder, **options)
    runs = sorted((r.rerun_number, r.next_rerun_number, r.expiry_date == FOREVER) for r in store.read_table(spark, folder, store.RUNS).collect())
    assert runs == [(0, 1, False), (1, 2, False), (2, None, True)]
    assert store.last_commit(spark, folder) == 2
    numerics = store.active(store.read_table(spark, folder, store.NUMERICS))
    assert numerics.select("run_id").distinct().count() == 1
