import datetime as dt

from pyspark.sql import types as T

from plumbline.operators import schema

D1, D2 = dt.date(2026, 3, 29), dt.date(2026, 3, 30)
BASE = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("status", T.StringType())])
ADDED = T.StructType([*BASE.fields, T.StructField("new_field", T.StringType())])
BROKEN = T.StructType([T.StructField("id", T.StringType(), False)])


def status(spark, *schemas):
    days = [D1, D2][: len(schemas)]
    snaps = schema.snapshot(spark, [("d", day, s) for day, s in zip(days, schemas)])
    return schema.schema_status(snaps).orderBy("partition_date").collect()[-1]


def test_flatten_nested():
    nested = T.StructType([
        T.StructField("a", T.StructType([T.StructField("b", T.IntegerType(), False)])),
        T.StructField("items", T.ArrayType(T.StructType([T.StructField("p", T.DoubleType())]), False)),
        T.StructField("attrs", T.MapType(T.StringType(), T.LongType(), True)),
    ])
    flat = schema.flatten(nested)
    assert flat["a.b"] == "type=int,nullable=false"
    assert flat["items[]"] == "type=struct<p:double>,nullable=false"
    assert flat["items[].p"] == "type=double,nullable=true"
    assert flat["attrs{}.key"] == "type=string,nullable=false"
    assert flat["attrs{}.value"] == "type=bigint,nullable=true"
    assert schema.field_names(nested) == ["a", "a.b", "items", "items[].p", "attrs"]


def test_first_same_added_and_broken(spark):
    assert (status(spark, BASE).status, status(spark, BASE).reason) == ("PASS", "baseline_unavailable")
    same = status(spark, BASE, BASE)
    assert (same.status, same.reason) == ("PASS", "no_schema_drift")
    added = status(spark, BASE, ADDED)
    assert (added.status, added.reason, added.added_fields) == ("WARN", "schema_additive_change", "new_field")
    broken = status(spark, BASE, BROKEN)
    assert (broken.status, broken.reason) == ("FAIL", "schema_breaking_change")
    assert (broken.removed_fields, broken.changed_fields) == ("status", "id")


def test_baseline_known_by_hash_only(spark):
    snaps = schema.snapshot(spark, [("d", D1, BASE), ("d", D2, ADDED)])
    blank = snaps.replace({BASE.json(): " "}, subset=["schema_json"])
    last = schema.schema_status(blank).orderBy("partition_date").collect()[-1]
    assert (last.status, last.changed_count, last.changed_fields) == ("FAIL", 1, "$schema")


def test_drift_rows(spark):
    snaps = schema.snapshot(spark, [("d", D1, BASE), ("d", D2, BROKEN)])
    rows = {(r.field_path, r.change): (r.before, r.after) for r in schema.field_drift(snaps).collect()}
    assert rows[("id", "changed")] == ("type=bigint,nullable=false", "type=string,nullable=false")
    assert rows[("status", "removed")] == ("type=string,nullable=true", None)


def test_breaking_change_ignores_types(spark):
    retyped = T.StructType([T.StructField("id", T.StringType()), T.StructField("status", T.LongType())])
    snaps = schema.snapshot(spark, [("d", D1, BASE), ("d", D2, retyped), ("e", D1, BASE), ("e", D2, BROKEN)])
    rows = {(r.dataset_name, r.partition_date): r for r in schema.breaking_change(snaps).collect()}
    assert rows[("d", D1)].reason == "baseline_unavailable"
    assert rows[("d", D2)].reason == "no_breaking_changes"
    assert (rows[("e", D2)].status, rows[("e", D2)].removed_fields) == ("FAIL", "status")


def test_hash_and_snapshot_of_a_frame(spark):
    df = spark.createDataFrame([("d", D1, 1)], "dataset_name string, partition_date date, id bigint")
    row = schema.snapshot_of(df, df).first()
    assert row.schema_hash.startswith("sha256:") and len(row.schema_hash) == 7 + 64
    assert row.fields == {"id": "type=bigint,nullable=true"} and row.names == ["id"]
