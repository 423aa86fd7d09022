"""Schema snapshots and their drift.

A snapshot is one row per dataset and date: ``schema_hash``, ``schema_json`` and
``fields``, a map from field path to descriptor.  A map is as wide as one schema,
so comparing two neighbouring snapshots needs one window and no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from plumbline import constants as c

HASH_PREFIX = "sha256:"


def flatten(schema: T.StructType) -> dict[str, str]:
    """Field path -> ``type=...,nullable=...`` for every level of a schema."""
    out: dict[str, str] = {}

    def visit(path: str, kind: T.DataType, nullable: bool) -> None:
        out[path] = f"type={kind.simpleString()},nullable={str(nullable).lower()}"
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                visit(f"{path}.{f.name}", f.dataType, f.nullable)
        elif isinstance(kind, T.ArrayType):
            visit(f"{path}[]", kind.elementType, kind.containsNull)
        elif isinstance(kind, T.MapType):
            visit(f"{path}{{}}.key", kind.keyType, False)
            visit(f"{path}{{}}.value", kind.valueType, kind.valueContainsNull)

    for f in schema.fields:
        visit(f.name, f.dataType, f.nullable)
    return out


def field_names(schema: T.StructType) -> list[str]:
    """Paths whose loss breaks readers: struct children and fields of arrays of structs."""
    names: list[str] = []

    def visit(struct: T.StructType, prefix: str) -> None:
        for f in struct.fields:
            path = prefix + f.name
            names.append(path)
            if isinstance(f.dataType, T.StructType):
                visit(f.dataType, path + ".")
            elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                visit(f.dataType.elementType, path + "[].")

    visit(schema, "")
    return names


def snapshot(spark: SparkSession, schemas) -> DataFrame:
    """Snapshots of ``(dataset_name, partition_date, StructType)`` triples.

    Schemas are driver-side metadata; their size does not depend on row counts.
    """
    rows = [(name, day, s.json(), flatten(s), field_names(s)) for name, day, s in schemas]
    return with_hash(
        spark.createDataFrame(
            rows,
            "dataset_name string, partition_date date, schema_json string, "
            "fields map<string,string>, names array<string>",
        )
    )


def snapshot_of(df: DataFrame, partitions: DataFrame) -> DataFrame:
    """Every partition with the schema of ``df`` without its keys."""
    own = T.StructType([f for f in df.schema.fields if f.name not in c.KEYS])
    pairs = [F.lit(x) for pair in flatten(own).items() for x in pair]
    return with_hash(
        partitions.select(
            *c.KEYS,
            F.lit(own.json()).alias("schema_json"),
            F.create_map(*pairs).alias("fields"),
            F.array(*map(F.lit, field_names(own))).alias("names"),
        )
    )


def with_hash(headers: DataFrame) -> DataFrame:
    return headers.withColumn(
        "schema_hash", F.concat(F.lit(HASH_PREFIX), F.sha2("schema_json", 256))
    )


def previous_snapshot(snapshots: DataFrame) -> DataFrame:
    """Each snapshot next to the dataset's previous one."""
    w = Window.partitionBy("dataset_name").orderBy("partition_date")
    carried = {"partition_date": "date", "schema_hash": "hash", "schema_json": "json"}
    carried |= {x: x for x in ("fields", "names") if x in snapshots.columns}
    return snapshots.withColumns(
        {f"baseline_{new}": F.lag(old).over(w) for old, new in carried.items()}
    )


def _blank(column: str) -> Column:
    return F.coalesce(F.length(F.trim(column)) == 0, F.lit(True))


def _with_changes(snapshots: DataFrame) -> DataFrame:
    """Sorted arrays ``added``, ``removed`` and ``changed`` against the previous snapshot."""
    paired = previous_snapshot(snapshots)
    now, then = F.map_keys("fields"), F.map_keys("baseline_fields")
    differs = lambda k: F.element_at("fields", k) != F.element_at("baseline_fields", k)
    return paired.withColumns(
        {
            "added": F.array_sort(F.array_except(now, then)),
            "removed": F.array_sort(F.array_except(then, now)),
            "changed": F.array_sort(F.filter(F.array_intersect(now, then), differs)),
        }
    )


def field_drift(snapshots: DataFrame) -> DataFrame:
    """One row per added, removed or changed field with its descriptors."""
    def labelled(kind: str) -> Column:
        return F.transform(kind, lambda p: F.struct(p.alias("field_path"), F.lit(kind).alias("change")))

    changes = F.flatten(F.array(labelled("added"), labelled("removed"), labelled("changed")))
    return _with_changes(snapshots).select(
        *c.KEYS, "fields", "baseline_fields", F.inline(changes)
    ).select(
        *c.KEYS, "field_path",
        F.try_element_at("baseline_fields", "field_path").alias("before"),
        F.try_element_at("fields", "field_path").alias("after"),
        "change",
    )


def schema_status(snapshots: DataFrame) -> DataFrame:
    """Drift verdict per snapshot with counts and the sorted field names."""
    no_baseline = _blank("baseline_hash")
    same = F.col("schema_hash") == F.col("baseline_hash")
    empty = F.array().cast("array<string>")
    judged = _with_changes(snapshots).withColumns(
        {
            kind: F.when(no_baseline | same, empty)
            # a baseline known by its hash alone counts as one change of the whole schema
            .when(_blank("baseline_json"), F.array(F.lit("$schema")) if kind == "changed" else empty)
            .otherwise(F.col(kind))
            for kind in ("added", "removed", "changed")
        }
    )
    count = lambda kind: F.size(kind).cast("bigint")
    broken = (F.size("removed") > 0) | (F.size("changed") > 0)
    additive = F.size("added") > 0
    return judged.select(
        *c.KEYS,
        "schema_hash",
        "baseline_hash",
        *(count(k).alias(f"{k}_count") for k in ("added", "removed", "changed")),
        *(F.array_join(k, ",").alias(f"{k}_fields") for k in ("added", "removed", "changed")),
        F.when(broken, c.FAIL).when(additive, c.WARN).otherwise(c.PASS).alias("status"),
        F.when(no_baseline, "baseline_unavailable")
        .when(broken, "schema_breaking_change")
        .when(additive, "schema_additive_change")
        .otherwise("no_schema_drift")
        .alias("reason"),
    )


def breaking_change(snapshots: DataFrame) -> DataFrame:
    """Names that disappeared since the previous snapshot; type changes do not count."""
    all_paths = F.map_keys("fields")
    known = F.coalesce("names", all_paths) if "names" in snapshots.columns else all_paths
    snapshots = snapshots.withColumn("names", known)
    paired = previous_snapshot(snapshots)
    # a baseline that is no schema document cannot be compared
    usable = F.coalesce(F.get_json_object("baseline_json", "$.type") == "struct", F.lit(False))
    lost = F.when(usable, F.array_sort(F.array_except("baseline_names", "names"))).otherwise(
        F.array().cast("array<string>")
    )
    failed = F.size("removed") > 0
    return paired.withColumns({"removed": lost, "usable": usable}).select(
        *c.KEYS,
        F.when(failed, c.FAIL).otherwise(c.PASS).alias("status"),
        F.when(~F.col("usable"), "baseline_unavailable")
        .when(failed, "breaking_changes_detected")
        .otherwise("no_breaking_changes")
        .alias("reason"),
        F.size("removed").cast("bigint").alias("removed_count"),
        F.array_join("removed", ",").alias("removed_fields"),
    )
