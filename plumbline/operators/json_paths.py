"""Numeric leaves of JSON text columns, their paths and statistics.

A text is parsed once to a variant and opened level by level: each level is one
``variant_explode_outer`` in the same scan, so a value becomes a row with its key path.
Rows are aggregated by (keys, path) with partial aggregation before the shuffle; which
paths are numeric follows from the few aggregated rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import constants as c
from plumbline.functions.columns import named
from plumbline.operators import quantiles
from plumbline.session import scratch_folder, staged

OFF, TOP_LEVEL, ALL = 0, 1, 2
#: Levels opened at first; texts that nest deeper are read again with twice as many.
FIRST_DEPTH = 4
_NUMERIC = ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL")
_STATS = ("mean", "stddev", "p50", "p95")


def _opened(df: DataFrame, columns: Sequence[str], levels: DataFrame | None, keys: Sequence[str], depth: int) -> DataFrame:
    """(keys, level, column, path, node): one row per value that is not opened further.

    A row whose text is no JSON gives a NULL node, so every key stays known.
    """
    texts = F.array(*(F.struct(F.lit(x).alias("column"), named(x).cast("string").alias("_text")) for x in columns))
    rows = df.select(*keys, F.lit(ALL).alias("_level"), texts.alias("_texts"))
    if levels is not None:
        own = levels.select("dataset_name", effective_level(F.col("explosion_level")).alias("_level"))
        rows = rows.drop("_level").join(own, "dataset_name")
    rows = rows.filter(F.col("_level") != OFF).select(*keys, "_level", F.inline("_texts"))
    rows = rows.select(*keys, "_level", "column", F.array().cast("array<string>").alias("path"), F.try_parse_json("_text").alias("node"))
    for nth in range(depth):
        opens = F.col("node") if nth == 0 else F.when(F.col("_level") == ALL, F.col("node"))
        within = df.sparkSession.tvf.variant_explode_outer(F.col("_open").outer())
        rows = rows.withColumn("_open", opens).lateralJoin(within)
        # array elements have no key: one row stands for the array, which is not entered
        inside = F.col("key").isNotNull()
        rows = rows.filter(F.col("pos").isNull() | inside | (F.col("pos") == 0)).select(
            *keys, "_level", "column",
            F.when(inside, F.concat("path", F.array("key"))).otherwise(F.col("path")).alias("path"),
            F.when(inside, F.col("value")).otherwise(F.col("node")).alias("node"),
        )
    return rows


def _counted(df: DataFrame, columns: Sequence[str], levels: DataFrame | None, keys: Sequence[str] = c.KEYS) -> DataFrame:
    """(keys, column, path, numeric, other, statistics), written once for its several readers."""
    kind = F.schema_of_variant("node")
    numeric = F.coalesce(F.startswith(kind, F.lit(_NUMERIC[0])), F.lit(False))
    for name in _NUMERIC[1:]:
        numeric = numeric | F.coalesce(F.startswith(kind, F.lit(name)), F.lit(False))
    unopened = (F.col("_level") == ALL) & F.startswith(kind, F.lit("OBJECT<")) & (kind != "OBJECT<>")
    depth = FIRST_DEPTH
    while True:
        rows = _opened(df, columns, levels, keys, depth).select(
            *keys, "column", "path", kind.alias("kind"), F.when(numeric, F.col("node").try_cast("double")).alias("number"),
            F.coalesce(unopened, F.lit(False)).alias("unopened"),
        )
        value = F.col("number")
        sums = [
            F.count(value).alias("numeric"),
            F.count_if(value.isNull() & F.col("kind").isNotNull() & (F.col("kind") != "VOID")).alias("other"),
            F.max("unopened").alias("unopened"),
            F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"),
            quantiles.sketch(value).alias("pct"),
        ]
        found = staged(rows.groupBy(*keys, "column", "path").agg(*sums), scratch_folder(df.sparkSession))
        if not found.agg(F.max("unopened")).first()[0]:
            break
        depth *= 2
    by = [*keys, "column", "path"]
    found = found.drop("unopened")
    exact = quantiles.exact(
        rows.select(*by, F.col("number").alias("value")), found.select(*by, F.col("numeric").alias("n"), F.col("pct").alias("sketch")), by)
    if exact is None:
        return found
    joined = found.alias("f").join(exact.alias("e"), quantiles.same("f", "e", by), "left")
    return joined.select("f.*", "exact").withColumn("pct", F.coalesce("exact", "pct")).drop("exact")


def _numeric_only(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, column, path) of the paths whose non-null values are all numbers.

    A path that is an object in some row has no values of its own and can't be one; nor can a
    path below one that holds anything but objects and nulls.
    """
    by = [*keys, "column"]
    # each path counts for itself and, as an inner node, for every path above it
    nodes = found.select(*by, "path", "numeric", "other", F.explode(F.sequence(F.lit(0), F.size("path"))).alias("_n"))
    own = F.col("_n") == F.size("path")
    facts = nodes.groupBy(*by, F.slice("path", 1, F.col("_n")).alias("path")).agg(
        F.sum(F.when(own, F.col("numeric")).otherwise(0)).alias("numeric"),
        F.sum(F.when(own, F.col("other")).otherwise(0)).alias("other"), F.max(~own).alias("inner"),
    )
    facts = staged(facts, scratch_folder(found.sparkSession))
    alone = facts.filter(~F.col("inner") & (F.col("numeric") > 0) & (F.col("other") == 0) & (F.size("path") > 0)).select(*by, "path")
    mixed = facts.filter(F.col("inner") & (F.col("numeric") + F.col("other") > 0)).select(*by, F.col("path").alias("_above"))
    if mixed.isEmpty():
        return alone
    above = F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda i: F.slice("path", 1, i))
    below = alone.withColumn("_above", F.explode(above)).join(mixed, [*by, "_above"], "left_semi").select(*by, "path").distinct()
    return alone.join(below, [*by, "path"], "left_anti")


def _column_path() -> Column:
    return F.concat_ws(".", "column", "path").alias("column_path")


#: Parts of a variant type string: a key with its colon, an opening, a closing, or a type.
_TOKEN = r"`(?:[^`]|``)*`: |[^`<>,:( ]+: |OBJECT<|ARRAY<|>|[A-Z_]+(?:\([0-9, ]*\))?"


def _shape_leaves(shape: str) -> Column:
    """Key paths of the numeric leaves of a variant type string, by a fold over its parts.

    ``OBJECT<a: BIGINT, b: OBJECT<c: DOUBLE, d: ARRAY<BIGINT>>>`` gives ``[["a"], ["b", "c"]]``;
    arrays are not entered.
    """
    numeric = " OR ".join(f"startswith(t, '{x}')" for x in _NUMERIC)
    key = "regexp_replace(regexp_replace(t, ': $', ''), '^`|`$', '')"
    token = _TOKEN.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"""aggregate(
        regexp_extract_all({shape}, '{token}', 0),
        named_struct('open', '', 'path', cast(array() AS array<string>), 'found', cast(array() AS array<array<string>>)),
        (acc, t) -> CASE
            WHEN t = 'OBJECT<' THEN named_struct('open', acc.open || 'O', 'path', acc.path, 'found', acc.found)
            WHEN t = 'ARRAY<' THEN named_struct('open', acc.open || 'A', 'path', acc.path, 'found', acc.found)
            WHEN t = '>' THEN named_struct('open', left(acc.open, length(acc.open) - 1), 'path', acc.path, 'found', acc.found)
            WHEN contains(acc.open, 'A') THEN acc
            WHEN endswith(t, ': ') THEN named_struct('open', acc.open,
                'path', concat(slice(acc.path, 1, length(acc.open) - 1), array(replace({key}, '``', '`'))), 'found', acc.found)
            WHEN length(acc.open) > 0 AND ({numeric}) THEN named_struct('open', acc.open, 'path', acc.path,
                'found', concat(acc.found, array(acc.path)))
            ELSE acc END,
        acc -> acc.found)""")


def numeric_paths(
    df: DataFrame, column: str | Sequence[str], level: int = ALL, keys: Sequence[str] = ("dataset_name",)
) -> DataFrame:
    """(keys, column_path, key_path) of every numeric JSON leaf of one or several columns.

    TOP_LEVEL keeps first-level keys only, ALL follows nested objects, OFF gives
    nothing.  A path is numeric when all its non-null values are.  The shape of all rows is
    merged with partial aggregation; one type string per group remains.
    """
    columns = [column] if isinstance(column, str) else list(column)
    shapes = df.groupBy(*keys).agg(*(
        F.schema_of_variant_agg(F.try_parse_json(named(x))).alias(f"_shape_{k}") for k, x in enumerate(columns)
    ))
    listed = F.array(*(F.struct(F.lit(x).alias("column"), F.col(f"_shape_{k}").alias("shape")) for k, x in enumerate(columns)))
    paths = shapes.select(*keys, F.inline(listed)).select(*keys, "column", F.explode(_shape_leaves("shape")).alias("path"))
    if level == OFF:
        paths = paths.limit(0)
    elif level == TOP_LEVEL:
        paths = paths.filter(F.size("path") == 1)
    return paths.select(*keys, _column_path(), F.col("path").alias("key_path"))


def leaf_value(column: str, key_path: Sequence[str]) -> Column:
    """The leaf as DOUBLE; NULL where the text, the path or the number is bad."""
    path = "$" + "".join("['" + k.replace("'", "\\'") + "']" for k in key_path)
    return F.try_variant_get(F.try_parse_json(named(column)), path, "double")


def leaf_sources(column: str, paths: Sequence[Sequence[str]]) -> list[tuple[str, Column]]:
    """(path, expression) pairs for :func:`plumbline.operators.profile.column_stats`."""
    return [(".".join([column, *p]), leaf_value(column, p)) for p in paths]


def leaf_stats(df: DataFrame, columns: Sequence[str], levels: DataFrame | None = None) -> DataFrame:
    """Statistics per (dataset, date) of the JSON leaves that are numeric in that dataset.

    ``levels``: (dataset_name, explosion_level) by dataset, all leaves without.  A path
    that is numeric in one dataset and text or absent in another gives rows for the
    first only; a date on which it has no value gives a row with a count of 0.
    """
    found = _counted(df, columns, levels)
    paths = _numeric_only(found, ["dataset_name"])
    grid = found.select(*c.KEYS).distinct().join(paths, "dataset_name")
    return grid.join(found, [*c.KEYS, "column", "path"], "left").select(
        *c.KEYS, _column_path(), *(F.coalesce(x, F.lit(0.0)).alias(x) for x in ("mean", "stddev")),
        *(F.coalesce(F.get("pct", F.lit(nth)), F.lit(0.0)).alias(x) for nth, x in enumerate(("p50", "p95"))),
        F.coalesce("numeric", F.lit(0).cast("bigint")).alias("sample_count"),
    )


def leaf_metrics(stats: DataFrame) -> DataFrame:
    """The statistics as long metric rows, named like those of plain columns."""
    named_values = [
        F.struct(F.concat("column_path", F.lit(f".{name}")).alias("metric_name"), F.col(source).cast("double").alias("metric_value"))
        for name, source in (*((x, x) for x in _STATS), ("count", "sample_count"))
    ]
    return stats.select(*c.KEYS, F.lit(c.DISTRIBUTION).alias("check_type"), F.inline(F.array(*named_values)))


def effective_level(level: Column) -> Column:
    """Unknown or missing explosion levels count as OFF."""
    return F.when(level.isin(OFF, TOP_LEVEL, ALL), level).otherwise(OFF)
