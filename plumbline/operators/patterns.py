"""Joining dataset names to LIKE patterns of configuration tables.

A LIKE join has no equality, so Spark would compare every name with every
pattern.  The functions here derive equality keys first and keep LIKE as the
residual test.  Wildcards divide a pattern into literal runs (escaped characters
are literal); each pattern is filed under its longest run:

* ``^run`` if the pattern starts with it: names have the key of each of their beginnings;
* ``$run`` if it ends with it: names have the key of each of their ends;
* ``~run`` if it stands inside: names have the keys of their substrings.

A name only gets keys of the lengths that patterns have.  Each matching pair has
its pattern's one key, so nothing is lost or doubled, and no key is shared by all
names.  Both sides are equality-joined; Spark broadcasts the pattern side only when its
size is under the configured threshold and shuffles otherwise.  Patterns without any
literal, like ``%``, match by length alone: they travel to the names as one small array
(a table has few of them that differ), without a join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline import constants as c
from plumbline.operators.json_paths import effective_level

#: Stand-ins for escaped wildcards while a pattern is divided: code points no text may hold.
_PERCENT, _LINE, _SLASH = "\ufdd0", "\ufdd1", "\ufdd2"


def _anchored(patterns: DataFrame, pattern: str) -> DataFrame:
    """The patterns with ``_key``, NULL for those without a literal."""
    p = f"`{pattern}`"
    # a stand-in inside a pattern itself would be taken for a wildcard: cut the run there
    plain = f"regexp_replace({p}, '[{_PERCENT}{_LINE}{_SLASH}]', '_')"
    hidden = (f"replace(replace(replace({plain}, '\\\\\\\\', '{_SLASH}'), '\\\\%', '{_PERCENT}'), '\\\\_', '{_LINE}')")
    shown = f"replace(replace(replace(_run, '{_PERCENT}', '%'), '{_LINE}', '_'), '{_SLASH}', '\\\\')"
    runs = patterns.withColumn("_runs", F.split(F.expr(hidden), "[%_]"))
    # the longest run; of equal ones a beginning or an end serves better than an inner one
    listed = F.expr(
        "transform(_runs, (r, i) -> struct(length(r) AS size, i = 0 OR i = size(_runs) - 1 AS edge,"
        " IF(i = 0, '^', IF(i = size(_runs) - 1, '$', '~')) AS kind, r AS run))"
    )
    best = runs.withColumn("_best", F.array_max(listed)).withColumn("_run", F.col("_best.run"))
    key = F.when(F.col("_best.size") > 0, F.concat(F.col("_best.kind"), F.expr(shown)))
    return best.withColumn("_key", key).drop("_runs", "_best", "_run")


def _keyed_names(names: DataFrame, name: str, anchored: DataFrame, *others: str, outer: bool = False) -> DataFrame:
    """(name, others, _key): the keys a name can be found under, of the lengths that patterns have."""
    sizes = [
        F.expr(f"collect_set(length(_key) - 1) FILTER (WHERE startswith(_key, '{kind}'))").alias(alias)
        for kind, alias in (("^", "b"), ("$", "e"), ("~", "m"))
    ]
    lengths = anchored.agg(*sizes).select(F.struct("b", "e", "m")).scalar()
    q = f"`{name}`"
    fit = lambda x: f"filter(_l.{x}, k -> k <= length({q}))"
    keys = (
        f"concat(transform({fit('b')}, k -> concat('^', left({q}, k))), transform({fit('e')}, k -> concat('$', right({q}, k))),"
        f" flatten(transform({fit('m')}, k -> array_distinct(transform(sequence(1, length({q}) - k + 1), i -> concat('~', substr({q}, i, k)))))))"
    )
    explode = F.explode_outer if outer else F.explode
    return names.withColumn("_l", lengths).select(name, *others, explode(F.expr(keys)).alias("_key"))


def _distinct_names(names: DataFrame, name: str) -> DataFrame:
    return names.select(name).filter(F.col(name).isNotNull()).distinct()


def match(names: DataFrame, name: str, patterns: DataFrame,
          pattern: str = "dataset_pattern") -> DataFrame:
    """Distinct names with the columns of every pattern row they match."""
    distinct, anchored = _distinct_names(names, name), _anchored(patterns, pattern)
    columns = [F.col(f"`{x}`") for x in patterns.columns]
    like = F.like(F.col(name), F.col(pattern))
    keyed = _keyed_names(distinct, name, anchored).join(anchored.filter(F.col("_key").isNotNull()), "_key").filter(like).select(name, *columns)
    free = anchored.filter(F.col("_key").isNull() & F.col(pattern).isNotNull()).agg(F.collect_list(F.struct(*columns)).alias("_free")).scalar()
    loose = distinct.withColumn("_free", free).select(name, F.inline("_free")).filter(like)
    return keyed.unionByName(loose.select(name, *columns))


def lookup(names: DataFrame, name: str, patterns: DataFrame, value: str,
           pattern: str = "dataset_pattern") -> DataFrame:
    """Every distinct name with the value of its matching row of lowest id, else NULL.

    The left join keeps names without a match, so nothing is joined back; names,
    keys and the final grouping share one partitioning by name.
    """
    rows = patterns.select(
        F.col("id").alias("_id"), F.col(pattern).alias("_pattern"), F.col(value).alias("_value")
    )
    anchored = _anchored(rows, "_pattern")
    free = anchored.filter("_key IS NULL AND _pattern IS NOT NULL").agg(F.collect_list(F.struct("_id", "_value", "_pattern")).alias("_free")).scalar()
    fitting = F.filter("_free", lambda p: F.like(F.col(name), p["_pattern"]))
    loose = F.array_min(F.transform(fitting, lambda p: F.struct(p["_id"].alias("_id"), p["_value"].alias("_value"))))
    distinct = _distinct_names(names, name).withColumn("_free", free).select(name, loose.alias("_loose"))
    keyed = _keyed_names(distinct, name, anchored, "_loose", outer=True)
    hit = F.when(F.like(F.col(name), F.col("_pattern")), F.struct("_id", "_value"))
    best = keyed.join(anchored.filter("_key IS NOT NULL"), "_key", "left").groupBy(name).agg(F.min(hit).alias("_hit"), F.first("_loose").alias("_loose"))
    return best.select(name, F.array_min(F.array("_hit", "_loose"))["_value"].alias(value))


# ---- configuration lookups --------------------------------------------------

def active(df: DataFrame) -> DataFrame:
    return df.filter(F.col("expiry_date") == F.lit(c.ACTIVE_EXPIRY).cast("timestamp_ntz"))


def _enabled(config: DataFrame) -> DataFrame:
    return active(config).filter("enabled")


def enabled_checks(names: DataFrame, config: DataFrame,
                   registered: Sequence[str] = c.CHECK_TYPES) -> DataFrame:
    """(dataset_name, check_type) of registered checks that some enabled row selects."""
    rows = _enabled(config).filter(F.col("check_type").isin(*registered))
    return match(names, "dataset_name", rows).select("dataset_name", "check_type").distinct()


def lookup_codes(raw_codes: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Raw source codes with their enriched lookup code, or themselves."""
    prefix = "src_sys_nm="
    named = raw_codes.select(F.concat(F.lit(prefix), "raw_code").alias("candidate"))
    rows = active(enrichment).filter(F.col("lookup_code").isNotNull())
    found = lookup(named, "candidate", rows, "lookup_code")
    raw = F.substr(F.col("candidate"), F.lit(len(prefix) + 1))
    return found.select(raw.alias("raw_code"), F.coalesce("lookup_code", raw).alias("lookup_code"))


def sla_hours(names: DataFrame, enrichment: DataFrame) -> DataFrame:
    """(dataset_name, sla_hours) for names that have one."""
    rows = active(enrichment).filter(F.col("sla_hours").isNotNull())
    return lookup(names, "dataset_name", rows, "sla_hours").filter(F.col("sla_hours").isNotNull())


def explosion_levels(names: DataFrame, config: DataFrame) -> DataFrame:
    """(dataset_name, explosion_level) for every name; OFF unless a row says more."""
    rows = _enabled(config).filter(F.col("check_type") == c.DISTRIBUTION)
    found = lookup(names, "dataset_name", rows, "explosion_level")
    return found.select(
        "dataset_name", effective_level(F.col("explosion_level")).alias("explosion_level")
    )


def score_weights(names: DataFrame, enrichment: DataFrame) -> DataFrame:
    """(dataset_name, weights MAP) for every name: its own weights or the defaults."""
    rows = active(enrichment).filter(F.col("custom_weights").isNotNull())
    found = lookup(names, "dataset_name", rows, "custom_weights")
    defaults = F.create_map(
        *(F.lit(x) for pair in c.DEFAULT_WEIGHTS.items() for x in pair)
    )
    own = F.from_json("custom_weights", "map<string,double>")
    return found.select("dataset_name", F.coalesce(own, defaults).alias("weights"))


def orphan_detection(names: DataFrame, config: DataFrame) -> DataFrame:
    """FAIL for names that no enabled pattern covers."""
    found = lookup(names, "dataset_name", _enabled(config), "check_type")
    hit = F.col("check_type").isNotNull()
    return found.select(
        "dataset_name",
        F.when(hit, c.PASS).otherwise(c.FAIL).alias("status"),
        F.when(hit, "check_config_present").otherwise("no_check_config").alias("reason"),
    )


# ---- reference data ---------------------------------------------------------

def resolve_lob(df: DataFrame, lob_lookup: DataFrame) -> DataFrame:
    """Add lob_name, owner and classification; ``N/A`` for unknown codes."""
    columns = ["lob_name", "owner", "classification"]
    found = active(lob_lookup).select("lookup_code", *columns)
    joined = df.join(found, "lookup_code", "left")
    return joined.withColumns({x: F.coalesce(x, F.lit("N/A")) for x in columns})


def classification_weighted(df: DataFrame, lob_lookup: DataFrame) -> DataFrame:
    """Priority multiplier of the dataset's classification; always PASS."""
    found = active(lob_lookup).filter(F.length(F.trim("classification")) > 0)
    joined = df.join(found.select("lookup_code", "classification"), "lookup_code", "left")
    known = F.col("classification").isNotNull()
    multiplier = F.when(known, F.lit(c.OTHER_CLASSIFICATION_MULTIPLIER))
    for label, factor in reversed(c.CLASSIFICATION_MULTIPLIERS.items()):
        multiplier = F.when(F.col("classification") == label, F.lit(factor)).otherwise(multiplier)
    return joined.withColumns(
        {
            "multiplier": multiplier,
            "status": F.lit(c.PASS),
            "reason": F.when(known, "classification_captured").otherwise("no_classification_found"),
        }
    )
