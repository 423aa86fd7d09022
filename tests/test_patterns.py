import re

from hypothesis import HealthCheck, given, settings, strategies as st

from plumbline.operators import patterns
from plumbline.plans import derived as d


def like(name: str, pattern: str) -> bool:
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"%": ".*", "_": "."}.get(ch, re.escape(ch))
        i += 1
    return re.fullmatch(out, name, re.S) is not None


ATOM = st.text(alphabet="ab_=/", min_size=0, max_size=6)
PATTERN = st.lists(
    st.sampled_from(["a", "b", "_", "%", "=", "/", "\\_", "\\%"]), max_size=6
).map("".join)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(names=st.lists(ATOM, min_size=1, max_size=25), pats=st.lists(PATTERN, min_size=1, max_size=25))
def test_match_equals_brute_force(spark, names, pats):
    left = spark.createDataFrame([(n,) for n in names], "dataset_name string")
    right = spark.createDataFrame(list(enumerate(pats)), "id bigint, dataset_pattern string")
    got = sorted((r.dataset_name, r.id) for r in patterns.match(left, "dataset_name", right).collect())
    want = sorted((n, i) for n in set(names) for i, p in enumerate(pats) if like(n, p))
    assert got == want
    first = patterns.lookup(left, "dataset_name", right.withColumn("v", right.id), "v").collect()
    lowest = {n: min((i for i, p in enumerate(pats) if like(n, p)), default=None) for n in set(names)}
    assert {r.dataset_name: r.v for r in first} == lowest


def test_no_nested_loop_join(spark):
    names = spark.range(10).selectExpr("concat('lob=retail/d', id) AS dataset_name")
    plan = patterns.enabled_checks(names, d.check_config(spark))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


CONFIG = "id bigint, dataset_pattern string, check_type string, enabled boolean, explosion_level int, expiry_date timestamp_ntz"


def config(spark, *rows):
    import datetime as dt

    forever, ended = dt.datetime(9999, 12, 31, 23, 59, 59), dt.datetime(2020, 1, 1)
    return spark.createDataFrame(
        [(i, p, t, on, level, ended if old else forever) for i, (p, t, on, level, old) in enumerate(rows)], CONFIG
    )


def test_enabled_checks(spark):
    names = spark.createDataFrame([("lob=retail/a",), ("lob=retail/b",)], "dataset_name string")
    table = config(
        spark,
        ("lob=retail/%", "VOLUME", True, 0, False), ("lob=retail/a", "VOLUME", False, 0, False),
        ("lob=retail/a", "OPS", True, 0, False), ("lob=retail/b", "SCHEMA", True, 0, True),
        ("%", "SOMETHING_ELSE", True, 0, False),
    )
    got = sorted(tuple(r) for r in patterns.enabled_checks(names, table).collect())
    # a disabled row does not veto the wildcard; expired and unregistered rows do not count
    assert got == [("lob=retail/a", "OPS"), ("lob=retail/a", "VOLUME"), ("lob=retail/b", "VOLUME")]


def test_explosion_level_and_orphans(spark):
    names = spark.createDataFrame([("x/1",), ("y/1",), ("z/1",)], "dataset_name string")
    table = config(
        spark,
        ("x/%", "DISTRIBUTION", True, 2, False), ("x/1", "DISTRIBUTION", True, 1, False),
        ("y/%", "DISTRIBUTION", True, 9, False), ("z/%", "DISTRIBUTION", False, 1, False),
    )
    levels = {r.dataset_name: r.explosion_level for r in patterns.explosion_levels(names, table).collect()}
    assert levels == {"x/1": 2, "y/1": 0, "z/1": 0}
    orphans = {r.dataset_name: r.status for r in patterns.orphan_detection(names, table).collect()}
    assert orphans == {"x/1": "PASS", "y/1": "PASS", "z/1": "FAIL"}


def test_no_key_is_shared_by_all_names(spark):
    """Leading wildcards are filed under their end or an inner run; '%' needs no join."""
    pats = ["%/dataset=signup", "%src_sys_nm=alpha/%", "_ob=x%", "%", "__%", "a\\_b%", "%\\%", "lob=%/long-inner-part/%z", "\\\\%", "%a\\\\b%"]
    rows = spark.createDataFrame(list(enumerate(pats)), "id bigint, dataset_pattern string")
    keys = [r._key for r in patterns._anchored(rows, "dataset_pattern").orderBy("id").collect()]
    assert keys == ["$/dataset=signup", "~nm=alpha/", "~ob=x", None, None, "^a_b", "$%", "~/long-inner-part/", "^\\", "~a\\b"]
    names = spark.range(1000).selectExpr("concat('lob=l', id % 7, '/src_sys_nm=s', id, '/dataset=d', id) AS dataset_name")
    anchored = patterns._anchored(rows, "dataset_pattern")
    shared = patterns._keyed_names(names, "dataset_name", anchored).join(anchored.filter("_key IS NOT NULL"), "_key")
    assert shared.count() == 0


def test_patterns_shuffle_without_a_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names = spark.range(50).selectExpr("concat('lob=retail/src_sys_nm=s', id, '/dataset=d') AS dataset_name")
        rows = spark.createDataFrame([(1, "%/dataset=d"), (2, "%_nm=s7/%"), (3, "%")], "id bigint, dataset_pattern string")
        hits = patterns.match(names, "dataset_name", rows)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
        assert sorted(r["count"] for r in hits.groupBy("id").count().collect()) == [1, 50, 50]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
