import pytest

from plumbline.operators import score

CASES = [
    # statuses (freshness, volume, schema, ops) -> score, status, reason
    (("PASS", "WARN", "FAIL", "PASS"), 65.0, "WARN", "composite_computed"),
    (("PASS", None, "PASS", "NOT_RUN"), 100.0, "PASS", "partial_checks"),
    (("PASS", "FAIL", "PASS", "PASS"), 70.0, "WARN", "composite_computed"),
    (("FAIL", "FAIL", "FAIL", "FAIL"), 0.0, "FAIL", "composite_computed"),
    ((None, "NOT_RUN", None, None), None, "NOT_RUN", "all_checks_unavailable"),
]
CHECKS = ("FRESHNESS", "VOLUME", "SCHEMA", "OPS")


def rows(cases):
    return [(i, k, s) for i, case in enumerate(cases) for k, s in zip(CHECKS, case) if s is not None]


def test_scores(spark):
    df = spark.createDataFrame(rows([c[0] for c in CASES]), "run_id bigint, check_type string, status string")
    got = {r.run_id: r for r in score.dq_score(df).collect()}
    for i, (_, value, status, reason) in enumerate(CASES):
        assert got[i].composite_score == (None if value is None else pytest.approx(value))
        assert (got[i].status, got[i].reason) == (status, reason)
    assert got[1].unavailable_checks == "VOLUME,OPS"


def test_custom_weights(spark):
    df = spark.createDataFrame(rows([("PASS", "FAIL", None, None)] * 4), "run_id bigint, check_type string, status string")
    weights = spark.createDataFrame(
        [(0, {"FRESHNESS": 0.9, "VOLUME": 0.1}), (1, {"OPS": 1.0}), (2, {"FRESHNESS": -1.0, "VOLUME": 2.0})],
        "run_id bigint, weights map<string,double>",
    )
    got = {r.run_id: r.composite_score for r in score.dq_score(df, weights).collect()}
    assert got[0] == pytest.approx(90.0)
    assert got[1] == pytest.approx(50.0)      # no weight for an available check: equal shares
    assert got[2] == pytest.approx(0.0)       # clamped
    assert got[3] == pytest.approx(50.0)      # no row: default weights


def test_breakdown_sums_to_the_score(spark):
    df = spark.createDataFrame(rows([CASES[0][0]]), "run_id bigint, check_type string, status string")
    parts = score.breakdown(df).collect()
    assert sum(p.contribution for p in parts) == pytest.approx(65.0)
    assert sum(p.normalized_weight for p in parts) == pytest.approx(1.0)


def test_status_from_bad_json(spark):
    df = spark.createDataFrame(
        [(1, "VOLUME", "volume_status", "oops"), (1, "OPS", "ops_status", '{"status": "PASS"}'),
         (1, "OPS", "ops_anomalies", '{"status": "FAIL"}')],
        "run_id bigint, check_type string, detail_type string, detail_value string",
    )
    got = score.dq_score(score.statuses_from_details(df)).first()
    assert (got.composite_score, got.unavailable_checks) == (100.0, "FRESHNESS,VOLUME,SCHEMA")


def test_run_status(spark):
    runs = spark.createDataFrame([(1,), (2,)], "run_id bigint")
    details = spark.createDataFrame(
        [(7, 1, "DQS_SCORE", "dqs_score_breakdown", '{"status": "WARN"}')],
        "detail_id bigint, run_id bigint, check_type string, detail_type string, detail_value string",
    )
    numerics = spark.createDataFrame(
        [(7, 1, "DQS_SCORE", "composite_score", 64.996)],
        "metric_id bigint, run_id bigint, check_type string, metric_name string, metric_value double",
    )
    got = {r.run_id: (r.check_status, r.dqs_score) for r in score.run_status(runs, details, numerics).collect()}
    assert got[1][0] == "WARN" and float(got[1][1]) == 65.0
    assert got[2] == ("UNKNOWN", None)
