"""Contract of recommendations and actions: defined cases that the registered queries do not reach."""

import json

from pyspark.sql import functions as F

from tallyspark.functions import actions

GOOD = {
    "predicted_root_cause": "late", "confidence": 0.9, "priority": "HIGH", "recommended_action": "MANUAL_INVESTIGATION", "proposed_fields": {"b": "1", "a": "2"},
    "risk_tier": "LOW", "required_approvals": [], "citations": [], "abstain_reason": None,
}


def reasons(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    return [r["reasons"] for r in actions.parsed_recommendations(rows).orderBy("i").collect()]


def test_answers_fail_closed(spark):
    missing = {k: v for k, v in GOOD.items() if k != "risk_tier"}
    texts = [json.dumps(GOOD), None, "", "[]", "{", json.dumps(missing), json.dumps(GOOD | {"required_approvals": ["OWNER"]}), json.dumps(GOOD | {"citations": [{"document_id": "RB-001"}]})]
    found = reasons(spark, *texts)
    assert found[0] == [] and found[1] == found[2] == found[3] == found[4] == ["NOT_JSON"]
    assert found[5:] == [["RISK_TIER"], ["APPROVAL_ROLE"], ["CITATION"]]


def test_hash_ignores_key_order(spark):
    turned = dict(reversed(GOOD.items())) | {"proposed_fields": {"a": "2", "b": "1"}}
    rows = spark.createDataFrame([(json.dumps(GOOD),), (json.dumps(turned),), (json.dumps(GOOD | {"priority": "LOW"}),)], "raw string")
    a, b, c = [r[0] for r in actions.parsed_recommendations(rows).select(actions.recommendation_hash()).collect()]
    assert a == b != c


def test_source_set_has_no_order(spark):
    one = "struct('t' AS tenant_id, 'p' AS portfolio_id, 'c' AS case_id, 'x' AS trade_id, '{}' AS observation_id, '1' AS source_version, 'h' AS content_hash, 'BOOKING' AS kind, 'MOCK_LEGACY_BOOKING' AS source_system)"
    a, b = one.format("o1"), one.format("o2")
    row = spark.range(1).select(F.expr(f"array({a}, {b})").alias("x"), F.expr(f"array({b}, {a})").alias("y")).select(actions.ordered_sources("x"), actions.ordered_sources("y")).first()
    assert row[0] == row[1] and [s["observation_id"] for s in row[0]] == ["o1", "o2"]
