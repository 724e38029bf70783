"""Rule semantics: NULL, operators, priority, thresholds, rendering."""

import json

import pytest

from docguard.fixed_values import DEFAULT_RULES
from docguard.operators import rules as R


def decide(spark, rows, schema, **options):
    return R.evaluate_rules(spark.createDataFrame(rows, schema), **options)


def test_logged_decisions(spark):
    schema = "risk_score double, malicious_probability double, vision_score double, hidden_text_score double"
    rows = [(0.935409810774798, 0.8775106764780151, 0.769183463409607, 0.0), (0.188, 0.2, 0.3, 1.0), (0.15234820614661418, 0.5, 0.0, 0.0)]
    got = decide(spark, rows, schema).collect()
    assert [r["rule_id"] for r in got] == ["G1", "G2", None]
    assert [r["decision"] for r in got] == ["BLOCK", "BLOCK", "ALLOW"]
    assert got[0]["reason"].startswith("BLOCKED by rule G1 (Critical Risk Unconditional Block). Risk score 0.935 exceeds")
    assert "(≥0.80)" in got[0]["reason"]


def test_null_and_nan_never_fire(spark):
    got = decide(spark, [(None,), (float("nan"),), (0.8,)], "risk_score double").collect()
    assert [r["rule_id"] for r in got] == [None, None, "G1"]


def one(condition, compat=False):
    rule = {**DEFAULT_RULES[0], "condition": condition}
    return {"rules": [rule], "compat": compat}


def test_only_compat_stops_at_the_first_operator(spark):
    condition = {"risk_score": {"gte": 0.5, "lt": 0.6}}
    assert decide(spark, [(0.9,)], "risk_score double", **one(condition)).first()["rule_id"] is None
    assert decide(spark, [(0.9,)], "risk_score double", **one(condition, True)).first()["rule_id"] == "G1"


def test_unknown_operator(spark):
    condition = {"risk_score": {"near": 0.5}}
    assert decide(spark, [(0.9,)], "risk_score double", **one(condition, True)).first()["rule_id"] == "G1"
    with pytest.raises(ValueError, match="unknown operator"):
        decide(spark, [(0.9,)], "risk_score double", **one(condition))


def test_flags_numbers_and_texts(spark):
    row, schema = [(0.5, " Fraud ", None)], "risk_score double, attack_family string, hidden_text_detected boolean"
    assert decide(spark, row, schema, **one({"risk_score": 0.5})).first()["rule_id"] == "G1"
    assert decide(spark, row, schema, **one({"attack_family": {"eq": "fraud"}})).first()["rule_id"] == "G1"
    assert decide(spark, row, schema, **one({"hidden_text_detected": False})).first()["rule_id"] == "G1"
    assert decide(spark, row, schema, **one({"hidden_text_detected": True})).first()["rule_id"] is None
    assert decide(spark, row, schema, **one({"no_such_field": True})).first()["rule_id"] is None
    with pytest.raises(ValueError, match="cannot compare"):
        decide(spark, row, schema, **one({"attack_family": {"gte": 1}}))


def test_decision_is_the_first_hit(spark):
    from checks.inputs import signals
    sig = signals(spark, "/root/testdata/sf0.001")
    hits = R.rule_hits(sig)
    first = hits.groupBy("sample_id").agg({"priority": "min"}).withColumnRenamed("min(priority)", "p")
    decided = R.evaluate_rules(sig).selectExpr("sample_id", "int(substring(rule_id, 2)) AS rule")
    joined = decided.join(first, "sample_id", "left")
    assert joined.filter("NOT (rule <=> p)").count() == 0
    assert joined.count() == sig.count()


def test_filter_on_a_decision_compiles(spark):
    from checks.inputs import signals
    decided = R.evaluate_rules(signals(spark, "/root/testdata/sf0.001"))
    assert decided.filter("decision = 'BLOCK' AND rule_id IS NOT NULL").count() == decided.filter("decision = 'BLOCK'").count()


def test_rules_from_json(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps({"rules": list(reversed(DEFAULT_RULES))}, ensure_ascii=False), encoding="utf-8")
    loaded = R.load_rules(str(path))
    assert loaded == R.load_rules()
    assert [r["id"] for r in R.rules_df(spark, loaded).collect()] == [f"G{i}" for i in range(1, 11)]
    assert R.rule_conditions(spark, loaded).count() == sum(
        len(c) if isinstance(c, dict) else 1 for r in loaded for c in r["condition"].values())


def test_threshold_is_replaced_in_a_copy():
    rules = R.load_rules()
    changed = R.with_threshold(rules, "G1", "risk_score", 0.6)
    assert changed[0]["condition"]["risk_score"]["gte"] == 0.6
    assert rules[0]["condition"]["risk_score"]["gte"] == 0.80
