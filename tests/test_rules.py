"""Golden cases of the rules and of routing."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.config import RuleConfig
from riskloom.operators import routing, rules

COLUMNS = {
    "transaction_id": "string", "user_id": "string", "amount": "double", "card_limit": "double", "card_number_hash": "string", "device_id": "string", "email": "string", "email_domain": "string",
    "billing_country": "string", "ip_country": "string", "country_code": "string", "is_tor": "string", "tor_exit_node": "string", "transactions_last_minute": "bigint", "transactions_last_hour": "bigint",
    "failed_attempts_last_hour": "bigint", "account_age_hours": "double", "is_first_transaction": "boolean", "transaction_hour": "int", "transaction_lat": "double", "transaction_lon": "double",
    "last_transaction_lat": "double", "last_transaction_lon": "double", "transaction_time": "timestamp", "last_transaction_time": "timestamp",
}
BASE = {"user_id": "USER-001", "amount": 50.0, "device_id": "device_clean_001", "email_domain": "gmail.com", "country_code": "US", "is_tor": "0", "card_number_hash": "clean_card_hash"}
NOON = dt.datetime(2026, 4, 22, 14, 0)
FLY = {"last_transaction_lat": 40.71, "last_transaction_lon": -74.0, "transaction_lat": 51.5, "transaction_lon": -0.12, "last_transaction_time": NOON, "transaction_time": NOON + dt.timedelta(minutes=5)}
BURST = {"transactions_last_hour": 6, "transactions_last_minute": 3, "amount": 100.0}
CASES = [
    ({"is_tor": "1"}, "DECLINE", "check_tor"),
    ({"is_tor": "0", "tor_exit_node": "true"}, "DECLINE", "check_tor"),
    ({"country_code": "KP"}, "DECLINE", "check_sanctioned_country"),
    ({"country_code": "IR"}, "DECLINE", "check_sanctioned_country"),
    ({"billing_country": "", "country_code": "KP"}, "DECLINE", "check_sanctioned_country"),
    ({"billing_country": "unknown", "country_code": "KP"}, "PASS_TO_ML", ""),
    ({"email_domain": "tempmail.com"}, "DECLINE", "check_email_domain"),
    ({"email": "x@tempmail.com@y.org"}, "DECLINE", "check_email_domain"),
    ({"device_id": "device_fraud_001"}, "DECLINE", "check_fraud_device"),
    ({"card_number_hash": "4532123456789012"}, "DECLINE", "check_stolen_card"),
    ({"amount": 1.99}, "APPROVE", "check_micro_transaction"),
    ({}, "PASS_TO_ML", ""),
    ({"amount": 999999.0}, "DECLINE", "check_amount_exceeds_limit"),
    ({"transactions_last_hour": 6}, "PASS_TO_ML", "check_velocity_limits"),
    ({"transactions_last_hour": 5}, "PASS_TO_ML", ""),
    (BURST, "DECLINE", "check_velocity_limits,check_card_testing_pattern"),
    ({**BURST, "user_id": "user_vip_001"}, "APPROVE", "check_velocity_limits,check_card_testing_pattern,check_vip_user"),
    ({"account_age_hours": 1.0, "amount": 500.0}, "PASS_TO_ML", ""),
    ({"account_age_hours": 1.0, "amount": 500.01}, "PASS_TO_ML", "check_new_account_risk"),
    ({"is_first_transaction": True, "amount": 1500.0}, "PASS_TO_ML", "check_new_account_risk"),
    ({"transaction_hour": 6, "amount": 1500.0}, "PASS_TO_ML", "check_behavioral_anomalies"),
    (FLY, "PASS_TO_ML", "check_impossible_travel"),
]


def frame(spark, rows):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
    text = [tuple(None if r.get(c) is None else str(r[c]) for c in COLUMNS) for r in rows]
    return spark.createDataFrame(text, schema).select(*(F.col(c).cast(k).alias(c) for c, k in COLUMNS.items()))


def test_golden_cases(spark):
    rows = [{**BASE, **over, "transaction_id": str(k)} for k, (over, _, _) in enumerate(CASES)] + [{"transaction_id": "null"}]
    got = {r.transaction_id: (r.rules_decision, r.names) for r in rules.evaluate_rules(frame(spark, rows)).select("transaction_id", "rules_decision", rules.rule_names().alias("names")).collect()}
    for k, (_, decision, names) in enumerate(CASES):
        assert got[str(k)] == (decision, names), CASES[k]
    assert got["null"] == ("APPROVE", "check_micro_transaction")


def test_rules_can_be_disabled(spark):
    row = frame(spark, [{**BASE, "is_tor": "1"}])
    assert rules.evaluate_rules(row, RuleConfig(disabled=("check_tor",))).first().rules_decision == "PASS_TO_ML"


@pytest.mark.parametrize(
    "score, rule, want",
    [
        (0.95, "PASS_TO_ML", ("FRAUD", "DECLINE", "xgboost_high")),
        (0.85, "PASS_TO_ML", ("FRAUD", "DECLINE", "xgboost_high")),
        (0.19, "PASS_TO_ML", ("LEGIT", "APPROVE", "xgboost_low")),
        (0.20, "PASS_TO_ML", ("LEGIT", "APPROVE", "full_pipeline")),
        (0.49, "PASS_TO_ML", ("LEGIT", "APPROVE", "full_pipeline")),
        (0.50, "PASS_TO_ML", ("UNCERTAIN", "ESCALATE_TO_HITL", "full_pipeline")),
        (0.84, "PASS_TO_ML", ("UNCERTAIN", "ESCALATE_TO_HITL", "full_pipeline")),
        (0.10, "DECLINE", ("FRAUD", "DECLINE", "rules_decline")),
        (0.90, "APPROVE", ("LEGIT", "APPROVE", "rules_approve")),
    ],
)
def test_routes(spark, score, rule, want):
    row = spark.createDataFrame([("t", rule, score, 0.5)], "transaction_id string, rules_decision string, model_score double, confidence double")
    r = routing.route(row).first()
    assert (r.final_decision, r.recommended_action, r.layer_stopped_at) == want


def test_outcomes_override_the_grey_zone_only(spark):
    rows = spark.createDataFrame([("a", "PASS_TO_ML", 0.6, 0.5), ("b", "PASS_TO_ML", 0.9, 0.5)], "transaction_id string, rules_decision string, model_score double, confidence double")
    done = spark.createDataFrame([("a", "FRAUD", "DECLINE", 0.8), ("b", "LEGIT", "APPROVE", 0.8)], "transaction_id string, review_decision string, review_action string, review_confidence double")
    got = {r.transaction_id: (r.final_decision, r.confidence) for r in routing.route(rows, outcomes=done).collect()}
    assert got == {"a": ("FRAUD", 0.8), "b": ("FRAUD", 0.5)}
