"""Outputs of an investigation, logged as JSON text for each case and step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp

FINDING = "risk_level string, confidence double, anomaly_score double, n_flags int, deeper boolean, fraud_type string, final_decision string, recommended_action string"
#: Required fields, allowed values, severities, prices and costs of a step.
REQUIRED = ("risk_level", "confidence", "final_decision")
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
DECISIONS = ("FRAUD", "LEGIT", "UNCERTAIN")
ACTIONS = ("APPROVE", "DECLINE", "REVIEW", "ESCALATE_TO_HITL")
SEVERITY = {
    "velocity_attack": "HIGH",
    "card_testing": "HIGH",
    "account_takeover": "CRITICAL",
    "impossible_travel": "HIGH",
    "amount_spike": "MEDIUM",
    "merchant_anomaly": "MEDIUM",
    "device_switching": "MEDIUM",
    "time_anomaly": "LOW",
    "first_party_fraud": "MEDIUM",
    "promotion_abuse": "LOW",
}
STEP_COST = {"detective": 0.002, "analyst": 0.015, "verifier": 0.01}


def prefilter(amount: Column, score: Column) -> Column:
    """Why a case needs no investigation; NULL if it does."""
    return F.when(amount < 5, "micro").when(score < 0.2, "low score").when(score > 0.8, "high score")


def parsed(df: DataFrame, response: str = "response") -> DataFrame:
    """df with finding (struct, NULL where the text is missing or no JSON) and missing (the
    required fields that it lacks), values clamped and invalid ones replaced."""
    raw = F.from_json(response, FINDING)
    ok = F.get_json_object(response, "$").isNotNull()
    out = df.withColumn("_f", F.when(ok, raw))
    f = lambda c: F.col(f"_f.{c}")
    missing = F.array_compact(F.array(*(F.when(f(c).isNull(), c) for c in REQUIRED)))
    valid = lambda c, allowed, default: F.when(f(c).isin(*allowed), f(c)).otherwise(default)
    made = F.struct(
        F.when(f("risk_level").isNull(), f("risk_level")).otherwise(valid("risk_level", LEVELS, "MEDIUM")).alias("risk_level"),
        clamp(f("confidence")).alias("confidence"),
        clamp(f("anomaly_score")).alias("anomaly_score"),
        f("n_flags").alias("n_flags"),
        f("deeper").alias("deeper"),
        f("fraud_type").alias("fraud_type"),
        valid("final_decision", DECISIONS, "UNCERTAIN").alias("final_decision"),
        valid("recommended_action", ACTIONS, "ESCALATE_TO_HITL").alias("recommended_action"),
    )
    return out.withColumns({"finding": F.when(F.col("_f").isNotNull(), made), "missing": F.when(F.col("_f").isNotNull(), missing)}).drop("_f")


def with_fallback(df: DataFrame) -> DataFrame:
    """Findings that are missing become the cautious ones: medium risk, no confidence, escalate."""
    rest = F.struct(
        F.lit("MEDIUM").alias("risk_level"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("anomaly_score"), F.lit(1).alias("n_flags"), F.lit(True).alias("deeper"),
        F.lit(None).cast("string").alias("fraud_type"), F.lit("UNCERTAIN").alias("final_decision"), F.lit("ESCALATE_TO_HITL").alias("recommended_action"),
    )
    return df.withColumns({"is_fallback": F.col("finding").isNull(), "finding": F.coalesce("finding", rest)})


def next_step(step: Column, skipped: Column, confidence: Column, deeper: Column, n_flags: Column) -> Column:
    done = (confidence > 0.9) & ~F.coalesce(deeper, F.lit(True))
    direct = (confidence > 0.9) | (F.coalesce(n_flags, F.lit(0)) == 0)
    return F.when(skipped, "end").when(step == "detective", F.when(done, "end").when(direct, "verifier").otherwise("analyst")).when(step == "analyst", "verifier").otherwise("end")


def action_for(decision: Column, confidence: Column) -> Column:
    sure = F.when(decision == "FRAUD", "DECLINE").otherwise("APPROVE")
    return F.when(decision == "UNCERTAIN", "ESCALATE_TO_HITL").when(confidence > 0.85, sure).when(confidence >= 0.5, "REVIEW").otherwise("ESCALATE_TO_HITL")


def combined_confidence(model: Column, detective: Column, analyst: Column, verifier: Column) -> Column:
    """Weights 0.3, 0.2, 0.3, 0.2 over those present. model: a probability."""
    parts = ((2 * F.abs(model - 0.5), 0.3), (detective, 0.2), (analyst, 0.3), (verifier, 0.2))
    total = sum(F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts)
    return sum(F.coalesce(c * w, F.lit(0.0)) for c, w in parts) / total


def outcomes(steps: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """One row for each case: final_decision, recommended_action, steps_run, cost. steps:
    case_no, step (name), finding. The verifier decides, else the detective's level."""
    of = lambda s: F.max(F.when(F.col("step") == s, F.struct(F.col("finding.confidence").alias("confidence"), F.col("finding.risk_level").alias("risk_level"), F.col("finding.final_decision").alias("final_decision"), F.col("finding.recommended_action").alias("recommended_action")))).alias(s)
    wide = steps.groupBy("case_no").agg(of("detective"), of("analyst"), of("verifier"))
    d, v = F.col("detective"), F.col("verifier")
    decision = F.when(v.isNotNull(), v["final_decision"]).when(d.isNotNull(), F.when(d["risk_level"].isin("HIGH", "CRITICAL"), "FRAUD").otherwise("LEGIT")).otherwise("UNCERTAIN")
    action = F.when(v.isNotNull(), v["recommended_action"]).when(d.isNotNull(), "REVIEW").otherwise("ESCALATE_TO_HITL")
    run = F.array_compact(F.array(*(F.when(F.col(s).isNotNull(), s) for s in STEP_COST)))
    cost = sum(F.when(F.col(s).isNotNull(), c).otherwise(0.0) for s, c in STEP_COST.items())
    return wide.select(
        "case_no", decision.alias("final_decision"), action.alias("recommended_action"), run.alias("steps_run"), cost.alias("cost"),
        F.col("detective.confidence").alias("detective_confidence"), F.col("analyst.confidence").alias("analyst_confidence"), F.col("verifier.confidence").alias("verifier_confidence"),
    )


def token_cost(tokens: DataFrame, prices: DataFrame) -> DataFrame:
    """tokens: case_no, model, tokens_in, tokens_out; prices: model, price_in, price_out per 1,000."""
    cost = F.col("tokens_in") / 1000 * F.col("price_in") + F.col("tokens_out") / 1000 * F.col("price_out")
    return tokens.join(prices, "model").groupBy("case_no").agg(F.sum(cost).alias("cost"))


def batch_summary(done: DataFrame) -> DataFrame:
    return done.agg(F.count("*").alias("cases"), F.sum("cost").alias("total_cost"), F.sum((F.col("final_decision") == "FRAUD").cast("long")).alias("flagged"), F.avg((F.col("final_decision") == "FRAUD").cast("double")).alias("flagged_share"))


def severity(fraud_type: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, fraud_type), F.lit("MEDIUM"))
