"""Scores, routing into decisions, and the reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RouteConfig


def fallback_score(df: DataFrame, score: str = "fraud_score") -> DataFrame:
    """Without a model: the given score and a confidence of 0.5."""
    return df.withColumns({"model_score": F.coalesce(F.col(score), F.lit(0.0)), "confidence": F.lit(0.5)})


def route(df: DataFrame, config: RouteConfig = RouteConfig(), outcomes: DataFrame | None = None) -> DataFrame:
    """df (rules_decision, model_score, confidence) with final_decision, recommended_action,
    layer_stopped_at, score and confidence to 4 places. outcomes: transaction_id,
    review_decision, review_action, review_confidence of rows in the grey zone."""
    if outcomes is not None:
        df = df.join(outcomes.select("transaction_id", "review_decision", "review_action", "review_confidence"), "transaction_id", "left")
    else:
        df = df.withColumns({c: F.lit(None).cast(t) for c, t in (("review_decision", "string"), ("review_action", "string"), ("review_confidence", "double"))})
    rules, s = F.col("rules_decision"), F.col("model_score")
    layer = F.when(rules == "DECLINE", "rules_decline").when(rules == "APPROVE", "rules_approve").when(s >= config.high, "xgboost_high").when(s < config.low, "xgboost_low").otherwise("full_pipeline")
    out = df.withColumn("layer_stopped_at", layer)
    stopped = F.col("layer_stopped_at")
    bad, good = stopped.isin("rules_decline", "xgboost_high"), stopped.isin("rules_approve", "xgboost_low")
    reviewed, unsure = F.col("review_decision").isNotNull(), s >= config.grey_split
    return out.withColumns(
        {
            "final_decision": F.when(bad, "FRAUD").when(good, "LEGIT").when(reviewed, F.col("review_decision")).when(unsure, "UNCERTAIN").otherwise("LEGIT"),
            "recommended_action": F.when(bad, "DECLINE").when(good, "APPROVE").when(reviewed, F.coalesce("review_action", F.lit("ESCALATE_TO_HITL"))).when(unsure, "ESCALATE_TO_HITL").otherwise("APPROVE"),
            "score": F.round(F.when(stopped == "rules_decline", 1.0).when(stopped == "rules_approve", 0.0).otherwise(s), 4),
            "confidence": F.round(F.when(stopped.startswith("rules"), 1.0).when((stopped == "full_pipeline") & reviewed, F.coalesce("review_confidence", "confidence")).otherwise(F.col("confidence")), 4),
        }
    ).drop("review_decision", "review_action", "review_confidence")


def confusion(df: DataFrame, predicted: Column, actual: Column, by: list[str] | None = None, rows: Column | None = None) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1, fpr and accuracy; 0 on empty denominators. rows: how
    many a row of df stands for, if not one."""
    n = lambda c: F.coalesce(F.sum(c.cast("long") if rows is None else c.cast("long") * rows), F.lit(0))
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    counts = df.groupBy(*(by or [])).agg(n(p & a).alias("tp"), n(p & ~a).alias("fp"), n(~p & ~a).alias("tn"), n(~p & a).alias("fn"))
    rate = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns(
        {"precision": rate(tp, tp + fp), "recall": rate(tp, tp + fn), "f1": rate(2 * tp, 2 * tp + fp + fn), "fpr": rate(fp, fp + tn), "accuracy": rate(tp + tn, tp + fp + tn + fn)}
    )


def shares(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by key and their share of all rows; the total is one row, joined by broadcast."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def grey_zone(df: DataFrame, config: RouteConfig = RouteConfig()) -> DataFrame:
    inside = (F.col("score") >= config.low) & (F.col("score") < config.high)
    return df.agg(F.sum(inside.cast("long")).alias("grey_rows"), F.avg(inside.cast("double")).alias("grey_share"))


def risk_band(score: Column, config: RouteConfig = RouteConfig()) -> Column:
    high, medium, low = config.bands
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score >= low, "low").otherwise("minimal")


def review_impact(df: DataFrame, outcomes: DataFrame, threshold: float = 0.5, config: RouteConfig = RouteConfig()) -> DataFrame:
    """Confusion with and without the outcomes of reviews in the grey zone, one row."""
    s, label = F.col("score"), F.col("label") == 1
    grey = (s >= config.low) & (s < config.high)
    both = df.join(outcomes.select("transaction_id", F.col("review_decision").alias("_r")), "transaction_id", "left")
    before, after = s >= threshold, F.when(grey & F.col("_r").isNotNull(), F.col("_r") == "FRAUD").otherwise(s >= threshold)
    one = confusion(both, before, label).select(F.col("fp").alias("fp_before"), F.col("fpr").alias("fpr_before"), F.col("recall").alias("recall_before"))
    two = confusion(both, after, label).select(F.col("fp").alias("fp_after"), F.col("fpr").alias("fpr_after"), F.col("recall").alias("recall_after"))
    pair = one.crossJoin(F.broadcast(two))  # one row each
    cut = lambda a, b: F.coalesce(F.try_divide(F.col(a) - F.col(b), F.col(a)) * 100, F.lit(0.0))
    return pair.withColumns({"fp_reduction_pct": cut("fp_before", "fp_after"), "fpr_reduction_pct": cut("fpr_before", "fpr_after")})
