"""The data-quality report: points by section, their total and grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import QualityConfig
from . import ranks
from .tables import duplicate_rows, missing_share


def quality_report(df: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """One row: points of each section, total of 100, percentage and grade. df: a feature
    table; sections whose columns are absent give their stand-in points."""
    has = set(df.columns).__contains__
    fraud = F.col("is_fraud") if has("is_fraud") else None
    scen = F.col("fraud_scenario") if has("fraud_scenario") else None
    lo, hi = config.fraud_rate
    points: dict[str, Column] = {"size": F.when(F.count("*") >= config.full_size, 10).otherwise(5)}
    points["balance"] = F.when(F.avg(fraud.cast("double")).between(lo, hi), 15).otherwise(8) if fraud is not None else F.lit(0)
    points["variety"] = F.when(F.count_distinct(F.when(fraud == 1, scen)) >= config.scenarios, 15).otherwise(8) if scen is not None and fraud is not None else F.lit(5)
    checks = []
    if has("avg_transaction_amount"):
        a = F.col("avg_transaction_amount").cast("double")
        median = ranks.quantiles(df.select("avg_transaction_amount"), [], "avg_transaction_amount", [0.5]).first()
        checks.append(F.avg(a).between(20, 500) & F.lit(median is not None and median.q[0] is not None and 10 <= median.q[0] <= 300))
    if has("account_age_days"):
        checks.append(F.avg("account_age_days").between(30, 3650))
    if has("transaction_count"):
        checks.append(F.avg("transaction_count").between(10, 5000))
    if has("fraud_score"):
        checks.append((F.min("fraud_score") >= 0) & (F.max("fraud_score") <= 1))
    passed = sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks), F.lit(0))
    points["values"] = passed * 20 / len(checks) if checks else F.lit(10.0)
    if scen is not None and fraud is not None:
        some = lambda *names: F.when(F.sum(scen.isin(*names).cast("int")) > 0, 5).otherwise(0)
        points["scenarios"] = some("impossible_travel") + some("velocity_attack") + some("card_testing", "card_testing_final")
    else:
        points["scenarios"] = F.lit(8)
    known = [F.coalesce(F.corr(c, "is_fraud") > bound, F.lit(False)).cast("int") for c, bound in config.correlations if has(c) and fraud is not None]
    points["correlations"] = F.when(sum(known, F.lit(0)) >= 2, 15).otherwise(8)
    one = df.agg(*(v.cast("double").alias(k) for k, v in points.items()))
    missing = missing_share(df).where("column = '*'").select((F.col("missing") * 100).alias("missing_pct"))
    double = duplicate_rows(df).select((F.col("duplicates") / F.col("total") * 100).alias("duplicate_pct"))
    both = one.crossJoin(F.broadcast(missing)).crossJoin(F.broadcast(double))  # one row each
    clean = F.when(F.col("missing_pct") < 1, 5).when(F.col("missing_pct") < 5, 3).otherwise(0) + F.when(F.col("duplicate_pct") < 0.1, 5).otherwise(3)
    both = both.withColumn("completeness", clean.cast("double"))
    total = sum((F.col(c) for c in [*points, "completeness"]), F.lit(0.0))
    pct = F.col("total")
    grade = F.when(pct >= 90, "A+").when(pct >= 80, "A").when(pct >= 70, "B").when(pct >= 60, "C").otherwise("D")
    issues = F.filter(F.array(F.when(F.col("missing_pct") >= 1, F.lit("missing data")), F.when(F.col("duplicate_pct") >= 0.1, F.lit("duplicates"))), lambda x: x.isNotNull())
    return both.withColumn("total", total).withColumns({"grade": grade, "issues": issues})
