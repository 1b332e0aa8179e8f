"""Projections, typing, joins, aggregates and samples over feature tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def model_matrix(df: DataFrame, exclude: tuple[str, ...], fill: float | None = 0.0) -> DataFrame:
    """Numeric columns but the excluded; NULL and NaN become fill."""
    names = [n for n, kind in df.dtypes if is_numeric(kind) and n not in exclude]
    out = df.select(*names)
    if fill is None:
        return out
    return out.select(*(F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double")), F.lit(fill)).alias(n) for n in names))


def apply_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.select(*(F.coalesce(F.col(c) if c in df.columns else F.lit(None), F.lit(d)).alias(c) for c, d in defaults.items()))


def feature_report(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """A row for each wanted feature: missing column, wrong type, or values that do not cast."""
    kinds = dict(df.dtypes)
    present = [c for c in wanted if c in kinds]
    fails = [F.sum((F.col(c).isNotNull() & F.col(c).cast("string").try_cast(wanted[c]).isNull()).cast("long")).alias(c) for c in present]
    counts = df.agg(*fails) if fails else df.agg(F.lit(0).alias("_"))
    rows = []
    for c, kind in wanted.items():
        state = "missing" if c not in kinds else "ok" if is_numeric(kinds[c]) == (kind != "string") else "wrong type"
        rows.append(F.struct(F.lit(c).alias("feature"), F.lit(state).alias("state"), (F.coalesce(F.col(c), F.lit(0)) if c in present else F.lit(0)).cast("long").alias("failed_casts")))
    return counts.select(F.inline(F.array(*rows)))


def mean_by(df: DataFrame, keys: list[str], value: str, name: str = "rate") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(name))


def with_rate(df: DataFrame, rates: DataFrame, keys: list[str], default: float, name: str = "rate") -> DataFrame:
    """Rate lookup; unseen keys get the default. Small tables are broadcast by their size."""
    return df.join(rates, keys, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def top_users(df: DataFrame, user: str, by: str, n: int) -> DataFrame:
    return df.groupBy(user).agg(F.max(by).alias(by)).orderBy(F.desc(by), user).limit(n)


def missing_share(df: DataFrame) -> DataFrame:
    """A row for each column with its share of NULLs, and one for all cells."""
    agg = df.agg(*(F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in df.columns))
    each = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing")) for c in df.columns]
    total = F.struct(F.lit("*").alias("column"), (reduce(lambda a, b: a + b, (F.col(f"`{c}`") for c in df.columns)) / len(df.columns)).alias("missing"))
    return agg.select(F.inline(F.array(*each, total)))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of their kind. Counted by groups, so one pass and one shuffle."""
    return df.groupBy(*df.columns).count().agg(F.sum(F.col("count") - 1).alias("duplicates"), F.sum("count").alias("total"))


def baseline_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, rows, mean, population std, min, max, median, q25, q75. Plain statistics are one
    aggregate over wide rows; the exact quantiles come from counted values in ranges."""
    per = []
    for c in columns:
        x = F.col(c).cast("double")
        per.append(F.struct(F.count(x).alias("rows"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")).alias(c))
    wide = df.agg(*per)
    each = wide.select(F.inline(F.array(*(F.struct(F.lit(c).alias("feature"), *(F.col(f"{c}.{k}").alias(k) for k in ("rows", "mean", "std", "min", "max"))) for c in columns))))
    q = ranks.quantiles(unpivoted(df, columns), ["feature"], "x", [0.25, 0.5, 0.75])
    return each.join(q, "feature", "left").select(*each.columns, F.col("q")[1].alias("median"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"))


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, x: the filled cells of numeric columns."""
    cells = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))
    return df.select(F.inline(cells)).where("x is not null and not isnan(x)")


def percentiles(df: DataFrame, column: str) -> DataFrame:
    q = ranks.quantiles(df.select(column), [], column, [0.5, 0.95, 0.99])
    return q.select(F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    bad, good = F.sum((F.col(label) == 1).cast("long")), F.sum((F.col(label) == 0).cast("long"))
    return df.agg(bad.alias("fraud"), good.alias("legit"), F.avg((F.col(label) == 1).cast("double")).alias("fraud_rate"), F.try_divide(good, bad).alias("imbalance"))


def hash_order(id: Column, seed: int) -> Column:
    return F.md5(F.concat(id.cast("string"), F.lit(f":{seed}")))


def seeded_sample(df: DataFrame, id: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in the order of a seeded hash: the same in every run; a top-k, no sort."""
    return df.orderBy(hash_order(F.col(id), seed), id).limit(n)


def _hash_ranked(df: DataFrame, id: str, label: str, seed: int) -> DataFrame:
    """df with _n, the rank of a row by its hash within its label, and _n_all. A hash is spread
    evenly, so its first digits are the ranges of the ranking."""
    hashed = df.withColumn("_h", hash_order(F.col(id), seed))
    return ranks.ranked(hashed, [label], F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint"), [F.col("_h"), F.col(id)], "_n").drop("_h")


def stratified_split(df: DataFrame, id: str, label: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with is_test: exactly round(share * n) rows of each label."""
    return _hash_ranked(df, id, label, seed).withColumn("is_test", F.col("_n") <= F.round(F.col("_n_all") * share)).drop("_n", "_n_all")


def hash_split(df: DataFrame, id: str, share: float, seed: int = 42, name: str = "is_test") -> DataFrame:
    """df with a flag that holds for about that share of rows, by a threshold on a hash."""
    unit = F.conv(F.substring(hash_order(F.col(id), seed), 1, 8), 16, 10).cast("double") / float(16**8)
    return df.withColumn(name, unit < share)


def folds(df: DataFrame, id: str, label: str, k: int, seed: int = 42) -> DataFrame:
    return _hash_ranked(df, id, label, seed).withColumn("fold", (F.col("_n") - 1) % k).drop("_n", "_n_all")


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """Values in code-point order and their code from 0; over distinct values only."""
    values = df.select(F.col(column).alias("value")).distinct()
    return values.withColumn("code", F.row_number().over(Window.orderBy("value")) - 1)
