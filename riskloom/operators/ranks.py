"""Ranks and running sums over whole tables. Rows meet in ranges of the value that orders
them, cut at its quantiles, so no group of rows is one task; a small table of the ranges'
totals carries the sums from range to range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a group.
PARTS = 256
START = (Window.unboundedPreceding, Window.currentRow)


def place(bounds: Column, value: Column, parts: int = PARTS) -> Column:
    """The last place of an ascending array whose element is value or less; 0 if none is."""
    halves = F.sequence(F.lit(parts.bit_length() - 1), F.lit(0), F.lit(-1))
    further = lambda at, k: at + F.pow(F.lit(2), k).cast("int")
    return F.aggregate(halves, F.lit(0), lambda at, k: F.when(F.get(bounds, further(at, k)) <= value, further(at, k)).otherwise(at))


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join in which NULL keys meet."""
    named = right.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *(c for c in right.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    return left.join(named, on, "left").drop(*(f"_of_{k}" for k in keys))


def ranged(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """df with _range: the range of a numeric value among the quantiles of its group. NULL
    values are in the first."""
    valued = df.withColumn("_value", value)
    bounds = valued.groupBy(*by).agg(F.percentile_approx("_value", [k / PARTS for k in range(PARTS)], 100 * PARTS).alias("_bounds"))
    return _meet(valued, bounds, by).withColumn("_range", place(F.col("_bounds"), F.col("_value"))).drop("_bounds", "_value")


def _before(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """For each group and range: the sums over the ranges before it, and over all."""
    each = rows.groupBy(*by, "_range").agg(*(c.alias(f"_{n}") for n, c in sums.items()))
    own = Window.partitionBy(*by)
    prior = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return each.select(*by, "_range", *(F.coalesce(F.sum(f"_{n}").over(prior), F.lit(0)).alias(f"_before_{n}") for n in sums), *(F.sum(f"_{n}").over(own).alias(f"{n}_all") for n in sums))


def ranked(df: DataFrame, by: list[str], value: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """df with a gapless rank from 1 within each group and name_all, the rows of the group.
    order starts with what value grows with. by may be empty, here and below."""
    if not by:
        return ranked(df.withColumn("_group", F.lit(0)), ["_group"], value, order, name).drop("_group")
    rows = ranged(df, by, value)
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order)))
    out = _meet(own, _before(rows, by, {name: F.count(F.lit(1))}), [*by, "_range"])
    return out.withColumn(name, F.col("_own") + F.col(f"_before_{name}")).drop("_own", f"_before_{name}", "_range")


def running(df: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """df, with one row for each value of a group, and for each of sums: x_upto, the sum over the
    values up to this one, and x_all, over the group."""
    if not by:
        return running(df.withColumn("_group", F.lit(0)), ["_group"], value, sums).drop("_group")
    rows = ranged(df, by, F.col(value))
    upto = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(*START)
    own = rows.withColumns({f"_own_{x}": F.sum(x).over(upto) for x in sums})
    out = _meet(own, _before(rows, by, {x: F.sum(x) for x in sums}), [*by, "_range"])
    return out.withColumns({f"{x}_upto": F.col(f"_own_{x}") + F.col(f"_before_{x}") for x in sums}).drop("_range", *(f"_own_{x}" for x in sums), *(f"_before_{x}" for x in sums))


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by, and q: exact interpolated quantiles of each group, in the order of shares. Values are
    counted first; NULL and NaN are left out."""
    counted = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*by, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_k"))
    r = running(counted, by, "_x", ["_k"])
    at = lambda i: F.min(F.when(F.col("_k_upto") > i, F.col("_x")))
    spot = [(F.col("_k_all") - 1) * s for s in shares]
    ends = r.groupBy(*by).agg(F.max("_k_all").alias("_n"), *(at(f(p)).alias(f"_{n}{k}") for k, p in enumerate(spot) for n, f in (("lo", F.floor), ("hi", F.ceil))))
    share = [(F.col("_n") - 1) * s for s in shares]
    return ends.select(*by, F.array(*(F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * (p - F.floor(p)) for k, p in enumerate(share))).alias("q"))
