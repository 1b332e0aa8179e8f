"""Detectors of seven fraud sequences over a transaction table: user_id, us, transaction_id,
amount, location, device_id, merchant_category. Each adds a boolean column; all windows
share one partition and order, so the detectors together need one exchange."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .velocity import sliced

MINUTE = 60_000_000
HOUR = 60 * MINUTE


def own():
    return Window.partitionBy("user_id").orderBy("us", "transaction_id")


def prior():
    return own().rowsBetween(Window.unboundedPreceding, -1)


def _over_slices(df: DataFrame, name: str, back: int, to: int, made: Callable[[WindowSpec], Column]) -> DataFrame:
    """df with a column over the frame (t - back, t + to); users with many rows go in slices of time."""
    cut, keys = sliced(df, back + 1)
    frame = Window.partitionBy(*keys).orderBy("us").rangeBetween(-back, to)
    return cut.withColumn(name, made(frame)).where("_home").drop("_slice", "_home")


def impossible_travel(df: DataFrame, minutes: int = 5) -> DataFrame:
    """Another place and another device within minutes of the transaction before."""
    last = lambda c: F.lag(c).over(own())
    hit = (F.col("location") != last("location")) & (F.col("device_id") != last("device_id")) & (F.col("us") - last("us") <= minutes * MINUTE)
    return df.withColumn("pattern_travel", F.coalesce(hit, F.lit(False)))


def velocity_attack(df: DataFrame, n: int = 20, seconds: int = 120, most: float = 50.0) -> DataFrame:
    small = (F.col("amount") <= most).cast("int")
    return _over_slices(df, "pattern_velocity", seconds * 1_000_000, 0, lambda frame: F.sum(small).over(frame) >= n)


def card_testing(df: DataFrame, n: int = 5, minutes: int = 25, tiny: float = 1.0, large: float = 500.0) -> DataFrame:
    tests = lambda frame: F.coalesce(F.sum((F.col("amount") <= tiny).cast("int")).over(frame), F.lit(0))
    return _over_slices(df, "pattern_card_testing", minutes * MINUTE, -1, lambda frame: (F.col("amount") >= large) & (tests(frame) >= n))


def time_anomaly(df: DataFrame, night: tuple[int, int] = (0, 5), rare: float = 0.05, large: float = 400.0, history: int = 10) -> DataFrame:
    """A large amount in the night of a user whose transactions before were hardly ever then."""
    at_night = F.expr(f"(us % {24 * HOUR}) div {HOUR} between {night[0]} and {night[1]}")
    share, n = F.avg(at_night.cast("double")).over(prior()), F.count("*").over(prior())
    return df.withColumn("pattern_time", at_night & (F.col("amount") >= large) & (n >= history) & (share <= rare))


def amount_spike(df: DataFrame, ratio: float = 10.0, history: int = 10) -> DataFrame:
    mean, n = F.avg("amount").over(prior()), F.count("*").over(prior())
    return df.withColumn("pattern_spike", (n >= history) & (F.col("amount") > ratio * mean))


def _unseen(df: DataFrame, column: str, name: str, large: float, history: int) -> DataFrame:
    """A value that the user's rows before do not have: its first row by user and value."""
    first = F.row_number().over(Window.partitionBy("user_id", column).orderBy("us", "transaction_id")) == 1
    marked = df.withColumn("_first", first & F.col(column).isNotNull())
    return marked.withColumn(name, F.col("_first") & (F.count("*").over(prior()) >= history) & (F.col("amount") >= large)).drop("_first")


def category_anomaly(df: DataFrame, large: float = 300.0, history: int = 10) -> DataFrame:
    return _unseen(df, "merchant_category", "pattern_category", large, history)


def device_switch(df: DataFrame, large: float = 300.0, history: int = 10) -> DataFrame:
    return _unseen(df, "device_id", "pattern_device", large, history)
