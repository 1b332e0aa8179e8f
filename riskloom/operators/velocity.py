"""Trailing windows over an account's transactions. All frames share the partition by user
and the order by time, so one exchange and one sort serve them.

A user with many rows is cut into slices of time: the key is then (user, slice), each row of the
user is copied into the later slices whose frames reach back to it, and what frames over the whole
life need of earlier slices comes from the slices' totals. So no user is one task. Users below the
bound keep one partition, and where no user is above it the plan is that of plain windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR
#: A user is cut into slices above this many rows, and above this share of all rows.
HOT_ROWS, HOT_SHARE = 100_000, 0.001


def hot_users(df: DataFrame, user: str = "user_id", hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Users above the bounds; no more than 1 / HOT_SHARE, so they can be broadcast. None: no user."""
    n = df.count()
    if n <= hot_rows:
        return None
    many = df.groupBy(user).count().where(F.col("count") > max(hot_rows, HOT_SHARE * n)).select(user).collect()
    kind = df.schema[user].dataType.simpleString()
    return df.sparkSession.createDataFrame([tuple(r) for r in many], f"`{user}` {kind}") if many else None


def sliced(df: DataFrame, span: int, user: str = "user_id", at: str = "us", hot_rows: int = HOT_ROWS, parts: int = 4) -> tuple[DataFrame, list[str]]:
    """df with _slice and _home, and the partition keys of windows whose frames reach back by less
    than span. A slice of a hot user is span / parts long and holds its own rows (_home) and
    copies of those that its frames reach."""
    hot = hot_users(df, user, hot_rows)
    if hot is None:
        return df.withColumns({"_slice": F.lit(None).cast("long"), "_home": F.lit(True)}), [user]
    width = max(1, span // parts)
    home = F.floor(F.col(at) / width)
    marked = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), user, "left")
    last = F.floor((F.col(at) + (span - 1)) / width)
    each = F.when(F.col("_hot"), F.sequence(home, last)).otherwise(F.array(F.lit(None).cast("long")))
    out = marked.withColumn("_slice", F.explode(each))
    return out.select(*df.columns, "_slice", (F.col("_slice").isNull() | (F.col("_slice") == home)).alias("_home")), [user, "_slice"]


def trailing(df: DataFrame, spans: dict[str, int], user: str = "user_id", at: str = "us", hot_rows: int = HOT_ROWS) -> DataFrame:
    """df with count_<span> and amount_<span>: what lies in (t - span, t]. Equal times count
    once; equal (amount to 4 places, time) are summed once. Rows are dealt out by user first,
    which serves the windows over equal rows as well."""
    cut, keys = sliced(df, max(spans.values()), user, at, hot_rows)
    rows = cut.withColumn("_part", F.round("amount", 4)).repartition(*keys)
    by_time, same = Window.partitionBy(*keys).orderBy(at), Window.partitionBy(*keys, at).orderBy("_part", "transaction_id")
    first = F.row_number().over(same) == 1
    again = F.lag("_part").over(same).eqNullSafe(F.col("_part")) & ~first
    marked = rows.withColumns({"_once": first.cast("int"), "_part": F.when(again, 0.0).otherwise(F.col("_part"))})
    out = {}
    for name, span in spans.items():
        frame = by_time.rangeBetween(-span + 1, 0)
        out[f"count_{name}"] = F.sum("_once").over(frame)
        out[f"amount_{name}"] = F.round(F.sum("_part").over(frame), 2)
    return marked.withColumns(out).where("_home").drop("_once", "_part", "_slice", "_home")


def _before_slices(cut: DataFrame, totals: dict[str, Column], user: str, at: str) -> DataFrame:
    """user, _slice and what all earlier slices of the user hold: totals by name, first and last time."""
    own = cut.where("_home and _slice is not null").groupBy(user, "_slice")
    each = own.agg(*(F.sum(v).alias(k) for k, v in totals.items()), F.min(at).alias("_first"), F.max(at).alias("_last"))
    before = Window.partitionBy(user).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    made = {f"_b{k}": F.sum(k).over(before) for k in totals} | {"_bfirst": F.min("_first").over(before), "_blast": F.max("_last").over(before)}
    return each.withColumns(made).select(user, "_slice", *made)


def velocity_block(df: DataFrame, user: str = "user_id", at: str = "us", id: str = "transaction_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The velocity features that a table of transactions can give. Rows of equal time see each
    other; the time since the last transaction goes by time, then id."""
    cut, keys = sliced(df, 30 * DAY, user, at, hot_rows)
    a = F.col("amount")
    weekday = F.expr(f"pmod(floor({at} / {DAY}) + 3, 7)")  # Monday is 0
    hour = F.expr(f"floor(pmod({at}, {DAY}) / {HOUR})")
    flag = lambda c: c.cast("long")
    totals = {"_n": F.lit(1), "_k": flag(a.isNotNull()), "_a": a, "_weekend": flag(weekday >= 5), "_night": flag((hour >= 22) | (hour < 6))}
    rows, earlier = cut, {}
    if len(keys) > 1:
        rows = cut.join(_before_slices(cut, totals, user, at), keys, "left")
        earlier = {c: F.col(f"_b{c}") for c in [*totals, "first", "last"]}
    by_time = Window.partitionBy(*keys).orderBy(at)
    in_order = Window.partitionBy(*keys).orderBy(at, id)
    span = lambda w: by_time.rangeBetween(-w + 1, 0)
    life = by_time.rangeBetween(Window.unboundedPreceding, 0)

    def so_far(name: str) -> Column:
        own = F.sum(F.when(F.col("_home"), totals[name])).over(life)
        return F.coalesce(own, F.lit(0)) + F.coalesce(earlier[name], F.lit(0)) if earlier else own

    first, last = F.min(F.when(F.col("_home"), F.col(at))).over(life), F.lag(at).over(in_order)
    if earlier:
        first, last = F.least(first, earlier["first"]), F.coalesce(F.when(F.lag("_home").over(in_order), last), earlier["last"])
    std = F.stddev_samp(a).over(span(30 * DAY))
    out = rows.withColumns({"days_since_last": (F.col(at) - last) / DAY} | {f"_t{k}": so_far(k) for k in totals} | {"_from": first})
    mean = F.try_divide("_t_a", "_t_k")
    out = out.withColumns(
        {
            "transactions_last_hour": F.count("*").over(span(HOUR)),
            "transactions_last_day": F.count("*").over(span(DAY)),
            "transactions_last_week": F.count("*").over(span(7 * DAY)),
            "amount_last_hour": F.sum(a).over(span(HOUR)),
            "amount_last_day": F.sum(a).over(span(DAY)),
            "amount_last_week": F.sum(a).over(span(7 * DAY)),
            "avg_amount_7d": F.avg(a).over(span(7 * DAY)),
            "max_amount_30d": F.max(a).over(span(30 * DAY)),
            "std_amount_30d": std,
            "avg_transaction_amount": mean,
            "transaction_count": F.col("_t_n"),
            "weekend_share": F.try_divide("_t_weekend", "_t_n"),
            "night_share": F.try_divide("_t_night", "_t_n"),
            # The times between add up to the time from the first transaction to this one.
            "mean_days_between": F.try_divide((F.col(at) - F.col("_from")) / DAY, F.col("_t_n") - 1),
            "amount_z_score": F.when(std > 0, (a - mean) / std),
        }
    )
    helpers = {"_slice", "_home", "_from", *(f"_t{k}" for k in totals), *(f"_b{k}" for k in [*totals, "first", "last"])}
    return out.where("_home").select(*df.columns, *(c for c in out.columns if c not in helpers and c not in df.columns))


def last_row(df: DataFrame, user: str, *order: str) -> DataFrame:
    """The last row of each user in an explicit order."""
    own = Window.partitionBy(user).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def warm_windows(df: DataFrame, as_of: int, span: int = DAY, user: str = "user_id", at: str = "us") -> DataFrame:
    """What each user's window holds at as_of: events newer than as_of - span."""
    kept = df.where((F.col(at) > as_of - span) & (F.col(at) <= as_of))
    return kept.groupBy(user).agg(F.count("*").alias("events"), F.min(at).alias("oldest"), F.max(at).alias("newest"), F.sum("amount").alias("amount"))
