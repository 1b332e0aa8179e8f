"""Column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371 * F.asin(F.sqrt(a))


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def domain_last(email: Column) -> Column:
    """What stands after the last @, lower case; empty without one."""
    return F.when(F.contains(email, F.lit("@")), F.lower(F.element_at(F.split(email, "@"), -1))).otherwise(F.lit(""))


def domain_second(email: Column) -> Column:
    """The second @ segment, lower case; NULL without one."""
    return F.lower(F.try_element_at(F.split(email, "@"), F.lit(2)))


def masked(x: Column, n: int) -> Column:
    return F.concat(F.substring(x, 1, n), F.lit("..."))


def first_filled(*columns: Column) -> Column:
    """The first that is neither NULL nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, in any session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def safe_double(x: Column, default: float = 0.0) -> Column:
    v = x.try_cast("double")
    return F.coalesce(F.when(~F.isnan(v), v), F.lit(default))


def safe_long(x: Column, default: int = 0) -> Column:
    """Through double, so that '3.7' gives 3."""
    v = x.try_cast("double")
    return F.coalesce(F.when(~F.isnan(v), v).try_cast("bigint"), F.lit(default).cast("bigint"))


def safe_flag(x: Column, default: bool = False) -> Column:
    """A flag stored as a number."""
    return F.coalesce(x.try_cast("double").try_cast("bigint") != 0, F.lit(default))
