"""Connected components of links, by large-star and small-star rounds over a saved table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b", label: str = "links") -> DataFrame:
    """node, component (the smallest node reachable) for every node of links that is not
    itself the smallest. links: two long columns; loops, repeats and either direction are
    allowed, and rows with a NULL end link nothing. No links: no rows."""
    oriented = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v")
    edges = saved(oriented.distinct(), label)
    state = _state(edges)
    while state[0]:
        step = saved(_small_star(_large_star(edges)).distinct(), label)
        dropped(edges)
        edges, last, state = step, state, _state(step)
        if last == state:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
