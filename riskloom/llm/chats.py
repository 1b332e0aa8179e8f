"""Operator 2: chat formatting after cumulative-snapshot collapse.

A log that stores a conversation after every turn holds it many times, each time a prefix of
the next. Every turn gets the rolling hash of its prefix: two 64-bit exclusive-ors of the
hashes of the turns so far with their positions. A conversation whose whole hash is the hash
of a proper prefix of a longer one goes, by an anti-join; of equal conversations the one with
the smallest id stays. What is left is maximal and is rendered.

Turns are ordered by turn, then role and text, NULL last in each. Rows that repeat a turn count
once. A NULL role is rendered as unknown, a NULL text as empty, and neither equals the
empty string in a comparison. Rows with a NULL conv_id are one conversation. An empty table
gives no rows. Other columns do not matter. A conversation is one row once it is rendered;
before that a long one is a run of small hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _hash(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *(x for c in columns for x in (F.coalesce(c, F.lit("")), c.isNull())))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, k, a, b, n: the hash of the first k of n turns, for every k."""
    slim = turns.select("conv_id", "turn", "role", "text", _hash(1, F.col("role"), F.col("text")).alias("x"), _hash(2, F.col("text"), F.col("role")).alias("y"))
    once = slim.repartition("conv_id").dropDuplicates(["conv_id", "turn", "role", "text"])
    order = Window.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_last() for c in ("turn", "role", "text")))
    placed = once.withColumn("k", F.row_number().over(order))
    upto = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = lambda c: F.bit_xor(F.xxhash64("k", c)).over(upto)
    return placed.select("conv_id", "k", rolled("x").alias("a"), rolled("y").alias("b"), F.count("*").over(Window.partitionBy("conv_id")).alias("n"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and copies of the conversations that are no prefix of a longer one."""
    hashes = prefix_hashes(turns)
    whole = hashes.where("k = n").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    parts = hashes.where("k < n").select(F.col("k").alias("n").cast("long"), "a", "b").distinct()
    return whole.join(parts, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "copies")


def rendered(turns: DataFrame, head: str = "<|{role}|>\n", tail: str = "<|end|>\n") -> DataFrame:
    """conv_id, n_turns, copies and rendered, of the maximal conversations."""
    before, after = head.split("{role}")
    kept = maximal(turns).withColumn("_c", F.col("conv_id"))
    line = F.concat(F.lit(before), F.coalesce("role", F.lit("unknown")), F.lit(after), F.coalesce("text", F.lit("")), F.lit("\n" + tail))
    order = F.struct(*(x.alias(f"{c}{k}") for c in ("turn", "role", "text") for k, x in enumerate((F.col(c).isNull(), F.col(c)))), line.alias("line"))
    texts = turns.join(kept.select("_c"), turns["conv_id"].eqNullSafe(F.col("_c")), "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_set(order)).alias("turns"))
    made = texts.select(F.col("conv_id").alias("_c"), F.array_join(F.transform("turns", lambda t: t["line"]), "").alias("rendered"))
    return kept.drop("_c").join(made, kept["conv_id"].eqNullSafe(made["_c"])).drop("_c")


def op2_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP2_SQL = r"""
with t as (select distinct conv_id, turn, role, text from conversations),
c as (select conv_id, count(*) as n_turns, list({'r': role, 't': text} order by turn, role, text) as l,
  string_agg(concat('<|', coalesce(role, 'unknown'), '|>', chr(10), coalesce(text, ''), chr(10), '<|end|>', chr(10)), '' order by turn, role, text) as rendered from t group by 1),
d as (select min(conv_id) as conv_id, n_turns, l, count(*) as copies, any_value(rendered) as rendered from c group by n_turns, l),
p as (select distinct l[1:k] as l from (select l, unnest(range(1, n_turns)) as k from c))
select conv_id, n_turns, copies, rendered from d anti join p using (l)
"""
