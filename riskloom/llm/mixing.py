"""Operator 6: mixing sources to target weights, in DataFrame functions only.

The words of a source, its documents in a fixed order, are packed end to end and cut into
blocks of block words; the last block is what is left. A source's target is its share by
weight, never above cap times its words. The mix has one slot for each block it takes, and
the slots are dealt to output shards of slots_per_shard. The counts of each shard are
multinomial by target, on the condition that all shards together give each source its
target to the word, which is to draw without replacement from all slots (a multivariate
hypergeometric draw): slot g belongs to the source whose range of slots holds the image of
g in a pseudorandom permutation of all slots. The slots of a source walk its blocks
in the order of a permutation of its own, pass after pass, the short last block at the end
of a pass; the last slot is cut to the words that are left. Slots and blocks are joined by
source and block index.

Permutations are swap-or-not shuffles: any size, no table, the same in every run.

NULL texts count 0 words; a NULL source comes last and is a source like any other. NULL
ids, ties and repeated rows are packed and counted row by row. A source without words has
the target 0. An empty table gives no rows. Other columns pass through in mixed().
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, boxed, documents, saved, unboxed, whole

BLOCK = 128
SLOTS_PER_SHARD = 4096
#: Rows of a packed run of documents, about.
RUN = 20_000
ROUNDS = 20


def permuted(x: Column, n: Column, key: Column) -> Column:
    """The image of x in a pseudorandom permutation of 0 to n - 1."""

    def step(v: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("k"), key, r), n) - v, n)
        return F.when(F.pmod(F.xxhash64(F.lit("b"), key, r, F.greatest(v, other)), F.lit(2)) == 1, other).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, sid, source_size, weight, target. sized: source, size. One row for each
    source; its windows run over that small table."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double"))
    # Those that fill first are full; the first that does not sets the words per weight.
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), "sid")
    upto = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    most = cap * F.col("source_size")
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum(most).over(upto), F.lit(0.0))) / F.sum("weight").over(rest)
    levels = weighed.withColumn("level", level)
    fits = F.when(most >= F.col("level") * F.col("weight"), F.col("level"))
    out = levels.withColumn("lambda", F.max(fits).over(every))
    return out.select("source", "sid", "source_size", "weight", F.coalesce(F.least(most, F.col("lambda") * F.col("weight")), most).alias("target"))


def packed(sized: DataFrame, targets: DataFrame, n_rows: int) -> DataFrame:
    """sized with sid and start, the place of its first word among its source's words.
    Sources are packed in runs of documents, so that no source lands in one task."""
    runs = max(1, n_rows // RUN)
    dealt = sized.join(targets.select("source", "sid"), sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    dealt = dealt.withColumn("run", F.pmod(F.xxhash64("doc_id", "size", "spread"), F.lit(runs))).drop("spread")
    own = Window.partitionBy("sid", "run").orderBy("doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.withColumn("start", F.sum("size").over(own) - F.col("size"))
    lengths = dealt.groupBy("sid", "run").agg(F.sum("size").alias("length"))
    before = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lengths.select("sid", "run", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
    return inside.join(offsets, ["sid", "run"]).withColumn("start", F.col("start") + F.col("offset")).drop("run", "offset")


def slots(targets: DataFrame, block: int = BLOCK, slots_per_shard: int = SLOTS_PER_SHARD, seed: int = 1) -> DataFrame:
    """shard, slot, sid, pass, block and words: what each slot of the mix takes."""
    spark = targets.sparkSession
    w, t = F.col("source_size"), F.round("target").cast("long")
    plan = targets.where("source_size > 0").select("sid", w, t.alias("want"))
    plan = plan.withColumns({"blocks": F.ceil(w / block), "full": F.expr(f"source_size div {block}"), "passes": F.expr("want div source_size")})
    plan = plan.withColumn("left", F.col("want") - F.col("passes") * w)
    plan = plan.withColumn("n", F.col("passes") * F.col("blocks") + F.ceil(F.col("left") / block))
    plan = plan.where("n > 0").withColumn("first", F.sum("n").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    plan = saved(plan, "mix-plan")
    size = plan.agg(F.sum("n"), F.count("*")).first()
    n, sources = size[0] or 0, max(1, size[1])
    width = max(1, n // (4 * sources))
    near = plan.withColumn("at", F.explode(F.sequence(F.expr(f"first div {width}"), F.expr(f"(first + n - 1) div {width}"))))
    dealt = spark.range(n).withColumn("image", permuted(F.col("id"), F.lit(n), F.lit(seed).cast("long"))).withColumn("at", F.expr(f"image div {width}"))
    owned = dealt.join(near, "at").where("image >= first and image < first + n").drop("at")
    owned = owned.withColumns({"j": F.col("image") - F.col("first"), "shard": F.expr(f"id div {slots_per_shard}"), "slot": F.col("id") % slots_per_shard})
    owned = owned.withColumns({"pass": F.expr("j div blocks"), "q": F.col("j") % F.col("blocks")})
    image = F.when(F.col("q") < F.col("full"), permuted(F.col("q"), F.col("full"), F.col("sid") + F.lit(1000 * (seed + 1)))).otherwise(F.col("q"))
    length = F.when(F.col("q") < F.col("full"), block).otherwise(w - F.col("full") * block)
    cut = F.when((F.col("j") == F.col("n") - 1) & (F.col("left") > 0), F.col("left") - F.col("q") * block).otherwise(length)
    return owned.select("shard", "slot", "sid", "pass", image.alias("block"), F.least(length, cut).cast("long").alias("words"))


def taken_words(pack: DataFrame, dealt: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each packed row (rid) and pass: the ranges [a, b) of its words that the mix takes."""
    parts = pack.where("size > 0").select("rid", "sid", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block"))
    met = parts.join(dealt.select("sid", "pass", "block", "words"), ["sid", "block"])
    a = F.greatest(F.col("block") * block, F.col("start")) - F.col("start")
    b = F.least(F.col("block") * block + F.col("words"), F.col("start") + F.col("size")) - F.col("start")
    return met.select("rid", "pass", a.alias("a"), b.alias("b")).where("b > a")


def spread(text: str) -> Column:
    return F.when(F.col("doc_id").isNull(), F.xxhash64(text)).alias("spread")


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, source, size, rid, a number of the row, and spread, which parts rows without an id;
    written once so that it holds."""
    n = F.regexp_count(whole(text), F.lit(WORD)).cast("long")
    return saved(docs.select("doc_id", "source", n.alias("size"), spread(text)).withColumn("rid", F.monotonically_increasing_id()), "mix-sizes")


def mix(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, packed rows, slots) of the mix."""
    targets = saved(source_targets(sized, weights, share, cap), "mix-targets")
    pack = packed(sized, targets, sized.count())
    return targets, pack, slots(targets, block)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = sizes(documents(spark, sf_dir))
    targets, pack, dealt = mix(sized)
    pack = saved(pack, "mix-pack")
    taken = taken_words(pack, dealt).groupBy("rid").agg(F.sum(F.col("b") - F.col("a")).alias("taken"))
    out = pack.join(taken, "rid", "left").join(F.broadcast(targets.select("sid", "source_size", "target")) if targets.count() <= 10_000 else targets.select("sid", "source_size", "target"), "sid")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The mixed corpus as rows of docs: for each pass that takes words of a document, a row
    whose text is those words in their order, each with the white space before it."""
    n = F.regexp_count(whole(text), F.lit(WORD)).cast("long").alias("size")
    numbered = saved(boxed(docs, F.col("doc_id"), F.col("source"), F.col(text).alias("_text"), n, spread(text)).withColumn("rid", F.monotonically_increasing_id()), "mix-docs")
    _, pack, dealt = mix(numbered.select("doc_id", "source", "size", "spread", "rid"), **how)
    ranges = taken_words(pack, dealt).groupBy("rid", "pass").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("ranges"))
    met = numbered.join(ranges, "rid")
    met = met.withColumn("_w", F.regexp_extract_all(whole("_text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)))
    join_all = F.array_join(F.flatten(F.transform("ranges", lambda r: F.slice("_w", (r["a"] + 1).cast("int"), (r["b"] - r["a"]).cast("int")))), "")
    every = (F.size("ranges") == 1) & (F.col("ranges")[0]["a"] == 0) & (F.col("ranges")[0]["b"] == F.col("size"))
    made = met.withColumn("_mixed", F.when(every, F.col("_text")).otherwise(F.ltrim(join_all)))
    return unboxed(made, docs, **{text: F.col("_mixed"), "n_chars": F.length("_mixed")})
