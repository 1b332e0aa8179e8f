"""Operator 1: sharding by histogram sort.

Rows are put in the order of a key and cut into shards of near equal bytes. The cuts are
found by counting the exact bytes below candidate boundaries: first 8,192 boundaries
evenly laid over the key, then up to 1,024 inside each interval that still holds a cut, and so
on, until every cut meets its tolerance or no two rows are left to part. Only these
histograms reach the driver: at most MOST_COUNTS counts in a round, since the more cuts are
open, the fewer boundaries each gets. Then the rows are exchanged once, by fine ranges
between the cuts, and numbered inside their shards.

The key of a document is a hash of its text, so equal texts stay together unless their
group is larger than the largest text, whose place alone makes shards as uneven; a larger
group that no cut's tolerance leaves whole is parted by doc_id.

NULL texts count as empty: 16 bytes. NULL ids come first among ties. Rows that repeat an
id and a text cannot be parted and go to one shard. An empty table gives no rows; fewer
rows than shards leave some shards empty. Other columns pass through.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, documents, dropped, saved, whole

#: Bits of the key that each round of probes settles: of a hash of 63, then of a tie.
KEY_BITS, FIRST, NEXT = 63, 13, 10
#: Counts of a round that may reach the driver, but for the first.
MOST_COUNTS = 1 << 18
#: Rows of a fine range, about; and ranges of a shard at most.
RANGE_ROWS, MOST_RANGES = 100_000, 256


class Cut:
    """One wanted cut: goal bytes below it, give or take slack."""

    def __init__(self, goal: float, slack: float, whole: int):
        self.goal, self.slack, self.whole = goal, slack, whole
        self.key = self.tie = 0  # rows below (key, tie) go left
        self.prefix, self.below, self.open = 0, 0, True

    def settle(self, counts: dict[int, tuple[int, int]], shift: int, tie: bool) -> None:
        """counts: bytes and rows of each value of the next bits inside this interval."""
        values = sorted(counts)
        ends = [self.below, *(self.below + x for x in accumulate(counts[v][0] for v in values))]
        at = min(bisect_right(ends, self.goal) - 1, len(values) - 1)
        rest = counts[values[at]][1]
        left, right = self.goal - ends[at], ends[at + 1] - self.goal
        bound = values[at] if left <= right else values[at] + 1
        if tie:
            self.tie = bound << shift
        else:
            self.key = bound << shift
        group = not tie and shift == 0 and counts[values[at]][0] <= self.whole
        if min(left, right) <= self.slack or rest <= 1 or group:
            self.open = False
            return
        self.prefix, self.below = values[at], ends[at]
        if not tie and shift == 0:
            self.key = values[at]


def find_cuts(keyed: DataFrame, goals: list[tuple[float, float]], tie_bits: int, whole: int = 0) -> list[Cut]:
    """keyed: key, tie and size, long, key and tie not negative. goals: bytes, slack. A key of at
    most whole bytes is not parted."""
    cuts = [Cut(*g, whole) for g in goals]
    for tie, bits in ((False, KEY_BITS), (True, tie_bits)):
        last = bits
        while last:
            waiting = [c for c in cuts if c.open]
            if not waiting:
                return cuts
            first = last == bits
            step = FIRST if first and not tie else max(1, min(NEXT, (MOST_COUNTS // len(waiting)).bit_length() - 1))
            shift = last - min(last, step)
            column = F.col("tie") if tie else F.col("key")
            where = F.shiftright(column, last) if last < 63 else F.lit(0).cast("long")
            if tie:  # one key holds more than a cut may leave out
                part = keyed.where(F.col("key").isin(list({c.key for c in waiting})))
                place = F.struct("key", where.alias("prefix"))
            else:
                part = keyed if first else keyed.where(where.isin(list({c.prefix for c in waiting})))
                place = F.struct(F.lit(0).cast("long").alias("key"), where.alias("prefix"))
            found = part.groupBy(place.alias("p"), F.shiftright(column, shift).alias("v")).agg(F.sum("size").alias("s"), F.count("*").alias("n"))
            hist: dict[tuple, dict] = {}
            for r in found.collect():
                hist.setdefault((r.p.key, r.p.prefix), {})[r.v] = (r.s, r.n)
            for c in waiting:
                own = hist.get((c.key if tie else 0, 0 if tie and first else c.prefix))
                if own:
                    c.settle(own, shift, tie)
                else:
                    c.open = False
            last = shift
    return cuts


def histogram_shards(df: DataFrame, key: Column, tie: Column, size: Column, n_shards: int, tolerance: float = 0.002, group_slack: float = 0.01) -> DataFrame:
    """df with shard and slot, in place of columns of those names. Shards hold equal sums of size to about tolerance of a
    shard, groups of one key are not parted where a cut at their edge misses by up to
    group_slack of a shard; tie orders and parts what is left."""
    named = boxed(df, F.shiftrightunsigned(key.cast("long"), 1).alias("_key"), tie.cast("long").alias("_tie"), size.cast("long").alias("_size"))
    keyed = saved(named.select(F.col("_key").alias("key"), F.col("_tie").alias("tie"), F.col("_size").alias("size")), "shard-keys")
    total = keyed.agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("tie").alias("lo"), F.max("tie").alias("hi"), F.max("size").alias("most")).first()
    if not total.n:
        return df.withColumns({"shard": F.lit(0).cast("int"), "slot": F.lit(0).cast("long")})
    fine = min(MOST_RANGES, max(1, round(total.n / n_shards / RANGE_ROWS)))
    step = total.s / (n_shards * fine)
    slack = lambda k: step * fine * (max(tolerance, group_slack) if k % fine == 0 else 0.25 / fine)
    base = (total.lo or 0) - 1  # a NULL tie comes before all others
    from_base = lambda c: F.coalesce(F.col(c) - base, F.lit(0))
    based = keyed.withColumn("tie", from_base("tie"))
    cuts = find_cuts(based, [(step * k, slack(k)) for k in range(1, n_shards * fine)], max(1, ((total.hi or 0) - base).bit_length()), total.most)
    bounds = sorted((c.key, c.tie) for c in cuts)

    # Place of a row: the ranges before its first 13 bits, and the cuts at or below it among those.
    shift = KEY_BITS - FIRST
    inside: dict[int, list] = {}
    for k, t in bounds:
        inside.setdefault(k >> shift, []).append((k, t))
    before = [0, *accumulate(len(inside.get(p, ())) for p in range(1 << FIRST))]
    lookup = df.sparkSession.createDataFrame(
        [(p, before[p], inside.get(p, [])) for p in range(1 << FIRST)], "p long, before int, cuts array<struct<k:long,t:long>>"
    )
    own_tie = from_base("_tie")
    at_or_below = lambda c: (c["k"] < F.col("_key")) | ((c["k"] == F.col("_key")) & (c["t"] <= own_tie))
    placed = lambda d: d.join(F.broadcast(lookup), F.shiftright("_key", shift) == F.col("p")).withColumn("_range", F.col("before") + F.size(F.filter("cuts", at_or_below))).drop("p", "before", "cuts")
    rows = placed(keyed.select(F.col("key").alias("_key"), F.col("tie").alias("_tie"))).groupBy("_range").count().collect()
    dropped(keyed)
    count = dict(map(tuple, rows))
    first = [0]
    for r in range(n_shards * fine - 1):
        first.append(0 if (r + 1) % fine == 0 else first[-1] + count.get(r, 0))
    starts = df.sparkSession.createDataFrame(list(enumerate(first)), "_range int, _first long")
    order = Window.partitionBy("_range").orderBy("_key", "_tie")
    numbered = placed(named).withColumn("_rank", F.row_number().over(order) - 1).join(F.broadcast(starts), "_range")
    kept = [F.col("_row").getField(c).alias(c) for c in df.columns if c not in ("shard", "slot")]
    return numbered.select(*kept, F.floor(F.col("_range") / fine).cast("int").alias("shard"), (F.col("_rank") + F.col("_first")).alias("slot"))


def op1_histogram_sort(spark: SparkSession, sf_dir: str, n_shards: int = 40) -> DataFrame:
    docs = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(whole()) + 16).cast("long").alias("size"),
        F.crc32(F.encode(whole(), "UTF-8")).alias("text_crc32"),
        F.xxhash64(whole()).alias("hash"),
    )
    out = histogram_shards(docs, F.col("hash"), F.col("doc_id"), F.col("size"), n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
