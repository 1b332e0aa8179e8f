"""Block lists: (entity_type, entity, added_at in microseconds), with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import domain_last

WEEK = 7 * 86_400_000_000
#: Lists up to this many rows are broadcast; longer ones are joined by shuffle.
SMALL = 1_000_000


def live(lists: DataFrame, as_of: int, ttl: int = WEEK) -> DataFrame:
    return lists.where(F.col("added_at") > as_of - ttl)


def add(lists: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union with the newest added_at of each entity."""
    both = lists.unionByName(incoming)
    return both.groupBy("entity_type", "entity").agg(F.max("added_at").alias("added_at"))


def added_count(lists: DataFrame, incoming: DataFrame) -> DataFrame:
    """How many entities of each type are new."""
    key = ["entity_type", "entity"]
    return incoming.select(*key).distinct().join(lists, key, "left_anti").groupBy("entity_type").agg(F.count("*").alias("added"))


def remove(lists: DataFrame, gone: DataFrame) -> DataFrame:
    return lists.join(gone, ["entity_type", "entity"], "left_anti")


def screen(df: DataFrame, lists: DataFrame, columns: dict[str, Column], id: str = "transaction_id") -> DataFrame:
    """df with blocked and block_reasons. columns: entity type to the entity of a row; the
    reasons keep that order and the entity's own case. One join on the unpivoted entities."""
    entity = [F.struct(F.lit(k).alias("order"), F.lit(t).alias("entity_type"), c.cast("string").alias("shown")) for k, (t, c) in enumerate(columns.items())]
    each = df.select(id, F.inline(F.array(*entity))).where("shown is not null and shown <> ''")
    each = each.withColumn("entity", F.when(F.col("entity_type") == "email_domain", domain_last(F.col("shown"))).otherwise(F.col("shown")))
    held = lists.select("entity_type", "entity").distinct()
    hit = each.join(F.broadcast(held) if held.count() <= SMALL else held, ["entity_type", "entity"])
    reason = F.concat("entity_type", F.lit(": "), "shown")
    found = hit.groupBy(id).agg(F.transform(F.sort_array(F.collect_list(F.struct("order", reason.alias("reason")))), lambda x: x["reason"]).alias("block_reasons"))
    out = df.join(found, id, "left")
    return out.withColumns({"blocked": F.col("block_reasons").isNotNull(), "block_reasons": F.coalesce("block_reasons", F.array().cast("array<string>"))})


def seeded(txn: DataFrame, as_of: int, span: int, columns: dict[str, Column]) -> DataFrame:
    """Block-list rows from the fraud rows of the last span."""
    recent = txn.where((F.col("is_fraud") == 1) & (F.col("us") > as_of - span))
    entity = F.array(*(F.struct(F.lit(t).alias("entity_type"), c.cast("string").alias("entity")) for t, c in columns.items()))
    each = recent.select(F.inline(entity)).where("entity is not null and entity <> ''")
    return each.distinct().withColumn("added_at", F.lit(as_of))


#: Bits of a Bloom filter: 4 MB, whatever the list; a longer list lets more rows through.
BITS, HASHES = 1 << 25, 4


def bloom_filter(lists: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bits of all (list, entity) rows, as 64-bit words: bits / 64 of them come to the driver."""
    h = F.xxhash64("list", "entity")
    at = F.explode(F.array(*(F.pmod(h + F.shiftrightunsigned(h, 32) * k, F.lit(bits)) for k in range(HASHES))))
    words = lists.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out


def may_hold(words: np.ndarray, df: DataFrame) -> Column:
    """A function of xxhash64(list, entity): false only for what is on no list. The filter is broadcast."""
    held = df.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf(T.BooleanType())
    def passes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits = np.uint64(len(held.value) * 64 - 1)
        for hashes in batches:
            h = hashes.to_numpy(zero_copy_only=False).view(np.uint64)
            out = np.ones(len(h), bool)
            for k in range(HASHES):
                at = (h + (h >> np.uint64(32)) * np.uint64(k)) & bits
                out &= (held.value[at >> np.uint64(6)].view(np.uint64) >> (at & np.uint64(63))) & np.uint64(1) == 1
            yield pa.array(out)

    return passes


def listed(df: DataFrame, lists: DataFrame, columns: dict[str, Column], id: str = "transaction_id", small: int = SMALL, bits: int = BITS) -> DataFrame:
    """df with a boolean _in_<list> for each of columns (list to the entity of a row). lists:
    list, entity. Short lists are broadcast. Of long ones a Bloom filter is: rows that it lets
    pass are joined with the lists by a shuffle, all others are on no list and are not moved.
    id is unique; rows that share one share what its rows hit."""
    names = list(columns)
    held = lists.select("list", F.col("entity").cast("string").alias("entity")).where(F.col("list").isin(*names) & F.col("entity").isNotNull()).distinct()
    flags = [f"_in_{n}" for n in names]
    own = df.withColumns({f"_of_{n}": c.cast("string") for n, c in columns.items()})
    drop = [f"_of_{n}" for n in names]
    if held.count() <= small:
        for n in names:
            one = held.where(F.col("list") == n).select(F.col("entity").alias(f"_of_{n}"), F.lit(True).alias(f"_in_{n}"))
            own = own.join(F.broadcast(one), f"_of_{n}", "left")
        return own.select(*df.columns, *(F.coalesce(f, F.lit(False)).alias(f) for f in flags))
    passes = may_hold(bloom_filter(held, bits), df)
    own = own.withColumns({f"_may_{n}": F.col(f"_of_{n}").isNotNull() & passes(F.xxhash64(F.lit(n), f"_of_{n}")) for n in names})
    some = F.greatest(*(F.col(f"_may_{n}") for n in names)) if len(names) > 1 else F.col(f"_may_{names[0]}")
    each = F.array(*(F.when(F.col(f"_may_{n}"), F.struct(F.lit(n).alias("list"), F.col(f"_of_{n}").alias("entity"))) for n in names))
    near = own.where(some)
    asked = near.select(id, F.inline(F.array_compact(each)))
    hits = asked.join(held, ["list", "entity"]).groupBy(id).agg(*(F.bool_or(F.col("list") == n).alias(f) for n, f in zip(names, flags, strict=True)))
    joined = near.drop(*drop, *(f"_may_{n}" for n in names)).join(hits, id, "left").select(*df.columns, *(F.coalesce(f, F.lit(False)).alias(f) for f in flags))
    return own.where(~some).select(*df.columns, *(F.lit(False).alias(f) for f in flags)).unionAll(joined)
