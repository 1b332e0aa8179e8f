"""Operator 5: SimHash near-duplicates by sharded vantage-point trees.

Every text gets a 64-bit fingerprint of its 3-word shingles. The distinct fingerprints are
searched for pairs at most radius bits apart: the upper levels of a vantage-point tree,
fitted on a bounded sample, send each fingerprint to its home shard and, where the
triangle bound lets a pair lie across a branch, as a visitor to shards before its home.
Each shard runs the lower levels and keeps one link for each fingerprint to the smallest of
its group in the shard, never all pairs of a group. Components join the shards' links.

The sample (sample_size fingerprints, or four for each shard, a million at most) only shapes
the tree: every fingerprint is routed and every pair within the radius is found, whatever
the shape. The triangle bound prunes little for a radius of 2 in 64 bits: of random
fingerprints a row visits 1.4 shards in a tree of 2 levels, 2.3 in 4, 3.9 in 6, 6.9 in 8, 12.8
in 10 and 23.8 in 12 (levels: base-2 logarithm of fingerprints / SHARD).

Null and empty texts have the fingerprint zero and are linked like any other. Rows with a
NULL doc_id get a fingerprint, and a NULL component if no row with an id shares it. Copies
and repeated rows share a fingerprint and a component. Long texts are hashed in chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, documents, saved, tidy, unboxed, whole
from .components import components

#: Distinct fingerprints that a shard has on average.
SHARD = 8192
#: Levels of the upper tree at most: a quarter of a million shards, their sample 8 MB.
DEEPEST = 18
#: Sets of fewer fingerprints are compared pair by pair.
LEAF = 1024
#: Sets above this size that no vantage point divides are searched by flipping bits.
DENSE = 200_000


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space divides
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < 3:
        return digest(b" ".join(words), 42)
    n = len(words) - 2
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        some = words[k : k + 65538]
        hashes = np.array([digest(b" ".join(s), 42) for s in zip(some, some[1:], some[2:], strict=False)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64))
    tidy()


class Tree:
    """The upper levels: a vantage point and a median distance at each node, heap order."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.point = np.zeros(1 << depth, np.uint64)
        self.median = np.zeros(1 << depth, np.int64)
        rng = np.random.default_rng(5)
        sets = {1: sample}
        for node in range(1, 1 << depth):
            own = sets.pop(node, sample[:0])
            if not len(own):
                own = sample
            tries = rng.choice(own, min(len(own), 8), replace=False)
            spread = [np.bitwise_count(own ^ p).std() for p in tries]
            self.point[node] = p = tries[int(np.argmax(spread))]
            d = np.bitwise_count(own ^ p).astype(np.int64)
            self.median[node] = m = int(np.median(d))
            sets[2 * node], sets[2 * node + 1] = own[d <= m], own[d > m]

    def route(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, home): the home shard of each row and the earlier shards it visits."""
        out = []

        def go(node: int, rows: np.ndarray, home: np.ndarray) -> None:
            if not len(rows):
                return
            if node >> self.depth:
                out.append((rows, np.full(len(rows), node - (1 << self.depth)), home))
                return
            d = np.bitwise_count(prints[rows] ^ self.point[node]).astype(np.int64)
            m = self.median[node]
            near = d <= m
            # A row at home on the far side visits the near side if a pair can lie across;
            # a visitor goes on to both sides.
            left = near | (d <= m + radius)
            right = ~near | (~home & (d > m - radius))
            go(2 * node, rows[left], (home & near)[left])
            go(2 * node + 1, rows[right], (home & ~near)[right])

        go(1, np.arange(len(prints)), np.ones(len(prints), bool))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3


class Groups:
    """Union-find over the positions of a shard; the root is the smallest node."""

    def __init__(self, nodes: np.ndarray):
        self.nodes = nodes
        self.up = np.arange(len(nodes))

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.roots()
            a, b = root[a], root[b]
            a, b = a[differ := a != b], b[differ]
            if not len(a):
                return
            first = self.nodes[a] <= self.nodes[b]
            low, high = np.where(first, a, b), np.where(first, b, a)
            self.up[high] = low  # of several, one stays; the rest is tried again


def link_within(prints: np.ndarray, rows: np.ndarray, groups: Groups, radius: int, rng) -> None:
    """Link all pairs of rows within the radius."""
    if len(rows) <= LEAF:
        return link_across(prints, rows, rows, groups, radius, rng)
    d, m = _distances(prints, rows, rows, rng)
    if m is None:
        return link_across(prints, rows, rows, groups, radius, rng, 3)
    near = d <= m
    link_within(prints, rows[near], groups, radius, rng)
    link_within(prints, rows[~near], groups, radius, rng)
    link_across(prints, rows[near & (d > m - radius)], rows[~near & (d <= m + radius)], groups, radius, rng)


def _distances(prints: np.ndarray, rows: np.ndarray, pool: np.ndarray, rng) -> tuple[np.ndarray, int | None]:
    """Distances from the best of a few vantage points, and their median (None: it does not divide)."""
    best, at = -1.0, 0
    for p in rng.choice(pool, min(len(pool), 5), replace=False):
        d = np.bitwise_count(prints[rows[:: max(1, len(rows) // 2048)]] ^ prints[p])
        if d.std() > best:
            best, at = d.std(), p
    d = np.bitwise_count(prints[rows] ^ prints[at]).astype(np.int64)
    m = int(np.median(d))
    share = (d <= m).mean()
    if share > 0.95:
        m -= 1
        share = (d <= m).mean()
    return d, m if 0.02 < share < 0.98 else None


def link_across(prints: np.ndarray, left: np.ndarray, right: np.ndarray, groups: Groups, radius: int, rng, gain: int = 0) -> None:
    """Link the pairs of one row of left and one of right within the radius."""
    if not len(left) or not len(right):
        return
    if len(left) * len(right) > LEAF * LEAF and gain < 3:
        d, m = _distances(prints, np.concatenate([left, right]), left if len(left) >= len(right) else right, rng)
        if m is not None:
            dl, dr = d[: len(left)], d[len(left) :]
            parts = [
                (left[dl <= m], right[dr <= m]),
                (left[dl > m], right[dr > m]),
                (left[(dl <= m) & (dl > m - radius)], right[(dr > m) & (dr <= m + radius)]),
                (left[(dl > m) & (dl <= m + radius)], right[(dr <= m) & (dr > m - radius)]),
            ]
            work = sum(len(a) * len(b) for a, b in parts)
            gain = gain + 1 if work > 0.8 * len(left) * len(right) else 0
            for a, b in parts:
                link_across(prints, a, b, groups, radius, rng, gain)
            return
    if min(len(left), len(right)) > DENSE:
        return link_dense(prints, left, right, groups, radius)
    for k in range(0, len(left), 256):
        some = left[k : k + 256]
        for j in range(0, len(right), 16384):
            part = right[j : j + 16384]
            a, b = np.nonzero(np.bitwise_count(prints[some][:, None] ^ prints[part][None, :]) <= radius)
            groups.link(some[a], part[b])


def link_dense(prints: np.ndarray, left: np.ndarray, right: np.ndarray, groups: Groups, radius: int) -> None:
    """The same by looking up every fingerprint with up to radius bits flipped."""
    order = right[np.argsort(prints[right])]
    keys = prints[order]
    masks, last = {0}, {0}
    for _ in range(radius):
        last = {m ^ 1 << i for m in last for i in range(64)}
        masks |= last
    for mask in sorted(masks):
        wanted = prints[left] ^ np.uint64(mask)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        groups.link(left[hit], order[at[hit]])


def solve_shard(prints: np.ndarray, nodes: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its group in this shard)."""
    groups, rng = Groups(nodes), np.random.default_rng(11)
    own, visitors = np.flatnonzero(home), np.flatnonzero(~home)
    link_within(prints, own, groups, radius, rng)
    link_across(prints, own, visitors, groups, radius, rng)
    root = groups.roots()
    linked = root != np.arange(len(root))
    return nodes[linked], nodes[root[linked]]


def near_links(distinct: DataFrame, radius: int, sample_size: int = 65_536) -> DataFrame:
    """distinct: fp and node, both long, fp distinct. Links a, b that connect all nodes whose
    fingerprints are within the radius."""
    spark, n = distinct.sparkSession, distinct.count()
    depth = min(DEEPEST, max(0, math.ceil(math.log2(max(1, n) / SHARD))))
    sample_size = max(sample_size, 4 << depth)
    tree = None
    if depth:
        some = distinct.select("fp").sample(min(1.0, 1.1 * sample_size / n), seed=3).limit(sample_size).toArrow()
        sample = np.sort(some.column(0).to_numpy()).view(np.uint64)
        tree = spark.sparkContext.broadcast(Tree(sample, depth))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, node = (batch.column(k).to_numpy() for k in (0, 1))
            if tree is None:
                rows, shard, home = np.arange(len(fp)), np.zeros(len(fp), int), np.ones(len(fp), bool)
            else:
                rows, shard, home = tree.value.route(fp.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(fp[rows]), pa.array(node[rows]), pa.array(home)], ["shard", "fp", "node", "home"])

    def solved(table: pa.Table) -> pa.Table:
        fp, node, home = (table.column(k).to_numpy() for k in ("fp", "node", "home"))
        order = np.lexsort((fp, ~home))
        a, b = solve_shard(fp[order].view(np.uint64), node[order], home[order], radius)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sent = distinct.select("fp", "node").mapInArrow(routed, "shard int, fp long, node long, home boolean")
    return sent.groupBy("shard").applyInArrow(solved, "a long, b long")


def simhash_components(docs: DataFrame, radius: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fp (long) and component_id of every row of docs."""
    prints = saved(docs.select(id, simhash(whole(text)).alias("fp")), "simhash")
    distinct = saved(prints.groupBy("fp").agg(F.min(id).cast("long").alias("node")), "simhash-distinct")
    reached = components(near_links(distinct.where("node is not null"), radius), label="simhash-links")
    named = distinct.join(reached, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select(id, "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(documents(spark, sf_dir))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, radius: int = 2, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the near copies: of each component the row with the smallest id stays.
    Rows without an id stay. A row is known by its id and its text: repeated rows leave one,
    an id with two texts is two documents."""
    from pyspark.sql import Window as W

    th = F.xxhash64(text)
    prints = saved(docs.where(F.col(id).isNotNull()).select(F.col(id).alias("_k"), th.alias("_h"), simhash(whole(text)).alias("fp")), "simhash")
    distinct = saved(prints.groupBy("fp").agg(F.first("fp").alias("node")), "simhash-distinct")
    reached = components(near_links(distinct, radius), label="simhash-links")
    placed = prints.join(distinct.join(reached, "node", "left").select("fp", F.coalesce("component", "node").alias("c")), "fp")
    kept = placed.groupBy("c").agg(F.min(F.struct("_k", "_h")).alias("kept"))
    gone = placed.join(kept, "c").where(F.struct("_k", "_h") != F.col("kept")).select("_k", "_h").distinct()
    keyed = boxed(docs, F.col(id).alias("_k"), th.alias("_h")).join(gone, ["_k", "_h"], "left_anti")
    own = W.partitionBy("_k", "_h").orderBy("_h")
    return unboxed(keyed.withColumn("_n", F.row_number().over(own)).where("_k is null or _n = 1"), docs)
