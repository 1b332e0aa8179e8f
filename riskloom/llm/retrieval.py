"""Operator 11: ranked lexical search by norm buckets of impact vectors.

1. Every text is cut into terms in its task; a row keeps its length and the terms that some item
   asks for. Numbers of documents and terms and document frequencies come from all rows.
2. The impact of a term in a document is its weight times its damped frequency, an integer. A
   score is the sum of the impacts of an item's terms: the product of the document's vector with
   the item's 0/1 vector. Each row gets the length (norm) of its vector.
3. Norm buckets: a histogram of all norms gives cuts; the longest vectors are searched first, and
   the 50th best score found so far is each item's threshold for the buckets after them.
4. Cauchy-Schwarz prunes: sqrt(terms of the item) x norm bounds every score, so an item whose
   bound for a whole bucket is below its threshold skips it, and a bucket that no item needs is
   not read. Inside, the item's heaviest terms are the focus coordinates: what they add, plus
   Cauchy-Schwarz over the rest, bounds each row.
5. Survivors are scored exactly in 64-bit integers. Each task returns its best rows of an item,
   and these are cut to the best of all in two steps.

Items are taken in slices of bounded text, so their terms can be broadcast whatever their number;
each slice reads the documents again.

NULL and empty texts have no terms and are never found; items without terms find nothing. Rows of
equal id and text among the items are one item; equal ids with two texts are two items. Repeated
documents are ranked one by one. Documents without an id rank behind equal scores and are returned
with a NULL id. Ids are integers. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, dropped, saved, tidy, whole

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Text of the items that one pass over the documents answers.
SLICE_CHARS = 4_000_000
#: Share of the rows whose vectors are at least as long as those of the first, second... bucket.
BUCKETS = (1 / 64, 1 / 16, 1 / 4, 1)
#: Rows that are bounded and scored together.
BLOCK = 4096


def terms(text: str) -> list[str]:
    return TERM.findall(text.encode().lower().decode())  # bytes: only A-Z are lowered


def vectors(docs: DataFrame, vocabulary: list[str], id: str, text: str) -> DataFrame:
    """id, n (all terms of the text), at and tf: the terms of the vocabulary and their numbers."""
    places = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = places.value.get
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some, n, at, tf, ends = batch.slice(k, 512), [], [], [], [0]
                for t in some.column(1).to_pylist():
                    found = terms(t)
                    held = Counter(map(place, found))
                    held.pop(None, None)
                    n.append(len(found))
                    at += held
                    tf += held.values()
                    ends.append(len(at))
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (at, tf)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), *lists], ["id", "n", "at", "tf"])
        tidy()

    return docs.select(F.col(id).cast("long").alias("id"), whole(text).alias("text")).mapInArrow(cut, "id long, n long, at array<int>, tf array<int>")


def totals(rows: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Rows with a term, all terms, and the rows that hold each term of the vocabulary."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            own = batch.column("n").to_numpy()
            n, length = n + int((own > 0).sum()), length + int(own.sum())
            df += np.bincount(batch.column("at").flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [-2, -1])), pa.array(np.append(df[some], [n, length]))], ["at", "n"])

    added = dict(rows.select("n", "at").mapInArrow(add, "at long, n long").groupBy("at").agg(F.sum("n")).collect())
    df = np.zeros(size, np.int64)
    for at, n in added.items():
        if at >= 0:
            df[at] = n
    return added.get(-2) or 0, added.get(-1) or 0, df


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(rows: DataFrame, n: int, length: int, weights: np.ndarray) -> DataFrame:
    """id, norm, at, impact: the vector of every row that holds a term of some weight."""
    heavy = rows.sparkSession.sparkContext.broadcast(weights)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("at", "tf"))
            size = batch.column("at").value_lengths().to_numpy()
            m = 50 + (50 * batch.column("n").to_numpy() * n) // max(length, 1)
            value = heavy.value[at] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, size)))
            ends = np.concatenate([[0], np.cumsum(size)])
            row = np.repeat(np.arange(len(size)), size)
            norm = np.sqrt(np.bincount(row, value.astype(float) ** 2, len(size)))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (at.astype(np.int32), value)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(norm), *lists], ["id", "norm", "at", "impact"])

    return rows.mapInArrow(weigh, "id long, norm double, at array<int>, impact array<long>").where("norm > 0")


class Search:
    """The best rows of each item over the batches of a task."""

    def __init__(self, items: list[np.ndarray], floor: np.ndarray, k: int, focus: int = 6):
        self.items, self.floor, self.k, self.focus = items, floor.copy(), k, focus
        self.best = [np.zeros((3, 0), np.int64) for _ in items]  # score, 1 where there is no id, id

    def read(self, batch: pa.RecordBatch) -> None:
        norm = batch.column("norm").to_numpy()
        order = np.argsort(-norm, kind="stable")
        for k in range(0, len(order), BLOCK):
            self._block(batch.take(pa.array(order[k : k + BLOCK])))

    def _block(self, rows: pa.RecordBatch) -> None:
        norm = rows.column("norm").to_numpy()
        ids = np.stack([rows.column("id").is_null().to_numpy(zero_copy_only=False).astype(np.int64), rows.column("id").fill_null(0).to_numpy()])
        size = rows.column("at").value_lengths().to_numpy()
        at, value = (rows.column(c).flatten().to_numpy() for c in ("at", "impact"))
        row = np.repeat(np.arange(len(norm)), size)
        by_term = np.argsort(at, kind="stable")
        at, value, row = at[by_term], value[by_term], row[by_term]
        square = value.astype(float) ** 2
        for i, own in enumerate(self.items):
            if math.sqrt(len(own)) * norm[0] * (1 + 1e-9) < self.floor[i]:
                continue  # Cauchy-Schwarz: no row of this block can reach the threshold
            begin, end = np.searchsorted(at, own, "left"), np.searchsorted(at, own, "right")
            score, seen = np.zeros(len(norm), np.int64), np.zeros(len(norm))
            for b, e in zip(begin[: self.focus], end[: self.focus], strict=True):
                score[row[b:e]] += value[b:e]
                seen[row[b:e]] += square[b:e]
            left = max(0, len(own) - self.focus)
            bound = score + np.sqrt(left * np.maximum(norm * norm * (1 + 1e-9) - seen, 0))
            alive = bound * (1 + 1e-9) >= self.floor[i]
            for b, e in zip(begin[self.focus :], end[self.focus :], strict=True):
                keep = alive[row[b:e]]
                score[row[b:e][keep]] += value[b:e][keep]
            hits = np.flatnonzero(alive & (score > 0) & (score >= self.floor[i]))
            if len(hits):
                self._add(i, np.vstack([score[hits], ids[:, hits]]))

    def _add(self, i: int, found: np.ndarray) -> None:
        both = np.hstack([self.best[i], found])
        self.best[i] = both = both[:, np.lexsort((both[2], both[1], -both[0]))[: self.k]]
        if both.shape[1] == self.k:
            self.floor[i] = max(self.floor[i], both[0, -1])

    def found(self) -> pa.RecordBatch:
        item = np.repeat(np.arange(len(self.items)), [b.shape[1] for b in self.best])
        score, none, id = np.hstack([*self.best, np.zeros((3, 0), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(id, mask=none > 0), pa.array(score)], ["item", "id", "score"])


def _top(found: DataFrame, k: int, *by: str) -> DataFrame:
    best = W.partitionBy("item", *by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _searched(vectors: DataFrame, items: list[np.ndarray], k: int) -> DataFrame:
    """item (place in items), id, score, rank."""
    spark = vectors.sparkSession
    cell = F.floor(4 * F.log2("norm"))
    cells = sorted(vectors.groupBy(cell.alias("cell")).count().collect(), reverse=True)
    total, taken, cuts = sum(n for _, n in cells), 0, []
    for at, n in cells:
        taken += n
        cuts += [at] * sum(taken - n < b * total <= taken for b in BUCKETS)
    cuts = sorted(set(cuts), reverse=True)
    best, floor, above = None, np.zeros(len(items), np.int64), None
    for cut in cuts:
        longest = 2.0 ** (above / 4) if above is not None else math.inf
        reach = [i for i, own in enumerate(items) if len(own) and math.sqrt(len(own)) * longest * (1 + 1e-9) >= floor[i]]
        if not reach:
            break  # no item can gain from this bucket or those below
        asked = spark.sparkContext.broadcast(([items[i] for i in reach], floor[reach]))

        def search(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            state = Search(*asked.value, k)
            for batch in batches:
                state.read(batch)
            yield state.found()
            tidy()

        bucket = vectors.where(cell >= cut) if above is None else vectors.where((cell >= cut) & (cell < above))
        rows = bucket.mapInArrow(search, "item long, id long, score long")
        place = spark.createDataFrame(list(enumerate(reach)), "item long, place long")
        rows = rows.join(F.broadcast(place), "item").select(F.col("place").alias("item"), "id", "score")
        rows = _top(rows.withColumn("part", F.spark_partition_id() % 64), k, "part").select("item", "id", "score")
        both = _top(rows if best is None else best.select("item", "id", "score").unionAll(rows), k)
        step = saved(both, "search-best")
        if best is not None:
            dropped(best)
        best, above = step, cut
        for item, score in best.where(F.col("rank") == k).select("item", "score").collect():
            floor[item] = score
    return best


def search(docs: DataFrame, items: DataFrame, k: int = 50, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k rows of docs that score highest for each item."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), whole(item_text).alias("text")).distinct()
    slices = max(1, math.ceil((asked.agg(F.sum(F.char_length("text"))).first()[0] or 0) / SLICE_CHARS))
    kind = asked.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, {id} long, score long")
    for part in range(slices):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == part).collect()
        cut = [sorted(set(terms(r.text))) for r in own]
        vocabulary = sorted(set().union(*cut))
        if not vocabulary:
            continue
        place = {t: i for i, t in enumerate(vocabulary)}
        rows = saved(vectors(docs, vocabulary, id, text), "search-terms")
        n, length, df = totals(rows, len(vocabulary))
        weights = np.array([weight(n, int(d)) if d else 0 for d in df], np.int64)
        wanted = [np.array(sorted((place[t] for t in c if weights[place[t]]), key=lambda p: (-weights[p], p)), np.int64) for c in cut]
        weighed = saved(impacts(rows, n, length, weights), "search-impacts")
        dropped(rows)
        best = _searched(weighed, wanted, k)
        dropped(weighed)
        if best is not None:
            names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(own)], f"item long, item_id {kind}")
            out = out.unionAll(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), F.col("id").alias(id), "score"))
    return out


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), words AS (
  SELECT doc_id, unnest(t) AS term FROM cut
), freq AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (
  SELECT doc_id, len(t) AS n FROM cut WHERE len(t) > 0
), totals AS (
  SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM lengths
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM freq, totals GROUP BY term, nd
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt)))) AS score
  FROM asked JOIN freq USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 50
"""
