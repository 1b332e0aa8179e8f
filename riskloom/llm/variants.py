"""Operator 13: spelling variant grouping by an index of variable-length grams.

1. Words and their numbers come from whole texts; a task adds up its own words first.
2. The gram dictionary: a gram of shortest to longest - 1 letters that more than `share` of all
   words hold is too frequent and is pruned in favour of the longer grams it begins. At most
   mean word length / share grams of each length can be that frequent, so the dictionary has a
   bound that does not grow with the data and is broadcast.
3. A word, with a mark at each end, is decomposed into one gram for each place: the shortest
   that is not too frequent. A gram is read from its own letters only.
4. The bound on affected grams: an edit at a place can touch only the grams that lie across it.
   All others must be shared, those before it by their distance from the start, those behind it
   by their distance from the end. So for each place the lists of all untouched grams are merged
   by one join on a digest of the set, instead of counting common grams; no pair within one edit
   is lost, whatever the dictionary holds.
5. Each candidate is verified by its edit distance inside the join, so only near pairs come out.

A word has at most (letters x alphabet) near words, so no group grows without limit. Forms lead
to words of ten times the number, so a chain has at most log10 of the largest number of links;
roots are found by pointer doubling.

NULL and empty texts have no words. A NULL id is written as nothing before the colon. Repeated
rows and equal texts under several ids count each time. Ties between forms go to the smallest
word in code-point order. Words of any length are decomposed in linear time. No rows: no words.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, dropped, saved, tidy, whole

LETTER = "[A-Za-zÀ-ÿ]"
START, END = "^", "$"


def slips(word: str, before: int, every: int) -> str:
    """The word, without one letter if its digest says so. before: the crc32 of what precedes it."""
    h = crc32(word.encode(), before)
    k = h % len(word)
    return word[:k] + word[k + 1 :] if h % every == 0 else word


def word_counts(docs: DataFrame, id: str = "doc_id", text: str = "text", shortest: int = 7, least: int = 2, every: int = 31, held: int = 200_000) -> DataFrame:
    """word, n: runs of letters, A-Z lowered, one letter lost in about one of `every` words of a
    document; those of `shortest` letters and `least` occurrences. A task holds `held` words."""
    runs = re.compile(f"{LETTER}{{{shortest},}}")  # greedy, so each match is a maximal run

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                before = crc32(f"{key}:".encode())
                for word, n in Counter(runs.findall(t.encode().lower().decode())).items():
                    seen[slips(word, before, every)] += n
                if len(seen) > held:
                    yield given()
                    seen.clear()
        yield given()
        tidy()

    cut = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), whole(text).alias("text"))
    counted = cut.mapInArrow(count, "word string, n long").where(F.char_length("word") >= shortest)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def frequent_grams(words: DataFrame, share: float, shortest: int, longest: int) -> list[str]:
    """Grams of shortest to longest - 1 letters at more than share x (number of words) places."""
    n = words.count()
    marked = words.select(F.concat(F.lit(START), "word", F.lit(END)).alias("w"))
    parts = [marked.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("w") - (q - 1)), lambda i, q=q: F.substring("w", i, F.lit(q)))).alias("gram")) for q in range(shortest, longest)]
    grams = parts[0]
    for part in parts[1:]:
        grams = grams.unionAll(part)
    return [r[0] for r in grams.groupBy("gram").count().where(F.col("count") > share * n).select("gram").collect()]


def decomposed(word: str, frequent: frozenset | set, shortest: int, longest: int) -> list[str]:
    """The gram at each place of the marked word: the shortest that is not frequent."""
    marked = START + word + END
    last, out = len(marked), []
    for i in range(last - shortest + 1):
        end = i + shortest
        while end < last and end - i < longest and marked[i:end] in frequent:
            end += 1
        out.append(marked[i:end])
    return out


def untouched(grams: list[str], letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the grams that an edit leaves alone: where a letter is lost, for each letter,
    and where one comes in, for each gap."""
    digest, size = xxhash.xxh64_intdigest, letters + 2
    left, right = np.zeros(size + 2, np.uint64), np.zeros(size + 2, np.uint64)
    head = np.array([digest(g, 2 * i) for i, g in enumerate(grams)], np.uint64)
    tail = np.array([digest(g, 2 * (size - i) + 1) for i, g in enumerate(grams)], np.uint64)
    np.add.at(left, np.arange(len(grams)) + [len(g) for g in grams], head)
    right[: len(grams)] = tail
    left, right = np.cumsum(left), np.cumsum(right[::-1])[::-1]
    place = np.arange(1, letters + 2, dtype=np.uint64)
    mix = place * np.uint64(0x9E3779B97F4A7C15)
    long = np.uint64(digest(b"", letters))
    short = np.uint64(digest(b"", letters - 1))
    at = place.astype(int)
    return (left[at] + right[at + 1] + mix + short)[:-1], left[at] + right[at] + mix + long


def near_pairs(words: DataFrame, share: float = 1 / 2000, shortest: int = 2, longest: int = 4) -> DataFrame:
    """a, n_a, b, n_b: each pair of words one edit apart, once. words: word (distinct), n."""
    frequent = words.sparkSession.sparkContext.broadcast(frozenset(frequent_grams(words, share, shortest, longest)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                some, keys, kinds, times = batch.slice(k, 2048), [], [], []
                for word in some.column("word").to_pylist():
                    lost, come = map(np.unique, untouched(decomposed(word, frequent.value, shortest, longest), len(word)))
                    keys += [lost, come]
                    kinds += [len(lost), len(come)]
                    times.append(len(lost) + len(come))
                rows = pa.array(np.repeat(np.arange(some.num_rows), times))
                kind = np.repeat(np.tile([False, True], some.num_rows), kinds)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(kind), some.column("word").take(rows), some.column("n").take(rows)], ["key", "gap", "word", "n"])
        tidy()

    lists = saved(words.select("word", "n").mapInArrow(index, "key long, gap boolean, word string, n long"), "variant-lists")
    a, b = (lists.select("key", F.col("gap").alias(f"gap_{x}"), F.col("word").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    meet = (F.col("gap_b") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)
    joined = a.where("not gap_a").hint("merge").join(b, "key").where(meet)
    return joined.select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last form that each word leads to. forms: word, form."""
    state = saved(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        on = state.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = saved(state.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        dropped(state)
        state = step
        if not state.where("moved").limit(1).count():
            return state.select("word", "root")


def variant_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n: a word's form is its near word of largest n, if
    that has ratio times its n at least."""
    words = saved(word_counts(docs, id, text), "variant-words")
    pairs = near_pairs(words)
    each = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m"))))
    best = F.min(F.struct((-F.col("m")).alias("less"), F.col("near").alias("near")))
    nears = pairs.select(each.alias("e")).select("e.*").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= ratio * F.col("n")
    named = words.join(nears, "word", "left").select(
        "word", F.when(fits, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, -F.col("best.less")).alias("form_n")
    )
    named = saved(named, "variant-forms")
    found = roots(named.where("form is not null").select("word", "form"))
    return named.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_groups(documents(spark, sf_dir))
