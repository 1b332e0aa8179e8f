"""Operator 9: document fingerprints as invertible Bloom lookup sketches, in DataFrame
functions only.

A text is cut into passages: its lines, and lines at fixed word counts (the first line
finer, so that a short text has several). The digests of its distinct passages go into
three cells each of the text's own sketch, whose cells hold a count, the exclusive-or of
digests and of their checks. The fingerprint string is that sketch: the number of digests,
the cells of a third, and its cells in base 64. A third has a power of two of cells, enough
for an edit of a quarter of the text to be recovered.

Two texts are compared by their sketches alone: the larger is folded to the size of the
smaller, cells are subtracted, which leaves the digests that one side has alone, and peeling
takes a digest out of every cell that holds just one, until none is left. It recovers the
differing digests themselves. Where it doesn't end, both texts get sketches large enough
for all their digests, then twice as large with other hashes, until it does.
likeness = 1 - differing digests / digests of both sides.

NULL and empty texts have no passage; two of them have likeness 1. NULL ids come last in
the order of ids; rows that repeat an id are ordered by text. A single row is followed by
itself. An empty table gives no rows. Passages that a text repeats count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, saved, whole

#: Words of a passage, and where the passages of a first line start.
PASSAGE, FINE = 32, ((1, 2), (3, 2), (5, 4), (9, 8), (17, 16))
#: Cells of a third for each digest, in a fingerprint and where all digests may differ; and the fewest.
CELLS, MORE_CELLS, LEAST = 0.3, 0.6, 4
#: Rows of a range of ids, about; and quantiles of ids that are held at most.
RANGE_ROWS, QUANTILES = 2000, 1024
#: Peeling steps of an attempt; each takes the single digests of one third of the cells.
STEPS = 12


def passages(text: Column) -> Column:
    """array<long>: digests of the distinct passages of a text."""
    words = F.filter(
        F.transform(F.split(text, "\n"), lambda line: F.array_remove(F.split(F.regexp_replace(line, r"[\x09\x0B-\x0D]", " "), " "), "")),
        lambda w: F.size(w) > 0,
    )

    def cut(w: Column, k: Column) -> Column:
        even = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(w) - 1) / PASSAGE).cast("int")), lambda i: F.xxhash64(F.slice(w, i * PASSAGE + 1, PASSAGE))
        )
        at, length = (F.array(*(F.lit(x[n]) for x in FINE)) for n in (0, 1))
        fine = F.transform(
            F.filter(F.arrays_zip(at.alias("a"), length.alias("n")), lambda x: x["a"] <= F.size(w)), lambda x: F.xxhash64(F.slice(w, x["a"], x["n"]))
        )
        rest = F.when(
            F.size(w) > PASSAGE, F.transform(F.sequence(F.lit(1), F.floor((F.size(w) - 1) / PASSAGE).cast("int")), lambda i: F.xxhash64(F.slice(w, i * PASSAGE + 1, PASSAGE)))
        ).otherwise(F.array().cast("array<bigint>"))
        return F.when(k == 0, F.concat(fine, rest)).otherwise(even)

    return F.array_distinct(F.flatten(F.transform(words, cut)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def _cell(digest: Column, part: int, seed: Column | int, size: Column) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(part), F.lit(seed) if isinstance(seed, int) else seed), size)


def third(n: Column, share: float) -> Column:
    """Cells of a third of a sketch for n digests: a power of two."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n * share, F.lit(float(LEAST)))))).cast("long")


def sketched(texts: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """texts: keys, digests, size (cells of a third). The cells in use of each text's sketch:
    keys, size, part, cell, n, key, check."""
    key = F.col("key")
    thirds = F.array(*(F.struct(F.lit(p).alias("part"), _cell(key, p, seed, F.col("size")).alias("cell")) for p in range(3)))
    each = texts.select(*keys, "size", F.explode("digests").alias("key")).withColumn("check", _check(key))
    cells = each.select(*keys, "size", "key", "check", F.inline(thirds))
    return cells.groupBy(*keys, "size", "part", "cell").agg(F.count("*").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))


def sketch_strings(texts: DataFrame, keys: list[str]) -> DataFrame:
    """texts: keys, digests, size. keys and the fingerprint of each text that has digests,
    without its count."""
    cells = sketched(texts, keys, 0)
    wide = lambda c, n: F.right(F.lpad(F.hex(c), 16, "0"), F.lit(n))
    shown = F.concat(wide(F.col("part") * F.col("size") + F.col("cell"), 8), wide(F.col("n"), 4), wide(F.col("key"), 16), wide(F.col("check"), 4))
    all_cells = cells.groupBy(*keys, "size").agg(F.sort_array(F.collect_list(shown)).alias("cells"))
    return all_cells.select(*keys, F.concat(F.col("size").cast("string"), F.lit(":"), F.base64(F.unhex(F.array_join("cells", "")))).alias("sketch"))


def peeled(pairs: DataFrame, seed: int) -> DataFrame:
    """pairs: pair, a and b (digest arrays), size_a and size_b (cells of a third of either's
    sketch; the smaller divides the larger). What is left of the subtracted sketches after
    peeling: rows of part 3 and 4 are recovered digests (key) that only a or b has, others are
    cells that did not peel."""
    side = lambda sign, digests, size: F.struct(F.lit(sign).cast("long").alias("sign"), F.col(digests).alias("digests"), F.col(size).alias("size"))
    texts = pairs.select("pair", F.least("size_a", "size_b").alias("fold"), F.inline(F.array(side(1, "a", "size_a"), side(-1, "b", "size_b"))))
    own = sketched(texts, ["pair", "fold", "sign"], seed)
    key = F.col("key")

    def summed(df: DataFrame) -> DataFrame:
        out = df.groupBy("pair", "size", "part", "cell").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("check").alias("check"))
        return out.where("part > 2 or n <> 0 or key <> 0 or check <> 0")

    # A power of two as size: what is left of a cell number by the smaller size is the cell there.
    cells = summed(own.select("pair", F.col("fold").alias("size"), "part", (F.col("cell") % F.col("fold")).alias("cell"), (F.col("n") * F.col("sign")).alias("n"), "key", "check"))
    for step in range(STEPS):
        part = step % 3
        single = (F.col("part") == part) & (F.abs("n") == 1) & (F.col("check") == _check(key))
        row = lambda p, c, n, k, x: F.struct(
            F.lit(p).alias("part") if isinstance(p, int) else p.alias("part"), c.cast("long").alias("cell"), n.alias("n"), k.alias("key"), x.alias("check")
        )
        out = [row(p, _cell(key, p, seed, F.col("size")), -F.col("n"), key, F.col("check")) for p in range(3) if p != part]
        found = row(F.when(F.col("n") > 0, 3).otherwise(4), key, F.lit(1).cast("long"), key, F.lit(0).cast("long"))
        same = row(F.col("part"), F.col("cell"), F.col("n"), key, F.col("check"))
        cells = summed(cells.select("pair", "size", F.inline(F.when(single, F.array(*out, found)).otherwise(F.array(same)))))
    return cells.select("pair", "part", "key")


def likeness(left: Column, right: Column, a: Column, b: Column) -> Column:
    return F.when(a + b == 0, 1.0).otherwise(1.0 - (left + right) / (a + b).cast("double"))


def compared(pairs: DataFrame, seed: int) -> DataFrame:
    """pairs as in peeled(), dealt out by pair. One saved row for each: pair, like, n_left and
    n_right (recovered digests of either side), failed; the first three are NULL where peeling
    failed."""
    count = lambda p: F.sum((F.col("part") == p).cast("long"))
    left = peeled(pairs, seed).groupBy("pair").agg(count(3).alias("n_left"), count(4).alias("n_right"), F.max(F.col("part") < 3).alias("failed"))
    met = pairs.select("pair", F.size("a").alias("n_a"), F.size("b").alias("n_b")).join(left, "pair", "left")
    failed = F.coalesce("failed", F.lit(False))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    good = lambda value: F.when(~failed, value)
    like = likeness(n("n_left"), n("n_right"), F.col("n_a"), F.col("n_b"))
    return saved(met.select("pair", good(like).alias("like"), good(n("n_left")).alias("n_left"), good(n("n_right")).alias("n_right"), failed.alias("failed")), "sketch-differences")


def sized(pairs: DataFrame, size: Column) -> DataFrame:
    return pairs.withColumns({"size_a": size, "size_b": size})


def retried(failed: DataFrame) -> DataFrame:
    """failed: pair, a, b, size. The rows of compared() for every pair, with sketches that double
    until they peel."""
    done, seed = None, 1
    while True:
        tried = failed.withColumn("size", F.greatest(F.col("size") * 2, F.lit(16)))
        result = compared(sized(tried, F.col("size")), seed)
        good = result.where("not failed")
        done = good if done is None else done.unionAll(good)
        left = result.where("failed").select("pair")
        if left.isEmpty():
            return done
        failed, seed = tried.join(left, "pair", "left_semi"), seed + 1


def differences(pairs: DataFrame, size: Column | int, seed: int = 1) -> DataFrame:
    """pairs: pair, a, b. pair, side (left or right) and digest: the digests that one side has
    alone, recovered from sketches with size cells in a third. Pairs that do not peel at that
    size have no row; retried() tells them by their likeness."""
    rest = peeled(sized(pairs, F.lit(size) if isinstance(size, int) else size), seed)
    failed = rest.where("part < 3").select("pair").distinct()
    return rest.join(failed, "pair", "left_anti").select("pair", F.when(F.col("part") == 3, "left").otherwise("right").alias("side"), F.col("key").alias("digest"))


def _place(quantiles: Column, steps: int, value: Column) -> Column:
    """The last place of an ascending array whose element is value or less; 0 if none is."""

    down = F.sequence(F.lit(steps - 1), F.lit(0), F.lit(-1))
    half = lambda at, k: at + F.pow(F.lit(2), k).cast("int")
    return F.aggregate(down, F.lit(0), lambda at, k: F.when(F.get(quantiles, half(at, k)) <= value, half(at, k)).otherwise(at))


def _quantiles(id: str, parts: int) -> Column:
    return F.percentile_approx(id, [k / parts for k in range(parts)], 10 * QUANTILES)


def ranges(docs: DataFrame, id: str) -> DataFrame:
    """docs with range: ids in ascending ranges of about RANGE_ROWS rows (more, where that would
    make over QUANTILES ** 2 of them), cut at quantiles and again at the quantiles between those.
    NULL ids come last."""
    n = docs.count()
    cuts = min(QUANTILES, max(1, n // RANGE_ROWS))
    inside = min(QUANTILES, max(1, n // (cuts * RANGE_ROWS)))
    first = docs.agg(_quantiles(id, cuts).alias("q")).first().q or [0]
    placed = docs.withColumn("_at", _place(F.lit(first), cuts.bit_length(), F.col(id)))
    part = F.lit(0)
    if inside > 1:  # at most QUANTILES rows of as many numbers
        finer = saved(placed.where(F.col(id).isNotNull()).groupBy("_at").agg(_quantiles(id, inside).alias("_q")), "sketch-ranges")
        placed = placed.join(F.broadcast(finer), "_at", "left")
        part = F.coalesce(_place(F.col("_q"), inside.bit_length(), F.col(id)), F.lit(0))
    return placed.select(*docs.columns, F.when(F.col(id).isNull(), cuts * inside).otherwise(F.col("_at") * inside + part).cast("long").alias("range"))


def followed(docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """docs (id, text) with next_text, range and at: each row with the text of the row
    after it by id. Rows meet their successor in ranges of ids; each range is closed by
    a row that brings the first text of the range after it."""
    ranged = ranges(docs, id)
    heads = ranged.groupBy("range").agg(F.min(id).alias("head"))
    order = Window.orderBy("range")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = heads.select("range", F.coalesce(F.lead("range").over(order), F.first("range").over(every)).alias("next_range"))
    after = after.join(heads.select(F.col("range").alias("next_range"), "head"), "next_range")
    # At most QUANTILES ** 2 + 1 rows, so that no text is shuffled to find the first ones.
    first = ranged.join(F.broadcast(after.select(F.col("range").alias("closed"), "next_range", "head")), (F.col("range") == F.col("next_range")) & F.col(id).eqNullSafe(F.col("head")))
    closing = first.groupBy(F.col("closed").alias("range")).agg(F.min("text").alias("text"))
    rows = ranged.select("range", F.lit(0).alias("closing"), id, "text").unionAll(closing.select("range", F.lit(1), F.lit(None).cast(docs.schema[id].dataType), "text"))
    own = Window.partitionBy("range").orderBy("closing", F.col(id).asc_nulls_last(), "text")
    return rows.withColumns({"next_text": F.lead("text").over(own), "at": F.row_number().over(own)}).where("closing = 0").drop("closing")


def version_fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_lost
    and n_added: how many digests peeling recovers that the text or its edited form has alone."""
    rows = followed(docs.select(id, whole(text).alias("text")), id)
    quarter = F.expr("cast(floor(n_chars / 4) as int)")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - quarter).cast("int")), F.substring("next_text", F.lit(1), quarter)))
    # One table with a row's digests, so that the texts are shuffled once. From it, pairs are
    # dealt out once for each attempt; the cells of a pair are summed and peeled where it lies.
    made = saved(
        rows.select(
            (F.col("range") * 2**31 + F.col("at")).alias("rid"), id, "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
            passages(F.col("text")).alias("own"), passages(F.col("edited")).alias("ed"), passages(F.col("next_text")).alias("nx"),
        ),
        "sketch-rows",
    )
    pair = lambda kind, other: F.struct((F.col("rid") * 2 + kind).alias("pair"), F.col(other).alias("b"))
    pairs = made.select(F.col("own").alias("a"), F.inline(F.array(pair(0, "ed"), pair(1, "nx"))))
    first = compared(pairs.repartition("pair").withColumns({f"size_{x}": third(F.size(x), CELLS) for x in "ab"}), 0)
    wanted = pairs.join(first.where("failed").select("pair"), "pair", "left_semi")
    again = retried(wanted.withColumn("size", F.floor(third(F.size("a") + F.size("b"), MORE_CELLS) / 2)))
    of = lambda kind, c: F.max(F.when(F.col("pair") % 2 == kind, F.col(c)))
    found = first.where("not failed").unionAll(again).groupBy(F.floor(F.col("pair") / 2).alias("rid")).agg(
        of(0, "like").alias("near_edited"), of(1, "like").alias("near_next"), of(0, "n_left").alias("n_lost"), of(0, "n_right").alias("n_added")
    )
    text_of = lambda side, digests: F.struct((F.col("rid") * 2 + side).alias("side"), F.col(digests).alias("digests"), third(F.size(digests), CELLS).alias("size"))
    texts = made.select(F.inline(F.array(text_of(0, "own"), text_of(1, "ed")))).repartition("side")
    of_side = lambda k: F.max(F.when(F.col("side") % 2 == k, F.col("sketch"))).alias(f"s{k}")
    strings = sketch_strings(texts, ["side"]).groupBy(F.floor(F.col("side") / 2).alias("rid")).agg(of_side(0), of_side(1))
    shown = made.select("rid", id, "n_chars", "edited_sha256", F.size("own").alias("n_own"), F.size("ed").alias("n_ed"))
    string = lambda n, s: F.concat(F.col(n).cast("string"), F.lit(":"), F.coalesce(s, F.lit("0:")))
    return shown.join(found, "rid").join(strings, "rid", "left").select(
        id, "n_chars", "edited_sha256", string("n_own", "s0").alias("fingerprint"), string("n_ed", "s1").alias("edited_fingerprint"), "near_edited", "near_next", "n_lost", "n_added"
    )


def op9_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_fingerprints(documents(spark, sf_dir))
