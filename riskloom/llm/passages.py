"""Operator 3: substring dedup by paragraph MinHash banding.

Near paragraphs. A paragraph is a line of min_run to long_line words. A line of more than
wide_line words can hold paragraphs that begin and end inside it, so there the smallest runs
of whole sentences of wide words or more are paragraphs too; they overlap, and none holds
another, so that two that overlap are never similar and a cluster can't creep along a text.
One word changed, added or dropped in wide words leaves a similarity of 0.8. (A run that stands at
just wide words in one text and at one less in the other can be missed.) Lines and runs are
compared among themselves. MinHash values of the five-word shingles of a paragraph form bands of
`rows` values; the number of bands is tuned so that a pair at the threshold meets with
probability recall. Paragraphs that meet are verified by exact Jaccard similarity of their
shingles. A bucket of at most PAIRED different paragraphs is compared pair by pair in joins; in a
larger one all are compared with the smallest, and then each with every other in blocks of BLOCK,
but for pairs that the distance to the smallest decides: those similar to it are linked already,
and one further from it than twice the allowed distance is similar to none of them. So
every similar pair of a bucket is linked, directly or by others. The work in a bucket of
many paragraphs that are not similar grows with the square of their number.
Components of the links are the clusters.

Equal sentences. Sentences of min_words words or more (a line end closes a sentence; a long
stretch without end marks is cut where a word's hash says so) meet by their hash. One with a
copy counts as a repeat where it stands in a run of such sentences of min_run words or more;
short lines that many documents share are left alone. Of each cluster of paragraphs or equal
sentences the first occurrence, by id and place, stays; all others are removals. Paragraphs are
numbered by negative even numbers, sentences from 0.

Equal passages of passage words or more that different texts share are found wherever they
begin and end, also inside sentences: hashes of seed words, one chosen by content in each
stretch of passage words, show where a text can have such a copy (winnowing: no equal passage
goes without one; of a seed that a text repeats every place counts). There the stretches of
passage words are compared by a rolling hash, and those that stand in an earlier document are
removals, joined where they overlap: a passage ends at the exact word. Such rows have no
number. Of exact copies of a text only one is searched that way against others. What a text
repeats inside itself is found the same way; all but the first go.

Both searches read the texts once to cut them, and then once more only the documents that
hold something to verify, which go out with the list of what is asked of them.

Rows with a NULL id and NULL or empty texts have no paragraphs and stay as they are. A row
is known by its id and its text: repeated rows are one document and do not remove each
other; an id with two texts is two documents. Other columns pass through. Paragraphs are
known by 64-bit hashes of their lower-case words, shingles by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, boxed, documents, dropped, saved, saved_apart, tidy, unboxed, where_last
from .components import components

#: Marks that end a sentence, and marks that may follow them.
STOPS, CLOSERS = ".!?…", "\"'”’»)]"
#: Rows of a table of two numbers, and of the table of clusters, that may be broadcast.
SMALL = 1_000_000
#: Buckets of up to this many different paragraphs are compared pair by pair.
PAIRED = 64
#: Paragraphs on one side of a block of a larger bucket.
BLOCK = 512
#: Pairs are verified in so many steps, since each sends the shingle sets of its pairs.
STEPS = 4
#: Characters of texts that a task cuts at once, about.
HELD = 500_000


@dataclass(frozen=True)
class Rules:
    min_words: int = 8
    #: Sentences beyond this many words are cut after a word whose hash ends in four zeros.
    long_words: int = 48
    shingle: int = 5
    threshold: float = 0.8
    recall: float = 0.98
    min_run: int = 30
    #: Equal passages of this many words are found at any word; by hashes of seed words.
    passage: int = 51
    seed: int = 20
    #: Words of a run of sentences that is a paragraph, of lines that have such runs, and of the
    #: longest line that is a paragraph itself.
    wide: int = 50
    wide_line: int = 100
    long_line: int = 200
    #: MinHash values of a band.
    rows: int = 2

    @property
    def bands(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold**self.rows))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Any odd number; powers of it and of its inverse are kept for texts of usual length.
BASE = 0x9E3779B97F4A7C15
USUAL = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), base, np.uint64)]))[:n]


POWERS, BACK = _powers(BASE, USUAL), _powers(pow(BASE, -1, 1 << 64), USUAL)


def run_hashes(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each run of values; the runs, none empty, are laid end to end."""
    if not len(sizes):
        return np.zeros(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    inside = np.arange(len(values)) - np.repeat(starts, sizes)
    most = int(sizes.max())
    power = POWERS if most <= USUAL else _powers(BASE, most)
    return _mix(np.add.reduceat((values + np.uint64(1)) * power[inside], starts) + sizes.astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, from the hashes of words."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    power, back = (POWERS, BACK) if n <= USUAL else (_powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:n])])
    return _mix((sums[k:] - sums[:-k]) * back[: n - k + 1])


def _ranges(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of a text, and where its words start and end."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    space = np.ones(len(points) + 2, np.int8)
    space[1:-1] = (points == 32) | ((points >= 9) & (points <= 13))
    edge = np.diff(space)
    return points, np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)


@dataclass
class Words:
    """Several texts in words and paragraphs, laid end to end."""

    start: np.ndarray  # the words' characters in their own text
    end: np.ndarray
    word: np.ndarray  # hashes of the lower-case words
    of: np.ndarray  # words before each text, and all words
    bound: np.ndarray  # words before each paragraph, and all words
    paras: np.ndarray  # paragraphs before each text, and all paragraphs
    lines: np.ndarray  # words before each line, and all words

    def sizes(self) -> np.ndarray:
        return np.diff(self.bound)


def cut_texts(texts: list[str], rules: Rules) -> Words:
    """The texts are joined by line feeds, which end words and sentences."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    offsets = np.cumsum(lengths + 1) - lengths - 1
    text = "\n".join(texts)
    points, start, end = _ranges(text)
    lower = text.lower()
    low, a, b = (points, start, end) if lower == text else _ranges(lower)
    sizes = b - a
    inside = np.repeat(a - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    word = run_hashes(low[inside].astype(np.uint64), sizes)
    of = np.append(np.searchsorted(start, offsets), len(start))
    bound, paras = _bounds(points, start, end, word, of, rules)
    own = np.repeat(offsets, np.diff(of))
    lines = np.unique(np.concatenate([[0], np.searchsorted(start, np.flatnonzero(points == 10)), [len(start)]]))
    return Words(start - own, end - own, word, of, bound, paras, lines)


STOP_POINTS, CLOSE_POINTS = (np.array([ord(c) for c in marks], np.uint32) for marks in (STOPS, CLOSERS))


def _one_of(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = x == values[0]
    for v in values[1:]:
        out |= x == v
    return out


def _sentence_ends(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The number of words up to the end of each sentence."""
    last = end - 1
    while (closing := _one_of(points[last], CLOSE_POINTS) & (last > start)).any():
        last = last - closing
    lines = np.flatnonzero(points == 10)
    after = np.append(start[1:], len(points))
    ends = _one_of(points[last], STOP_POINTS) | (np.searchsorted(lines, after) > np.searchsorted(lines, end))
    ends[-1:] = True
    return np.flatnonzero(ends) + 1


def _bounds(points: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray, of: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """bound and paras of Words."""
    ends = _sentence_ends(points, start, end)
    marks = np.flatnonzero(word & np.uint64(15) == 0) + 1
    cut = np.searchsorted(ends, of, "right").tolist()
    ends, out, paras = ends.tolist(), [0], [0]
    for d, n in enumerate(of[1:].tolist()):
        held = before = out[-1]
        for at in ends[cut[d] : cut[d + 1]]:
            if at - before > rules.long_words:
                if held < before:
                    out.append(before)
                    held = before
                for mark in marks[np.searchsorted(marks, before + 1) : np.searchsorted(marks, at, "right")].tolist():
                    if mark - held >= rules.min_words:
                        out.append(mark)
                        held = mark
            if at - held >= rules.min_words:
                out.append(at)
                held = at
            before = at
        if held < n:
            out.append(n)
        paras.append(len(out) - 1)
    return np.array(out), np.array(paras)


def wide_paragraphs(w: Words, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, last word + 1 and kind (0: lines, 1: runs of sentences) of the paragraphs."""
    begin, end = w.lines[:-1], w.lines[1:]
    whole = (end - begin >= rules.min_run) & (end - begin <= rules.long_line)
    cuts = np.union1d(w.bound, w.lines)
    at = np.searchsorted(cuts, cuts - rules.wide, "right") - 1  # the latest begin of a run that ends here
    line = np.maximum(np.searchsorted(w.lines, cuts) - 1, 0)
    last = w.lines[np.minimum(line + 1, len(w.lines) - 1)]
    runs = (at >= 0) & (cuts[at] >= w.lines[line]) & (last - w.lines[line] > rules.wide_line)
    runs &= np.append(True, at[1:] != at[:-1])  # the earliest end of a run that begins there
    a, b = np.concatenate([begin[whole], cuts[at[runs]]]), np.concatenate([end[whole], cuts[runs]])
    kind = np.concatenate([np.zeros(whole.sum(), np.uint64), np.ones(runs.sum(), np.uint64)])
    order = np.lexsort((kind, b, a))
    return a[order], b[order], kind[order]


def span_hashes(words: np.ndarray, a: np.ndarray, b: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """A hash of the words a to b - 1 and the kind."""
    n = len(words)
    power, back = (POWERS, BACK) if n < USUAL else (_powers(BASE, n + 1), _powers(pow(BASE, -1, 1 << 64), n + 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:n])])
    return _mix(_mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64)) + kind)


def band_keys(words: np.ndarray, a: np.ndarray, b: np.ndarray, kind: np.ndarray, rules: Rules) -> np.ndarray:
    """A key of each paragraph, of the words a to b - 1, for each band: from its least shingle
    hashes under `rows` mixings."""
    h = np.append(gram_hashes(words, rules.shingle), np.uint64(0))
    spans = np.stack([a, b - rules.shingle + 1], axis=1).reshape(-1)
    out = []
    for band in range(rules.bands):
        key = kind + np.uint64(band)
        for row in range(rules.rows):
            mixed = _mix(h ^ np.uint64(7919 * (1 + band * rules.rows + row) << 32))
            key = _mix(key * np.uint64(BASE) + np.minimum.reduceat(mixed, spans)[::2])
        out.append(key)
    return np.stack(out)


def _sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """The least of each span neighbours."""
    done = 1
    while done < span:
        step = min(done, span - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def _inside(of: np.ndarray, n: int, k: int) -> np.ndarray:
    """Whether a run of k words that starts at each of n places stays in its text."""
    out = np.zeros(n, bool)
    for a, b in zip(of[:-1].tolist(), (of[1:] - k + 1).tolist(), strict=True):
        out[a : max(a, b)] = True
    return out


def seeds(w: Words, rules: Rules) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts, places and hashes of the seeds: of the runs of seed words inside each stretch of
    passage words of a text, that of the smallest hash. And the texts that have equal ones."""
    h = gram_hashes(w.word, rules.seed)
    span = rules.passage - rules.seed + 1
    if len(h) < span:
        none = np.zeros(0, np.int64)
        return none, none, h[:0], none
    least = _sliding_min(h, span)
    least[~_inside(w.of, len(least), rules.passage)] = 0  # no stretch
    most = ~_sliding_min(~np.pad(least, span - 1), span)  # of the stretches that hold a run
    at = np.flatnonzero((most == h) & (most > 0))
    text = np.searchsorted(w.of, at, "right") - 1
    order = np.lexsort((at, h[at], text))
    at, text = at[order], text[order]
    again = np.append(False, (h[at[1:]] == h[at[:-1]]) & (text[1:] == text[:-1]))[: len(at)]
    return text, at - w.of[text], h[at], np.unique(text[again])


def own_repeats(start: np.ndarray, end: np.ndarray, word: np.ndarray, k: int) -> list[tuple[int, int, int, int, int, bool]]:
    """(first, last, words, gram, times, removed) of the passages of k words or more that a
    text repeats. A repeat that overlaps its own first occurrence leaves that whole."""
    h = gram_hashes(word, k)
    _, first, number, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    kept, n = first[number], times[number]
    out = []
    for removed in (False, True):
        at = np.flatnonzero((n > 1) & ((np.arange(len(h)) > kept) == removed))
        if not len(at):
            continue
        begin = np.maximum(at, kept[at] + k) if removed else at
        at, begin = at[begin < at + k], begin[begin < at + k]
        lead = np.flatnonzero(np.append(True, begin[1:] > at[:-1] + k - 1))
        tail = np.append(lead[1:], len(at)) - 1
        most = np.maximum.reduceat(n[at], lead)
        gram = h[at[lead]].view(np.int64)
        out += [(int(start[a]), int(end[b + k - 1]), int(b + k - a), int(g), int(m), removed) for a, b, g, m in zip(begin[lead], at[tail], gram, most, strict=True)]
    return out


def _parts(batch: pa.RecordBatch, rules: Rules) -> Iterator[tuple[np.ndarray, Words]]:
    """Rows of a batch, and their words; about HELD characters at a time."""
    rows, held, n = [], [], 0
    for k, text in enumerate(batch.column("text").to_pylist()):
        rows.append(k)
        held.append(text)
        n += len(text)
        if n > HELD:
            yield np.array(rows), cut_texts(held, rules)
            rows, held, n = [], [], 0
    if rows:
        yield np.array(rows), cut_texts(held, rules)


def _table(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """A batch of a schema; columns that are not given are NULL."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([_as(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _as(values: np.ndarray | pa.Array, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))


PIECES = "th long, no int, first int, last int, n_words int, pid long, keys array<long>, at int, seed long, gram long, times int, removed boolean"
VERIFIED = "th long, pid long, shingles array<long>, at int, first int, last int, gram long"


def _typed(docs: DataFrame, columns: str) -> str:
    return f"id {docs.schema['id'].dataType.simpleString()}, {columns}"


def cut_pieces(docs: DataFrame, rules: Rules) -> DataFrame:
    """docs: id, th, text. A row for each sentence (with pid), each paragraph (with pid and
    keys), each seed (with seed) and each passage that a text itself repeats (with times)."""
    kind = _typed(docs, PIECES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("id"), *(pa.field(f.split()[0], _arrow_type(f.split()[1])) for f in PIECES.split(", "))])
            for rows, w in _parts(batch, rules):
                if not len(w.word):
                    continue
                each, sizes = np.diff(w.paras), w.sizes()
                back = pa.array(np.repeat(rows, each))
                no = np.arange(len(sizes)) - np.repeat(w.paras[:-1], each)
                last = w.end[w.bound[1:] - 1]
                yield _table(
                    schema,
                    {
                        "id": batch.column("id").take(back),
                        "th": batch.column("th").take(back),
                        "no": no,
                        "first": np.where(no == 0, 0, np.append(0, last[:-1])),
                        "last": last,
                        "n_words": sizes,
                        "pid": run_hashes(w.word, sizes).view(np.int64),
                    },
                )
                a, b, kind_of = wide_paragraphs(w, rules)
                if len(a):
                    text = np.searchsorted(w.of, a, "right") - 1
                    left = np.searchsorted(text, text, "right") - np.arange(len(a))  # from here to the text's last
                    back = pa.array(rows[text])
                    yield _table(
                        schema,
                        {
                            "id": batch.column("id").take(back),
                            "th": batch.column("th").take(back),
                            "no": -2 * left,
                            "first": w.start[a],
                            "last": w.end[b - 1],
                            "n_words": b - a,
                            "pid": span_hashes(w.word, a, b, kind_of).view(np.int64),
                            "keys": _lists(band_keys(w.word, a, b, kind_of, rules).T.reshape(-1).view(np.int64), np.full(len(a), rules.bands)),
                        },
                    )
                text, at, seed, doubled = seeds(w, rules)
                back = pa.array(rows[text])
                yield _table(schema, {"id": batch.column("id").take(back), "th": batch.column("th").take(back), "at": at, "seed": seed.view(np.int64)})
                spans = [slice(*w.of[d : d + 2]) for d in doubled.tolist()]
                own = [(rows[d], *x) for d, part in zip(doubled, spans, strict=True) for x in own_repeats(w.start[part], w.end[part], w.word[part], rules.passage)]
                if own:
                    back, *columns = (pa.array(x) for x in zip(*own, strict=True))
                    yield _table(schema, {"id": batch.column("id").take(back), "th": batch.column("th").take(back)} | dict(zip(("first", "last", "n_words", "gram", "times", "removed"), columns, strict=True)))
        tidy()

    return docs.mapInArrow(cut, kind)


def _arrow_type(name: str) -> pa.DataType:
    return {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}[name]


def placed(paras: DataFrame, members: DataFrame) -> DataFrame:
    """pid, n, at and until (the first and the last place) and near (it shares a bucket) of
    the sentences that stand in several places and the paragraphs that share a bucket with others."""
    place = F.struct("id", "th", "no")
    near = members.select("pid").distinct().withColumn("near", F.lit(True))
    met = paras.groupBy("pid").agg(F.count("*").alias("n"), F.min(place).alias("at"), F.max(place).alias("until"))
    return saved(met.join(near, "pid", "left").where("near or (at <> until and at.no >= 0)"), "para-places")


def asked(places: DataFrame, found: DataFrame) -> DataFrame:
    """id, th, nos and spots: the paragraphs that share a bucket (the first place of each) and
    the seeds that other texts share, which the second reading of a document looks at."""
    nos = places.where("near").select("at.id", "at.th", "at.no", F.lit(None).cast("int").alias("at"))
    again = saved(found.groupBy("seed").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b").select("seed"), "passage-seeds")
    met = found.join(F.broadcast(again) if again.count() <= SMALL else again, "seed")
    spots = met.groupBy("th", "at").agg(F.min("id").alias("id")).select("id", "th", F.lit(None).cast("int").alias("no"), "at")
    return nos.unionAll(spots).groupBy("id", "th").agg(F.collect_list("no").alias("nos"), F.collect_list("at").alias("spots"))


def verified(docs: DataFrame, asks: DataFrame, rules: Rules) -> DataFrame:
    """Shingles (sorted distinct hashes) of the paragraphs that are asked for, and the hashes of
    all stretches of passage words around the seeds, the first of equal ones."""
    kind = _typed(docs, VERIFIED)
    k = rules.passage

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field("id"), *(pa.field(f.split()[0], _arrow_type(f.split()[1])) for f in VERIFIED.split(", "))])
            nos, spots = (batch.column(c).to_pylist() for c in ("nos", "spots"))
            for rows, w in _parts(batch, rules):
                if any(nos[row] for row in rows.tolist()):
                    a, b, kind_of = wide_paragraphs(w, rules)
                    after = np.searchsorted(a, w.of[1:])  # paragraphs up to the end of each text
                    picked = np.sort(np.array([after[d] + no // 2 for d, row in enumerate(rows.tolist()) for no in nos[row]], np.int64))
                    a, b, kind_of = a[picked], b[picked], kind_of[picked]
                    counts = b - a - rules.shingle + 1
                    owner = np.repeat(np.arange(len(a)), counts)
                    h = gram_hashes(w.word, rules.shingle)[np.repeat(a - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
                    order = np.lexsort((h.view(np.int64), owner))
                    h, owner = h[order], owner[order]
                    fresh = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))
                    yield _table(schema, {"pid": span_hashes(w.word, a, b, kind_of).view(np.int64), "shingles": _lists(h[fresh].view(np.int64), np.bincount(owner[fresh], minlength=len(a)))})
                found = [(d, at + w.of[d]) for d, row in enumerate(rows.tolist()) for at in spots[row]]
                if found:
                    text, at = (np.array(x) for x in zip(*found, strict=True))
                    h = gram_hashes(w.word, k)
                    at = (at[:, None] - np.arange(k - rules.seed + 1)).reshape(-1)
                    text = np.repeat(text, k - rules.seed + 1)
                    inside = (at >= w.of[text]) & (at + k <= w.of[text + 1])
                    at, text = at[inside], text[inside]
                    order = np.lexsort((at, h[at], text))
                    at, text = at[order], text[order]
                    first = np.append(True, (h[at[1:]] != h[at[:-1]]) | (text[1:] != text[:-1]))[: len(at)]
                    at, text = at[first], text[first]
                    back = pa.array(rows[text])
                    yield _table(schema, {"id": batch.column("id").take(back), "th": batch.column("th").take(back), "at": at - w.of[text], "first": w.start[at], "last": w.end[at + k - 1], "gram": h[at].view(np.int64)})
        tidy()

    return docs.join(asks, ["id", "th"]).dropDuplicates(["id", "th"]).select("id", "th", "text", "nos", "spots").mapInArrow(read, kind)


def _spanning(alike: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of links that connect what the true cells of alike connect."""
    seen_row, seen_col = np.zeros(alike.shape[0], bool), np.zeros(alike.shape[1], bool)
    rows, cols = [], []
    for r in range(len(alike)):
        front = np.zeros(0, int) if seen_row[r] else np.array([r])
        while len(front):
            seen_row[front] = True
            reached = np.flatnonzero(alike[front].any(0) & ~seen_col)
            seen_col[reached] = True
            rows.append(np.full(len(reached), r))
            cols.append(reached)
            front = np.flatnonzero(alike[:, reached].any(1) & ~seen_row)
            rows.append(front)
            cols.append(np.full(len(front), reached[0] if len(reached) else 0))
    return np.concatenate([np.zeros(0, int), *rows]), np.concatenate([np.zeros(0, int), *cols])


def alike_in_block(table: pa.Table, threshold: float) -> pa.Table:
    """table: pid, shingles and side of the paragraphs of a block. Links that connect all
    similar pairs of a paragraph of side 0 and one of side 1 (of side 0 where there is no 1)."""
    pid, side = table.column("pid").to_numpy(), table.column("side").to_numpy()
    sets = table.column("shingles").combine_chunks()
    size = sets.value_lengths().to_numpy().astype(np.int64)
    _, at, often = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
    met = (often > 1)[at]
    row, col = np.repeat(np.arange(len(size)), size)[met], (np.cumsum(often > 1) - 1)[at][met]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if (side == 1).any() else left
    shared = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for start in range(0, int((often > 1).sum()), 4096):
        part = slice(*np.searchsorted(col, (start, start + 4096)))
        has = np.zeros((len(size), 4096), np.float32)
        has[row[part], col[part] - start] = 1
        shared += has[left] @ has[right].T
    shared = shared.astype(np.int64)
    a, b = _spanning(shared >= threshold * (size[left][:, None] + size[right][None, :] - shared))
    a, b = pid[left[a]], pid[right[b]]
    return pa.table({"a": pa.array(np.minimum(a, b)[a != b]), "b": pa.array(np.maximum(a, b)[a != b])})


def large_links(large: DataFrame, sets: DataFrame, rules: Rules) -> DataFrame:
    """a, b: links that connect all similar pairs within buckets. large: key, pid and lead,
    the smallest pid of the bucket."""
    both = large.join(sets, "pid").join(sets.select(F.col("pid").alias("lead"), F.col("shingles").alias("of_lead")), "lead")
    # Rings: similar to the lead, near enough to be similar to such a one, and the others.
    # 1 - Jaccard is a metric, so what lies further apart than the threshold allows twice
    # needs no comparison.
    common, either = F.size(F.array_intersect("shingles", "of_lead")), F.size(F.array_union("shingles", "of_lead"))
    ring = F.when(common >= rules.threshold * either, 0).when(common >= (2 * rules.threshold - 1 - 1e-9) * either, 1).otherwise(2)
    placed = saved(both.select("key", "pid", "lead", "shingles", ring.alias("ring")), "para-rings")
    n = lambda cond: F.greatest(F.ceil(F.count(F.when(cond, 1)) / BLOCK), F.lit(1)).cast("int")
    blocks = placed.groupBy("key").agg(n(F.col("ring") == 0).alias("n0"), n(F.col("ring") == 1).alias("n1"), n(F.col("ring") > 0).alias("n2"), F.count(F.when(F.col("ring") == 1, 1)).alias("near"))
    rows = placed.join(blocks, "key")
    own = lambda count: F.pmod(F.xxhash64("pid"), F.col(count)).cast("int")
    unit = lambda u, v, side: F.struct(u.alias("u"), v.alias("v"), side.alias("side"))
    others = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    rest = F.transform(others("n2"), lambda k: unit(F.least(own("n2"), k), F.greatest(own("n2"), k), (own("n2") > k).cast("int")))
    far = F.when(F.col("near") > 0, F.transform(others("n1"), lambda k: unit(-1 - own("n0"), k, F.lit(0))))
    close = F.transform(others("n0"), lambda k: unit(-1 - k, own("n1"), F.lit(1)))
    dealt = F.when(F.col("ring") == 0, far).when(F.col("ring") == 1, F.concat(rest, close)).otherwise(rest)
    units = rows.select("key", "pid", "shingles", F.inline(dealt))
    threshold = rules.threshold
    found = units.groupBy("key", "u", "v").applyInArrow(lambda t: alike_in_block(t, threshold), "a long, b long")
    return placed.where("ring = 0 and lead <> pid").select(F.col("lead").alias("a"), F.col("pid").alias("b")).unionAll(found)


def bucketed(paras: DataFrame) -> DataFrame:
    """key, pid: the buckets that hold different paragraphs."""
    keyed = paras.select(F.explode("keys").alias("key"), "pid")
    shared = saved(keyed.groupBy("key").agg(F.min("pid").alias("lead"), F.max("pid").alias("most")).where("lead < most").select("key"), "para-buckets")
    few = shared.count() <= SMALL
    members = saved(keyed.join(F.broadcast(shared) if few else shared, "key").distinct(), "para-members")
    dropped(shared)
    return members


def near_links(members: DataFrame, sets: DataFrame, rules: Rules) -> DataFrame:
    """a, b: links between the hashes of different paragraphs; they connect all pairs that
    share a bucket and are similar enough."""
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("pid").alias("lead")).where("n > 1")
    placed = members.join(sizes, "key")
    little, large = placed.where(F.col("n") <= PAIRED).select("key", "pid"), placed.where(F.col("n") > PAIRED)
    pairs = little.select("key", F.col("pid").alias("lead")).join(little, "key").where("lead < pid").select("lead", "pid").distinct()
    pairs = saved(pairs, "para-pairs")
    alike = F.size(F.array_intersect("shingles", "of_lead")) >= rules.threshold * F.size(F.array_union("shingles", "of_lead"))
    good = []
    for k in range(STEPS):  # a step's shuffles are given back before the next
        mine = lambda c, k=k: F.pmod(F.xxhash64(c), F.lit(STEPS)) == k
        leads = sets.where(mine("pid")).select(F.col("pid").alias("lead"), F.col("shingles").alias("of_lead"))
        both = pairs.where(mine("lead")).join(sets, "pid").join(leads, "lead")
        good.append(saved(both.where(alike).select(F.col("lead").alias("a"), F.col("pid").alias("b")), "para-alike"))
    dropped(pairs)
    good.append(saved(large_links(large.select("key", "pid", "lead"), sets, rules), "para-alike"))
    return saved(reduce(DataFrame.unionAll, good), "para-links")


def equal_passages(grams: DataFrame, rules: Rules) -> DataFrame:
    """grams: id, th, at, first, last, gram, no gram twice in a text. The passages of at least
    rules.passage words that stand in several texts."""
    doc = F.struct("id", "th")
    total = grams.groupBy("gram").agg(F.count("*").alias("n"), F.min(doc).alias("kept"), F.max(doc).alias("until")).where("kept <> until").drop("until")
    met = grams.join(total, "gram").withColumn("removed", doc != F.col("kept"))
    by_place = Window.partitionBy("id", "th", "removed").orderBy("at")
    apart = (F.col("first") > F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1))).cast("int")
    joined = met.withColumn("apart", F.coalesce(apart, F.lit(0))).withColumn("part", F.sum("apart").over(by_place))
    return joined.groupBy("id", "th", "removed", "part").agg(
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        (F.max("at") + rules.passage - F.min("at")).cast("int").alias("n_words"),
        F.min_by("gram", "at").alias("cluster"),
        F.max("n").alias("cluster_size"),
        F.min_by("kept.id", "at").alias("first_id"),
    )


def repeats(docs: DataFrame, rules: Rules = Rules(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each repeated paragraph: id, th (hash of the text), no, first and last (its
    characters), n_words, cluster, cluster_size, first_id and removed. Then the equal
    passages, with a NULL no."""
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).where("id is not null and text is not null")
    kind = F.when(F.col("keys").isNotNull(), "paras").when(F.col("pid").isNotNull(), "sentences").when(F.col("seed").isNotNull(), "seeds").otherwise("own")
    pieces = saved_apart(cut_pieces(rows, rules), "pieces", kind, ["paras", "sentences", "seeds", "own"])
    members = bucketed(pieces["paras"].select("keys", "pid"))
    spots = ["id", "th", "no", "first", "last", "n_words", "pid"]
    wide = saved(pieces["paras"].join(members.select("pid").distinct(), "pid", "left_semi").select(*spots), "para-wide")
    dropped(pieces["paras"])
    paras, found = pieces["sentences"].select(*spots).unionAll(wide), pieces["seeds"].select("id", "th", "at", "seed")
    places = placed(paras, members)
    second = saved(verified(rows, asked(places, found), rules), "verified")
    dropped(pieces["seeds"])
    sets, grams = second.where("pid is not null").select("pid", "shingles"), second.where("gram is not null").select("id", "th", "at", "first", "last", "gram")
    links = near_links(members, sets, rules)
    dropped(members)
    reached = components(links, label="para-links")
    roots = reached.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    named = saved(reached.unionAll(roots), "para-components").select(F.col("node").alias("pid"), F.col("component").alias("cluster"))
    dropped(links)
    met = places.join(named, "pid", "left").where("(at <> until and at.no >= 0) or cluster is not null").select("pid", "n", "at", "until", F.coalesce("cluster", "pid").alias("cluster"))
    total = met.groupBy("cluster").agg(F.sum("n").alias("cluster_size"), F.min("at").alias("kept"), F.max("until").alias("until")).where("kept <> until")
    held = saved(met.select("pid", "cluster").join(total.drop("until"), "cluster"), "para-clusters")
    dropped(places)
    n = held.count()
    met = paras
    if n <= SMALL:  # hashes alone are broadcast, to leave out what has no copy before the shuffle
        met = met.join(F.broadcast(held.select("pid")), "pid", "left_semi")
    each = met.join(held, "pid").distinct()
    by_place = Window.partitionBy("id", "th").orderBy("no")
    runs = each.withColumn("run", F.col("no") - F.row_number().over(by_place))
    runs = runs.withColumn("run_words", F.sum("n_words").over(Window.partitionBy("id", "th", "run"))).where(F.col("run_words") >= rules.min_run)
    removed = F.struct("id", "th", "no") != F.col("kept")
    of_paragraphs = runs.select(
        F.col("id").alias(id), "th", "no", "first", "last", "n_words", "cluster", "cluster_size", F.col("kept.id").alias("first_id"), removed.alias("removed")
    )
    own = pieces["own"].select(
        F.col("id").alias(id), "th", F.lit(None).cast("int").alias("no"), "first", "last", "n_words", F.col("gram").alias("cluster"), F.col("times").cast("long").alias("cluster_size"), F.col("id").alias("first_id"), "removed"
    )
    first = saved(of_paragraphs.unionAll(own.distinct()), "repeated-paragraphs")
    for done in (pieces["sentences"], pieces["own"], wide, held):
        dropped(done)
    equal = equal_passages(grams, rules).withColumn("no", F.lit(None).cast("int")).withColumnRenamed("id", id)
    then = saved(equal.select(*first.columns), "repeated-passages")
    dropped(second)
    return first.unionAll(then)


@F.arrow_udf(T.StringType())
def without(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Texts without the given character ranges, which are in order and may overlap."""
    for texts, ranges in batches:
        out = []
        for text, cuts in zip(texts.to_pylist(), ranges.to_pylist(), strict=True):
            if cuts and text is not None:
                parts, at = [], 0
                for c in cuts:
                    parts.append(text[at : c["first"]])
                    at = max(at, c["last"])
                text = "".join([*parts, text[at:]]).strip(" \t\n\r\x0b\x0c")
            out.append(text)
        yield pa.array(out, pa.string())
    tidy()


def substring_dedup(docs: DataFrame, rules: Rules = Rules(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without their repeated paragraphs. A document that has no word left is dropped."""
    gone = repeats(docs, rules, id, text).where("removed").groupBy(F.col(id).alias("_i"), F.col("th").alias("_t"))
    cuts = gone.agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("_cuts"))
    keyed = boxed(docs, F.col(id).alias("_i"), F.xxhash64(text).alias("_t"), F.col(text).alias("_text"))
    cut = keyed.join(cuts, ["_i", "_t"], "left").withColumn("_left", F.when(F.col("_cuts").isNull(), F.col("_text")).otherwise(without(F.col("_text"), F.col("_cuts"))))
    cut = where_last(cut, F.col("_cuts").isNull() | F.col("_left").rlike(WORD))
    return unboxed(cut, docs, **{text: F.col("_left"), "n_chars": F.length("_left")})


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir)).drop("th")
