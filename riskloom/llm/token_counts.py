"""Operator 7: token counts by a map-side lookup in two tiers.

A text is cut where no vocabulary piece crosses: before each run of spaces and around
line feeds. Tier one is a broadcast table of the token counts of frequent pre-tokens; its
size is fixed by table_size. Tier two is a bounded cache in each Python worker, filled by
encoding what tier one misses. No pre-token is shuffled.

The table only saves work: it is taken from at most sample_rows rows, and no count
depends on what it holds. That no piece of the model crosses a cut is checked when the
model is loaded, and a model where one does is refused.

NULL and empty texts have 0 tokens. Rows are counted alone: repeated rows count alike,
other columns pass through, and a text of any length is counted whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _read
from .common import documents, tidy, whole

SPACE = "▁"
PIECE = regex.compile(r" *[^ \n]+| +|\n")


class Tier(dict):
    """Word to the tokens of lead + word: the frequent ones, and those met since."""

    def __init__(self, counts: "Counts", lead: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.counts, self.lead, self.frequent = counts, lead, frequent

    def __missing__(self, word: str) -> int:
        n = self.counts.once(self.lead + word)
        if len(word) <= 64:
            if len(self) >= self.counts.most:
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n


class Counts:
    def __init__(self, model: bytes, frequent: dict[str, int], cached: int):
        import sentencepiece

        self.most = len(frequent) + cached
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.lead = len(self.model.encode("\n"))
        self.spaced = Tier(self, " ", {p[1:]: n for p, n in frequent.items() if p[0] == " "})
        self.bare = Tier(self, "", {p: n for p, n in frequent.items() if p[0] != " "})
        plain = lambda i: not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if plain(i)]
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces):
            raise ValueError("a piece of this model crosses a cut")
        if self.lead != 2 or len(self.model.encode("a  b\nc ")) != sum(self.once(p) for p in PIECE.findall(" a  b\nc ")):
            raise ValueError("this model rewrites white space")

    def once(self, piece: str) -> int:
        # A line feed first: then the space that the library puts before a text stands alone.
        return len(self.model.encode("\n" + piece)) - self.lead

    def of(self, text: str) -> int:
        if not text:
            return 0
        n = 0
        for k, line in enumerate((" " + text.replace(SPACE, " ")).split("\n")):
            n += k > 0
            if not line:
                continue
            if "  " in line or line[-1] == " ":  # a run of spaces is one pre-token with the word after it
                n += sum(self.spaced[p[1:]] if p[0] == " " else self.bare[p] for p in PIECE.findall(line))
                continue
            first, *rest = line.split(" ")
            n += sum(map(self.spaced.__getitem__, rest)) + (self.bare[first] if first else 0)
        return n


_made: dict[tuple, Counts] = {}


def _worker(shared, path: str, cached: int) -> Counts:
    key = (path, len(shared.value[1]), cached)
    if key not in _made:
        _made.clear()
        _made[key] = Counts(*shared.value, cached)
    return _made[key]


def frequent_pieces(docs: DataFrame, text: str, sample_rows: int, table_size: int, per_task: int = 4096) -> list[str]:
    """The commonest pre-tokens of a bounded sample; each task sends per_task at most."""
    rows = docs.count()
    part = docs.select(whole(text).alias("t")).sample(min(1.0, sample_rows / max(rows, 1)), seed=7).limit(sample_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(p for p in PIECE.findall(" " + t.replace(SPACE, " ")) if len(p) <= 64)
            if len(seen) > 50 * per_task:
                seen = Counter(dict(seen.most_common(10 * per_task)))
        common = seen.most_common(per_task)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in common], pa.string()), pa.array([n for _, n in common], pa.int64())], ["piece", "n"])

    found = part.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r[0] for r in found.orderBy(F.desc("n"), "piece").limit(table_size).collect()]


def token_count(docs: DataFrame, model_path: str, text: str = "text", sample_rows: int = 2000, table_size: int = 16_384, cached: int = 500_000) -> Column:
    """long: the number of tokens of a text."""
    model = _read(model_path)
    once = Counts(model, {}, cached)
    table = {p: once.once(p) for p in frequent_pieces(docs, text, sample_rows, table_size)}
    shared = docs.sparkSession.sparkContext.broadcast((model, table))

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _worker(shared, model_path, cached)
        for texts in batches:
            yield pa.array([own.of(t or "") for t in texts.to_pylist()], pa.int64())
        tidy()

    return counted(whole(text))


def op7_token_counts(spark: SparkSession, sf_dir: str, max_tokens: int = 4096) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = docs.withColumn("n_tokens", token_count(docs, public_tokenizers.path("piece_bpe_32k.model")))
    return counted.select("doc_id", F.octet_length(whole()).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))
