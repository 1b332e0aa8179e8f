"""A training corpus from the documents table.

Five stages, each written as Parquet and read by the next: quality rules, SimHash
near-dedup, substring dedup, mixing sources to target weights, byte-level BPE. Every
stage works on all that the one before it kept and, but for the last, returns the columns
of documents: the first drops rejected documents and failing lines, the second all but one
document of each near-duplicate group, the third repeated paragraphs, the fourth deals out
the mix (a row for each pass that takes words of a document), the last encodes the texts.

Rows with NULL ids, NULL or empty texts: the first stage rejects texts without words; later
stages keep rows without an id. Repeated rows leave one at the second stage. Columns beyond
those of documents pass through to the fourth stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.bpe import bpe_roundtrip
from riskloom.llm.common import dropped, saved
from riskloom.llm.mixing import mixed
from riskloom.llm.passages import substring_dedup
from riskloom.llm.quality import cleaned
from riskloom.llm.simhash import near_dedup


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the rules keep, without the lines that failed."""
    return cleaned(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: one document of each group of near copies."""
    return near_dedup(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: repeated paragraphs stay only where they stand first."""
    return substring_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the words that the mix takes."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the ids of each text, and a digest of what they decode to."""
    import public_tokenizers

    coded = bpe_roundtrip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", clean),
    ("simhash near-dedup", without_copies),
    ("substring dedup", without_repeats),
    ("mixing", mix_sources),
    ("byte-level bpe", encode),
]

#: SQL has no seeded MinHash, swap-or-not permutation or byte pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
