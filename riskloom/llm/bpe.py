"""Operator 10: byte-level BPE encoding and decoding.

Each match of the pre-token pattern is encoded alone. A segment tree over its byte
positions keeps the lowest pair rank below every node, so the leftmost lowest pair is
found by walking down from the root; a merge changes the leaves of the merged pair, of
the pair it starts and of the pair it ends, each in logarithmic time.

Nulls and empty texts give no ids (an empty array) and decode to empty bytes. A text of
any length is encoded whole: a pre-token of n bytes costs O(n log n). Work is per row, so
repeated rows, ties and other columns do not matter, and other columns pass through.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, tidy, whole

#: Pre-tokens above this many bytes are encoded but not remembered.
CACHED_BYTES = 64
#: Pre-tokens of a generation of a worker's memory.
CACHED_PIECES = 120_000
#: Rows of an Arrow batch that are encoded at once.
ROWS = 500
#: Pre-tokens of a text that are held at once.
CHUNK = 50_000


def merge_ranks(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token."""
    if (known := ranks.get(piece)) is not None:
        return [known]
    n = len(piece)
    none = len(ranks) + 1 << 8
    rank_of = ranks.get
    size = 1 << max(1, (n - 1).bit_length())
    tree = [none] * (2 * size)
    for i in range(n - 1):
        tree[size + i] = rank_of(piece[i : i + 2], none)
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a <= b else b

    def put(leaf: int, rank: int) -> None:
        node = size + leaf
        tree[node] = rank
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            low = a if a <= b else b
            if tree[node] == low:
                return
            tree[node] = low
            node >>= 1

    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    while (low := tree[1]) != none:
        node = 1
        while node < size:
            node *= 2
            if tree[node] != low:
                node += 1
        left = node - size
        right = after[left]
        end = after[left] = after[right]
        put(right, none)
        if end < n:
            before[end] = left
            put(left, rank_of(piece[left : after[end]], none))
        else:
            put(left, none)
        if left:
            put(before[left], rank_of(piece[before[left] : end], none))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Forest:
    """Many short pre-tokens at once: row by row the same trees as in merge_ranks, each
    step done for all rows that still have a pair to merge."""

    def __init__(self, ranks: dict[bytes, int]):
        self.none = np.int32(2**31 - 1)
        self.base = max(ranks.values(), default=0) + 2
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of two neighbours; none where either is -1 or they do not merge."""
        key = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank[at], self.none)

    def encode(self, pieces: list[bytes], size: int) -> list[bytes]:
        """pieces: of 1 to size bytes; size: a power of two."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        token = np.full((n, size + 1), -1, np.int32)
        token[:, :size] = np.where(np.arange(size) < lengths[:, None], self.byte[raw], -1)
        tree = np.full((n, 2 * size), self.none, np.int32)
        tree[:, size:] = self.pair(token[:, :-1], token[:, 1:])
        half = size // 2
        while half:
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
            half //= 2
        after = np.tile(np.arange(1, size + 2), (n, 1))
        before = np.tile(np.arange(-1, size), (n, 1))
        rows = np.flatnonzero(tree[:, 1] != self.none)
        while len(rows):
            low = tree[rows, 1]
            left = np.ones(len(rows), np.int64)
            for _ in range(size.bit_length() - 1):
                left *= 2
                left += tree[rows, left] != low
            left -= size
            right = after[rows, left]
            end = after[rows, right]
            token[rows, left] = low
            token[rows, right] = -1
            after[rows, left] = end
            before[rows, np.minimum(end, size)] = left
            prior = before[rows, left]
            changed = (
                (rows, right, np.full(len(rows), self.none)),
                (rows, left, self.pair(low, token[rows, np.minimum(end, size)])),
                (rows[has := prior >= 0], prior[has], self.pair(token[rows[has], prior[has]], low[has])),
            )
            for r, leaf, rank in changed:
                node = leaf + size
                tree[r, node] = rank
                while len(node) and node[0] > 1:
                    node = node >> 1
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            rows = rows[tree[rows, 1] != self.none]
        live = token[:, :size] >= 0
        ends = np.cumsum(live.sum(axis=1)) * 4
        packed = token[:, :size][live].tobytes()
        return [packed[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


class Encoder:
    """Ids of texts as packed int32. A worker remembers short pre-tokens in two
    generations, so that the frequent ones stay."""

    def __init__(self, data: bytes, pattern: str):
        self.ranks = read_ranks(data)
        self.forest = Forest(self.ranks)
        self.split = regex.compile(pattern)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def forget(self) -> None:
        self.young, self.old = {}, {}

    def learn(self, pieces: list[str]) -> list[str]:
        """Make young hold all pieces; returns those too long to keep."""
        fresh: dict[int, list[str]] = {16: [], 32: [], CACHED_BYTES: []}
        long = []
        for p in set(pieces) - self.young.keys():
            if (ids := self.old.get(p)) is not None:
                self.young[p] = ids
                continue
            raw = p.encode()
            if (whole_rank := self.ranks.get(raw)) is not None:
                self.young[p] = whole_rank.to_bytes(4, "little")
            elif len(raw) <= CACHED_BYTES:
                fresh[16 if len(raw) <= 16 else 32 if len(raw) <= 32 else CACHED_BYTES].append(p)
            else:
                long.append(p)
                self.young[p] = np.array(merge_ranks(raw, self.ranks), np.int32).tobytes()
        for size, some in fresh.items():
            for k in range(0, len(some), 8192):
                part = some[k : k + 8192]
                self.young.update(zip(part, self.forest.encode([p.encode() for p in part], size), strict=True))
        return long

    def chunks(self, texts: list[str | None]) -> Iterator[list[tuple[int, list[str]]]]:
        """Pre-tokens of the texts with the texts' numbers, about CHUNK at a time."""
        held, n = [], 0
        for k, text in enumerate(texts):
            if text and len(text) > CHUNK:
                pieces = (m.group() for m in self.split.finditer(text))
                while part := list(islice(pieces, CHUNK)):
                    yield [(k, part)]
            elif text:
                held.append((k, part := self.split.findall(text)))
                n += len(part)
                if n >= CHUNK:
                    yield held
                    held, n = [], 0
        yield held

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        for held in self.chunks(texts):
            long = self.learn([p for _, pieces in held for p in pieces])
            for k, pieces in held:
                out[k] += b"".join(map(self.young.__getitem__, pieces))
            for p in long:
                del self.young[p]
            if len(self.young) > CACHED_PIECES:
                self.old, self.young = self.young, {}
        return out


class Decoder:
    """Token bytes laid end to end, with the place of each id."""

    def __init__(self, data: bytes):
        ranks = read_ranks(data)
        self.size = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]) if len(self.size) else self.size
        laid = bytearray(int(self.size.sum()))
        for token, i in ranks.items():
            laid[self.start[i] : self.start[i] + len(token)] = token
        self.laid = np.frombuffer(bytes(laid), np.uint8)

    def bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(self.start[ids] - (ends - size), size)
        return self.laid[at].tobytes()


_made: dict[tuple, Encoder | Decoder] = {}  # one of each kind in a Python worker


def _worker(kind, key, *args):
    if (key, kind) not in _made:
        _made.clear() if len(_made) > 4 else None
        _made[key, kind] = kind(*args)
    return _made[key, kind]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded_lists(encoder: Encoder, texts: pa.Array) -> pa.Array:
    """The ids of each text, ROWS texts at a time."""
    parts = []
    for k in range(0, len(texts), ROWS):
        packed = encoder.ids(texts[k : k + ROWS].to_pylist())
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
        parts.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32))))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


def decoded_lists(decoder: Decoder, lists: pa.Array) -> pa.Array:
    """The bytes that each list of ids stands for."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    return pa.array([decoder.bytes(flat[e - n : e]) for e, n in zip(ends, sizes, strict=True)], pa.binary())


def encode(spark: SparkSession, text: Column, ranks_path: str, pattern: str) -> Column:
    """array<int>: the ids of a text. The rank file, of a fixed size, is broadcast."""
    shared = spark.sparkContext.broadcast(_read(ranks_path))

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _worker(Encoder, (ranks_path, pattern), shared.value, pattern)
        for texts in batches:
            yield encoded_lists(own, texts)
        own.forget()  # the worker lives on, other operators need its memory
        tidy()

    return encoded(text)


def decode(spark: SparkSession, ids: Column, ranks_path: str) -> Column:
    """binary: the bytes that ids stand for."""
    shared = spark.sparkContext.broadcast(_read(ranks_path))

    @F.arrow_udf("binary")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _worker(Decoder, ranks_path, shared.value)
        for lists in batches:
            yield decoded_lists(own, lists)
        tidy()

    return decoded(ids)


def bpe_roundtrip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with ids and decoded, in place of columns of those names. A batch is encoded, and its
    ids alone are decoded, in one worker."""
    shared = docs.sparkSession.sparkContext.broadcast(_read(ranks_path))
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        to, back = _worker(Encoder, (ranks_path, pattern), shared.value, pattern), _worker(Decoder, ranks_path, shared.value)
        for texts in batches:
            ids = encoded_lists(to, texts)
            yield pa.StructArray.from_arrays([ids, decoded_lists(back, ids)], fields=list(kind))
        to.forget()
        tidy()

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "decoded")]
    coded = docs.select(*kept, both(whole(text)).alias("_coded"))
    return coded.select(*kept, F.col("_coded.ids").alias("ids"), F.col("_coded.decoded").alias("decoded"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = bpe_roundtrip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", *digests())


def digests() -> list[Column]:
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    ]
