"""Operator 4: toxicity by a linear-chain conditional random field.

Only documents are labelled, so token labels come first: in the labelled sample, a token of
a toxic document is toxic where the token meets clearly more different left neighbours in
toxic documents than in others (neighbours, not occurrences: near copies of one document
do not make its rare words toxic). The field has two tags; its features are the
token's form, its ends and its shape, its chain is one line of a text, and it is fitted by
gradient steps on forward-backward marginals. A document's score is a logistic function,
fitted on the same sample, of the largest marginal and the expected number of toxic tokens;
offending offsets are the character ranges of runs of tokens whose marginal is 0.5 or more.

The fit sees at most max_toxic + max_clean labelled documents, those with the lowest hash
of their id, and of them only rows that the caller leaves in (op4: crc32 of the id modulo
5 is not 0). Label, lang, source and id are no inputs of a score.

NULL and empty texts have no token and get the score of a document without evidence. Equal
texts get equal scores. With no labelled document of one kind the score is the share of the
other (0 where there are none), and all tokens or none are offending. Long texts are tagged whole. Other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, tidy, whole

EDGE = b".,;:!?\"'()[]{}<>*#$%&|-_"
TOKEN = re.compile(WORD)


def form(token: bytes) -> bytes:
    return token.strip(EDGE).lower()


def features(token: bytes) -> list[bytes]:
    w = form(token)
    shape = b"U" if token.isupper() else b"D" if any(48 <= c <= 57 for c in token) else b"l"
    return [b"w=" + w, b"s=" + w[-4:], b"p=" + w[:4], b"c=" + shape]


@dataclass
class Field:
    """Score of the toxic tag by feature, of the four tag pairs, and of a first toxic tag."""

    weight: dict[bytes, float] = field(default_factory=dict)
    pair: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    first: float = 0.0
    bias: float = 0.0
    link: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def unary(self, token: bytes) -> float:
        return self.bias + sum(self.weight.get(f, 0.0) for f in features(token))


def marginals(scores: np.ndarray, lengths: np.ndarray, pair: np.ndarray, first: float, with_pairs: bool = False):
    """Probability of the toxic tag for tokens laid end to end in chains of the given
    lengths; with_pairs: also the expected number of each pair of tags."""
    out = np.zeros(len(scores))
    pairs = np.zeros((2, 2))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    e = np.exp(pair - pair.max())
    k = 0
    while k < len(lengths) and lengths[k] > 0:
        # Chains of like length together, so that the padded block stays small.
        most = int(lengths[k])
        stop = min(int(np.searchsorted(-lengths, -(most // 2), side="right")), k + max(64, 2_000_000 // most))
        stop = max(stop, k + 1)
        s, n = starts[k:stop], lengths[k:stop]
        at = np.minimum(s[:, None] + np.arange(most), len(scores) - 1)
        live = np.arange(most) < n[:, None]
        u = np.clip(scores[at], -30, 30)
        emit = np.where(live, np.exp(np.minimum(u, 0)), 1.0), np.where(live, np.exp(np.minimum(-u, 0)), 1.0)  # toxic, clean
        fwd = np.empty((2, most, stop - k))
        a0, a1 = emit[1][:, 0], emit[0][:, 0] * np.exp(first)
        for t in range(most):
            if t:
                a0, a1 = (a0 * e[0, 0] + a1 * e[1, 0]) * emit[1][:, t], (a0 * e[0, 1] + a1 * e[1, 1]) * emit[0][:, t]
            z = a0 + a1
            a0, a1 = a0 / z, a1 / z
            fwd[0, t], fwd[1, t] = a0, a1
        p = np.empty((stop - k, most))
        b0 = b1 = np.ones(stop - k)
        for t in range(most - 1, -1, -1):
            g0, g1 = fwd[0, t] * b0, fwd[1, t] * b1
            p[:, t] = g1 / (g0 + g1)
            if t:
                m0, m1 = emit[1][:, t] * b0, emit[0][:, t] * b1
                if with_pairs:
                    q = np.stack([fwd[i, t - 1] * e[i, j] * (m0, m1)[j] for i in (0, 1) for j in (0, 1)])
                    pairs += (q / q.sum(axis=0))[:, live[:, t]].sum(axis=1).reshape(2, 2)
                b0, b1 = e[0, 0] * m0 + e[0, 1] * m1, e[1, 0] * m0 + e[1, 1] * m1
                z = b0 + b1
                # Past a chain's end the message stays flat.
                b0, b1 = np.where(live[:, t], b0 / z, 1.0), np.where(live[:, t], b1 / z, 1.0)
        out[at[live]] = p[live]
        k = stop
    return (out, pairs) if with_pairs else out


def tagged_forms(texts: list[list[list[bytes]]], toxic: list[bool], min_contexts: int = 3, min_ratio: float = 20.0) -> set[bytes]:
    """Forms that meet at least min_contexts left neighbours in toxic documents, and
    min_ratio times as many for the size of either side as in the others."""
    met: tuple[set, set] = (set(), set())
    for lines, t in zip(texts, toxic, strict=True):
        for line in lines:
            forms = [form(w) for w in line]
            met[t].update(zip(forms, [b"", *forms], strict=False))
    clean, bad = (Counter(w for w, _ in m) for m in met)
    scale = max(1, len(met[0])) / max(1, len(met[1]))
    least = max(min_contexts, 0.02 * sum(toxic))
    return {w for w, n in bad.items() if w and n >= least and n * scale >= min_ratio * (clean[w] + 1.0)}


def fit(rows: list[tuple[str, int]], base_rate: float, epochs: int = 6) -> Field:
    """rows: texts and labels of the sample; base_rate: share of toxic documents before it
    was drawn."""
    toxic = [bool(t) for _, t in rows]
    if len(set(toxic)) < 2:
        sure = 30.0 if any(toxic) else -30.0
        return Field(bias=sure, link=(sure, 0.0, 0.0))
    texts = [[line.split() for line in (x or "").encode().split(b"\n")] for x, _ in rows]
    lexicon = tagged_forms(texts, toxic)
    lines = [(line, t) for doc, t in zip(texts, toxic, strict=True) for line in doc if line]
    hot = [any(t and form(w) in lexicon for w in line) for line, t in lines]
    rng = np.random.default_rng(4)
    quota = max(2000, 4 * sum(hot))
    cold = [k for k, h in enumerate(hot) if not h]
    cold = [cold[k] for k in rng.permutation(len(cold))[:quota]]
    used = sorted([k for k, h in enumerate(hot) if h] + cold, key=lambda k: len(lines[k][0]))
    ids: dict[bytes, int] = {}
    tokens, tags, lengths = [], [], []
    for k in used:
        line, t = lines[k]
        for w in line:
            tokens.append([ids.setdefault(f, len(ids)) for f in features(w)])
            tags.append(t and form(w) in lexicon)
        lengths.append(len(line))
    feats, y, n = np.array(tokens), np.array(tags, float), np.array(lengths)
    ends = np.cumsum(n)
    weight, bias, first, pair = np.zeros(len(ids)), -4.0, 0.0, np.zeros((2, 2))
    seen = np.full(len(ids), 1e-2), 1e-2, np.full((2, 2), 1.0)
    g_w, g_b, g_p = seen
    batches = [(a, min(a + 512, len(n))) for a in range(0, len(n), 512)]
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            a, b = batches[k]
            lo, hi = (ends[a - 1] if a else 0), ends[b - 1]
            f, own = feats[lo:hi], n[a:b]
            p, pairs = marginals(weight[f].sum(axis=1) + bias, own, pair, first, with_pairs=True)
            miss = p - y[lo:hi]
            grad = np.bincount(f.ravel(), np.repeat(miss, f.shape[1]), len(ids)) + 0.02 * weight * (np.bincount(f.ravel(), minlength=len(ids)) > 0)
            tag = y[lo:hi].astype(int)
            inside = np.ones(hi - lo, bool)
            inside[np.concatenate([[0], np.cumsum(own)[:-1]])] = False
            real = np.bincount(2 * np.concatenate([[0], tag[:-1]])[inside] + tag[inside], minlength=4).reshape(2, 2)
            g_w += grad**2
            g_b += miss.sum() ** 2
            g_p += (pairs - real) ** 2
            weight -= 0.5 * grad / np.sqrt(g_w)
            bias -= 0.5 * miss.sum() / np.sqrt(g_b)
            pair = pair - 0.3 * (pairs - real) / np.sqrt(g_p)
    kept = {f: float(weight[k]) for f, k in ids.items() if abs(weight[k]) > 0.05}
    made = Field(kept, pair, first, float(bias))
    found = np.array([evidence(made, doc) for doc in Tagger(made).documents([x for x, _ in rows])])
    made.link = logistic(found, np.array(toxic, float), base_rate)
    return made


def evidence(_: Field, p: np.ndarray) -> tuple[float, float]:
    """The largest marginal and the log of one more than the expected number of toxic tokens."""
    return (float(p.max()), float(np.log1p(p.sum()))) if len(p) else (0.0, 0.0)


def logistic(x: np.ndarray, y: np.ndarray, base_rate: float) -> tuple[float, float, float]:
    """Intercept and slopes by Newton steps; the classes are weighted back to base_rate."""
    share = y.mean()
    w = np.where(y > 0, base_rate / share, (1 - base_rate) / (1 - share))
    full = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(full @ beta, -30, 30)))
        grad = full.T @ (w * (p - y)) + 1e-2 * np.array([0, *beta[1:]])
        hess = (full * (w * p * (1 - p))[:, None]).T @ full + 1e-2 * np.eye(3)
        beta = beta - np.linalg.solve(hess, grad)
    return tuple(map(float, beta))


class Tagger:
    def __init__(self, model: Field, most: int = 500_000):
        self.model, self.most, self.known = model, most, {}

    def scores(self, tokens: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(tokens) - known.keys():
            known[w] = self.model.unary(w)
        return np.fromiter(map(known.__getitem__, tokens), float, len(tokens))

    def documents(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Marginals of each text's tokens, about a million tokens at a time."""
        held, sizes = [], []
        for k, text in enumerate(texts):
            lines = [line.split() for line in (text or "").encode().split(b"\n")]
            held.append([line for line in lines if line])
            sizes.append(sum(map(len, held[-1])))
            if sum(sizes) > 1_000_000 or k == len(texts) - 1:
                lengths = np.array([len(line) for doc in held for line in doc], np.int64)
                p = marginals(self.scores([w for doc in held for line in doc for w in line]), lengths, self.model.pair, self.model.first) if len(lengths) else np.zeros(0)
                yield from np.split(p, np.cumsum(sizes)[:-1])
                held, sizes = [], []

    def score(self, p: np.ndarray) -> float:
        a, b, c = self.model.link
        x, y = evidence(self.model, p)
        return float(1 / (1 + np.exp(-np.clip(a + b * x + c * y, -30, 30))))


def spans(text: str, p: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges of runs of tokens with a marginal of 0.5 or more."""
    if not (p >= 0.5).any():
        return []
    out: list[tuple[int, int]] = []
    for k, m in enumerate(TOKEN.finditer(text)):
        if p[k] >= 0.5:
            if k and p[k - 1] >= 0.5 and out and "\n" not in text[out[-1][1] : m.start()]:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append((m.start(), m.end()))
    return out


_taggers: dict[int, Tagger] = {}


def toxic_spans(docs: DataFrame, model: Field, text: str = "text") -> DataFrame:
    """docs with toxicity, in place of a column of that name: struct of score, expected (number
    of toxic tokens) and spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score:double,expected:double,spans:array<struct<start:int,end:int>>>")
    def tagged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = _taggers.get(id(shared.value))
        if tagger is None:
            _taggers.clear()
            tagger = _taggers[id(shared.value)] = Tagger(shared.value)
        kind = pa.struct([("score", pa.float64()), ("expected", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        for batch in batches:
            texts = batch.to_pylist()
            yield pa.array(
                [{"score": tagger.score(p), "expected": float(p.sum()), "spans": [{"start": a, "end": b} for a, b in spans(t, p)]} for t, p in zip(texts, tagger.documents(texts), strict=True)],
                kind,
            )
        tidy()

    return docs.withColumn("toxicity", tagged(whole(text)))


def sample(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int) -> tuple[list[tuple[str, int]], float]:
    """The labelled rows of the fit, and the share of toxic documents among all labelled."""
    known = labels.where("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    drawn = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for t, n in ((1, max_toxic), (0, max_clean))]
    ids = drawn[0].unionAll(drawn[1])  # at most max_toxic + max_clean rows
    rows = docs.join(F.broadcast(ids), "doc_id").select("text", "toxic").collect()
    return sorted((r.text or "", r.toxic) for r in rows), share


def held_out():
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0


def op4_toxicity(spark: SparkSession, sf_dir: str, max_toxic: int = 1000, max_clean: int = 2000) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    model = fit(*sample(docs, labels, max_toxic, max_clean))
    scored = toxic_spans(docs, model).withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    score = F.col("toxicity.score")
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("toxicity.expected").alias("expected_toxic"), F.size("toxicity.spans").alias("n_spans"), F.col("toxicity.spans").alias("spans"))
