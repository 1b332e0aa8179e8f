"""The stages of the pipeline, one after the other, and on awkward rows."""

import base64
import re
from collections import Counter

import numpy as np
import public_tokenizers  # noqa: F401
import pytest
import tiktoken

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from riskloom.llm.bpe import Decoder, _read  # noqa: E402
from riskloom.llm.common import saved  # noqa: E402

from .test_operators import AWKWARD, WORD, docs_of, plain_groups, plain_print  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    decoder = Decoder(_read(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    assert sorted(decoder.bytes(np.array(r.ids, np.int64)).decode() for r in out) == sorted(r.text for r in docs.collect())


def test_awkward_rows_pass_every_stage(spark, sf_dir):
    for rows in (AWKWARD, []):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs_of(spark, rows), sf_dir).collect()
            assert (len(out) > 0) == bool(rows), name


def line_stays(line):
    w = WORD.findall(line)
    share = lambda pattern: sum(bool(re.fullmatch(pattern, x)) for x in w) / len(w)
    symbols = len(re.findall(r"[#*$%&|<>]", line))
    ended = re.search(r"[.!?…:;][\"'”’»)\]]{0,3}$", w[-1])
    inside = any(re.search(r"[.!?…][\"'”’»)]*$", x) for x in w)
    furniture = any(x in line.lower() for x in ("click here", "privacy policy", "all rights reserved"))
    return not (share(r"[|»›•·>]+") >= 0.15 or (symbols and symbols >= 0.1 * len(line)) or (not ended and (len(w) < 20 or not inside)) or furniture)


def clean(text):
    """What the first stage keeps of a text; None if it rejects it."""
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = {p for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
    left = [x for x in lines if line_stays(x)]
    lost = len(words) - sum(len(WORD.findall(x)) for x in left)
    return None if len(words) < 10 or 100 * len(repeated) > 20 * len(words) or lost > 0.5 * len(words) else "\n".join(left)


def shares(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets of the sources, in order, by filling up."""
    goal, full, open_ = share * sum(sizes), {}, set(range(len(sizes)))
    while True:
        level = (goal - sum(full.values())) / sum(weights[k % 3] for k in open_)
        over = {k for k in open_ if level * weights[k % 3] > cap * sizes[k]}
        if not over:
            return [full.get(k, level * weights[k % 3]) for k in range(len(sizes))]
        full |= {k: cap * sizes[k] for k in over}
        open_ -= over


def test_stages_against_brute_force(spark, sf_dir):
    rng = np.random.default_rng(31)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    sentence = lambda: " ".join(word() for _ in range(12)).capitalize() + "."
    passage = " ".join(sentence() for _ in range(6))
    made = []
    for k in range(40):
        lines = [" ".join(sentence() for _ in range(3)) for _ in range(1 + k % 4)]
        if k % 5 == 0:
            lines.insert(1, "Home | News | Sport | Contact")
        if k % 7 == 0:
            lines.append("Read our privacy policy before you go on.")
        if k % 8 == 3:
            lines[0] = lines[0] + " " + passage
        made.append((k + 10, "\n".join(lines), "en", f"s{k % 4}"))
    made += [(100 + k, made[k][1], "en", "s1") for k in range(3)] + [(200, "too short", "en", "s0"), (201, "Menu | Home | Login\n" * 20, "en", "s0"), (202, "", "en", "s0"), (203, None, "en", "s0")]
    docs, texts, sources = docs_of(spark, made), {i: t for i, t, *_ in made}, {i: s for i, _, _, s in made}
    stage = dict(corpus_pipeline.STAGES)
    step = lambda name, d: saved(stage[name](spark, d, sf_dir), "test-stage")

    docs = step("quality rules", docs)
    want = {i: c for i, t in texts.items() if (c := clean(t)) is not None}
    assert {r.doc_id: r.text for r in docs.collect()} == want and len(want) < len(texts)

    docs = step("simhash near-dedup", docs)
    ids = sorted(want)
    prints = [plain_print(want[i]) for i in ids]
    group = plain_groups(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2])
    want = {ids[k]: want[ids[k]] for k in range(len(ids)) if group[k] == k}
    assert {r.doc_id: r.text for r in docs.collect()} == want and not {100, 101, 102} & set(want)

    docs = step("substring dedup", docs)
    holders = sorted(i for i, t in want.items() if passage in t)
    want = {i: t.replace(" " + passage, "") if i in holders[1:] else t for i, t in want.items()}
    assert len(holders) == 5 and {r.doc_id: r.text for r in docs.collect()} == want

    docs = step("mixing", docs)
    sizes, mixed = Counter(), Counter()
    for i, t in want.items():
        sizes[sources[i]] += len(WORD.findall(t))
    order = sorted(sizes)
    per_doc = Counter()
    for r in docs.collect():
        words, rest = WORD.findall(r.text), iter(WORD.findall(want[r.doc_id]))
        assert all(w in rest for w in words)  # in their order
        mixed[r.source] += len(words)
        per_doc[r.doc_id] += len(words)
    assert all(abs(mixed[s] - t) <= 1 for s, t in zip(order, shares([sizes[s] for s in order]), strict=True))
    assert all(n <= 2 * len(WORD.findall(want[i])) for i, n in per_doc.items())

    out = stage["byte-level bpe"](spark, docs, sf_dir).collect()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert sorted((r.doc_id, tuple(r.ids)) for r in out) == sorted((r.doc_id, tuple(coder.encode_ordinary(r.text))) for r in docs.collect())
