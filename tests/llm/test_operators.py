"""Every operator against a brute-force version, and on awkward rows."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

import harness
from riskloom.llm import bpe, chats, components, fingerprints, mixing, passages, queries, quality, sharding, simhash, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, rid string, _row string, key int"
LONG = "word " * 30_000 + "x" * 5_000
AWKWARD = [
    (1, "A plain text with some words in it. And another sentence follows here.", "en", "a"),
    (1, "A plain text with some words in it. And another sentence follows here.", "en", "a"),
    (2, "A plain text with some words in it. And another sentence follows here.", "en", None),
    (3, None, None, "b"),
    (4, "", "en", "b"),
    (5, " \n\t ", "en", None),
    (None, "No id here, but a text of more than ten words, so it could be kept by a rule.", "en", "a"),
    (None, None, None, None),
    (6, "é ü   ▁▁ <s> <|endoftext|> 漢字 🙂 \x00 it's 12345 \r\n  end", "xx", "c"),
    (7, LONG, "en", "c"),
    (8, "\n".join(["Same line again here."] * 40), "en", "a"),
]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 7, "r", "row", 9) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def awkward(spark):
    return docs_of(spark, AWKWARD).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def sample(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(sample):
    return {r.doc_id: r.text for r in sample.collect()}


def rows(df):
    return df.collect()


# Operator 10.
@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_library_and_back(awkward, empty, encoding):
    out = rows(bpe.bpe_roundtrip(awkward, P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    assert len(out) == len(AWKWARD)
    for r in out:
        assert list(r.ids) == encoding[1].encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert rows(bpe.bpe_roundtrip(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)) == []


def test_merges_of_random_bytes(encoding):
    ranks, _ = encoding
    forest = bpe.Forest(ranks)
    rng = np.random.default_rng(1)
    for size in (16, 32, 64):
        pieces = [bytes(rng.choice(list(b"abcde theion\xc3\xa9"), rng.integers(1, size + 1)).astype(np.uint8)) for _ in range(300)]
        pieces = [p for p in pieces if p not in ranks]
        assert [np.frombuffer(x, np.int32).tolist() for x in forest.encode(pieces, size)] == [bpe.merge_ranks(p, ranks) for p in pieces]
    for _ in range(200):  # against merging the leftmost lowest pair by hand
        parts = [bytes([b]) for b in rng.choice(list(b"abtheion "), rng.integers(1, 40)).astype(np.uint8)]
        whole = b"".join(parts)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 10**9))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if whole not in ranks:
            assert bpe.merge_ranks(whole, ranks) == [ranks[p] for p in parts]


# Operator 7.
def test_token_counts_like_library(awkward, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    path = P.path("piece_bpe_32k.model")
    out = rows(awkward.withColumn("n", token_count := token_counts.token_count(awkward, path, table_size=50)).select("text", "n"))
    assert token_count is not None and len(out) == len(AWKWARD)
    for r in out:
        assert r.n == len(model.encode(r.text or ""))
    assert rows(empty.withColumn("n", token_counts.token_count(empty, path))) == []


# Operator 8.
def test_quality_counts(awkward, empty, sample):
    def check(r):
        t = r.text or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {p for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.kept and r.base_failed)

    for df in (awkward, sample):
        for r in rows(quality.quality(df.select("doc_id", "text"))):
            check(r)
    assert rows(quality.cleaned(empty)) == []
    kept = quality.cleaned(awkward)
    assert kept.columns == awkward.columns
    assert {r.doc_id for r in rows(kept)} == {1, 2, None} and {r.key for r in rows(kept)} == {9}


def test_lines_are_judged_alone(spark):
    good = "This is a sentence of many words that ends as it should, with a mark."
    text = "\n".join([good, "Home | About | Contact", good, "All rights reserved.", "BUY!! NOW!! HERE!! CHEAP!!", "### $$$ %%%", "A heading"])
    r = rows(quality.quality(docs_of(spark, [(1, text, "en", "a")]).select("doc_id", "text")))[0]
    assert r.clean_text == "\n".join([good, good]) and r.clean_words == 30


def test_quality_sql(spark, sf_dir):
    assert harness.differences(spark, quality.op8_line_cleaning, quality.OP8_SQL, sf_dir) == ""


# Operator 5 and components.
def plain_print(t):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(n, linked):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_simhash_components(awkward, sample, empty):
    for df in (awkward.where("doc_id is null or doc_id <> 7"), sample):
        got = rows(simhash.simhash_components(df))
        data = rows(df.select("doc_id", "text"))
        assert len(got) == sum(1 for _ in data)
        prints = {}
        for r in data:
            prints.setdefault(plain_print(r.text), []).append(r.doc_id)
        keys = [k for k in prints if any(i is not None for i in prints[k])]
        ids = sorted((min(i for i in prints[k] if i is not None), k) for k in keys)
        group = plain_groups(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (ids[a][1] ^ ids[b][1]).bit_count() <= 2])
        want = {ids[x][1]: ids[group[x]][0] for x in range(len(ids))}
        for r in got:
            assert r.component_id == want.get(r.fp % 2**64)
    assert rows(simhash.simhash_components(empty)) == []


def test_shards_find_every_near_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    near = base[:600] ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64))
    far = near[:300] ^ (np.uint64(5) << rng.integers(0, 60, 300).astype(np.uint64))
    prints = np.unique(np.concatenate([base, near, far, np.arange(900, dtype=np.uint64)]))
    nodes = rng.permutation(len(prints))
    want = plain_groups(len(prints), [(a, b) for a in range(len(prints)) for b in np.flatnonzero(np.bitwise_count(prints[a] ^ prints[:a]) <= 2)])
    tree = simhash.Tree(prints[::3], 3)
    at, shard, home = tree.route(prints, 2)
    assert home.sum() == len(prints)
    found = []
    for s in np.unique(shard):
        own = shard == s
        order = np.argsort(~home[own], kind="stable")
        p, m, h = prints[at[own]][order], nodes[at[own]][order], home[own][order]
        a, b = simhash.solve_shard(p, m, h, 2)
        found += list(zip(a.tolist(), b.tolist(), strict=True))
    place = {n: k for k, n in enumerate(nodes.tolist())}
    got = plain_groups(len(prints), [(place[a], place[b]) for a, b in found])
    assert len(set(zip(got, want, strict=True))) == len(set(want)) == len(set(got))
    groups = simhash.Groups(nodes)
    simhash.link_dense(prints, np.arange(len(prints)), np.arange(len(prints)), groups, 2)
    dense = groups.roots().tolist()
    assert len(set(zip(dense, want, strict=True))) == len(set(want))


def test_near_dedup_keeps_one(awkward):
    kept = simhash.near_dedup(awkward)
    assert kept.columns == awkward.columns
    assert Counter(r.doc_id for r in rows(kept)) == {1: 1, 3: 1, 6: 1, 7: 1, 8: 1, None: 2}


def test_near_dedup_of_an_id_with_two_texts(spark):
    rng = np.random.default_rng(33)
    one, two, three = (" ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(60)) for _ in range(3))
    kept = simhash.near_dedup(docs_of(spark, [(1, one, "en", "a"), (5, one, "en", "a"), (5, two, "en", "a"), (5, two, "en", "a"), (5, three, "en", "a")]))
    assert sorted((r.doc_id, r.text) for r in rows(kept)) == sorted([(1, one), (5, two), (5, three)])


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in rows(components.components(spark.createDataFrame(links, "a long, b long")))}
    assert got == {**{k: 0 for k in range(1, 61)}, **{k: 100 for k in range(101, 140)}}
    assert rows(components.components(spark.createDataFrame([], "a long, b long"))) == []


# Operator 1.
def test_histogram_shards(awkward, empty, sample):
    size = lambda t: len((t or "").encode()) + 16
    for df, n in ((awkward, 3), (sample, 7)):
        made = sharding.histogram_shards(df, F.xxhash64(F.coalesce("text", F.lit(""))), F.col("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))) + 16, n)
        out = rows(made)
        assert len(out) == df.count() and set(df.columns) <= set(made.columns)
        slots = {}
        for r in out:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
        total, most = sum(size(r.text) for r in out), max(size(r.text) for r in out)
        for s in range(n):
            assert abs(sum(size(r.text) for r in out if r.shard == s) - total / n) <= 0.03 * total / n + 2 * most
    assert rows(sharding.histogram_shards(empty, F.xxhash64("text"), F.col("doc_id"), F.lit(1), 4)) == []


def test_one_hot_key_is_parted(spark):
    hot = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    out = rows(sharding.histogram_shards(hot, F.xxhash64("text"), F.col("doc_id"), F.lit(10), 8).groupBy("shard").count())
    assert len(out) == 8 and all(abs(r["count"] - 125) <= 2 for r in out)


def test_op1_digests(spark, sf_dir, texts):
    for r in rows(sharding.op1_histogram_sort(spark, sf_dir)):
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode()), "bytes")


# Operator 6.
def plain_targets(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        free = [s for s in names if s not in full]
        level = (total - sum(2 * size[s] for s in full)) / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            return {s: 2 * size[s] if s in full else level * weight[s] for s in names}
        full |= over


def test_mixing(awkward, sample, empty, spark):
    for df in (awkward, sample):
        sized = mixing.sizes(df)
        targets, pack, dealt = mixing.mix(sized)
        taken = {r.rid: r.n for r in rows(mixing.taken_words(pack, dealt).groupBy("rid").agg(F.sum(F.col("b") - F.col("a")).alias("n")))}
        held = rows(pack)
        by = {}
        for r in held:
            by[r.source] = by.get(r.source, 0) + r.size
            assert taken.get(r.rid, 0) <= 2 * r.size
        want = plain_targets(by)
        for t in rows(targets):
            assert abs(t.target - want[t.source]) < 1e-6
            assert abs(sum(taken.get(r.rid, 0) for r in held if r.source == t.source) - t.target) <= 0.5 + 1e-6
    assert rows(mixing.mixed(empty)) == []
    out = mixing.mixed(awkward)
    assert out.columns == awkward.columns
    assert sum(len(WORD.findall(r.text)) for r in rows(out)) == sum(r.words for r in rows(dealt_of(awkward)))


def dealt_of(df):
    return mixing.mix(mixing.sizes(df))[2]


def test_permutation_is_one(spark):
    for n in (1, 2, 13, 1000):
        got = [r.p for r in rows(spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5).cast("long")).alias("p")))]
        assert sorted(got) == list(range(n)) and (n < 13 or got != sorted(got))


# Operator 9.
def test_ranges_of_clustered_ids(spark, monkeypatch):
    ids = [*range(2000), 10**12, None]
    df = docs_of(spark, [(k, f"text {k}", "en", "a") for k in ids]).select("doc_id", "text")
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 20)
    for most in (1024, 8):
        monkeypatch.setattr(fingerprints, "QUANTILES", most)
        got = sorted(((r.doc_id is None, r.doc_id or 0), r.range) for r in rows(fingerprints.ranges(df, "doc_id")))
        assert [x[1] for x in got] == sorted(x[1] for x in got) and max(Counter(x[1] for x in got[:2000]).values()) <= 60
        texts = {r.doc_id: r.next_text for r in rows(fingerprints.followed(df))}
        assert all(texts[a] == f"text {b}" for a, b in zip(ids, [*ids[1:], 0], strict=True))


def test_peeling_recovers_digests(spark):
    held = {k: (set(range(100 * k, 100 * k + 30)), set(range(100 * k + 4, 100 * k + 30 + k))) for k in range(1, 40)}
    pairs = spark.createDataFrame([(k, sorted(a), sorted(b)) for k, (a, b) in held.items()], "pair long, a array<long>, b array<long>")
    got = {(r.pair, r.side, r.digest) for r in rows(fingerprints.differences(pairs, 64))}
    peeled = {p for p, *_ in got}
    assert len(peeled) >= 36 and got == {(k, side, d) for k, (a, b) in held.items() if k in peeled for side, ds in (("left", a - b), ("right", b - a)) for d in ds}
    a, b = "one two three. " * 40 + "\nsecond line here\nthird line", "one two three. " * 40 + "\nsecond line here\nfourth line\nfifth"
    out = {r.doc_id: r for r in rows(fingerprints.version_fingerprints(docs_of(spark, [(1, a, "en", "a"), (2, b, "en", "a")]).select("doc_id", "text")))}
    new = a[: len(a) - len(a) // 4] + b[: len(a) // 4]
    assert (out[1].n_lost, out[1].n_added) == (len(units(a) - units(new)), len(units(new) - units(a)))


def units(t):
    out, k = set(), 0
    for line in (t or "").split("\n"):
        w = WORD.findall(line)
        if w:
            cuts = [(0, 2), (2, 4), (4, 8), (8, 16), (16, 32), *((i, i + 32) for i in range(32, len(w), 32))] if k == 0 else [(i, i + 32) for i in range(0, len(w), 32)]
            out |= {tuple(w[a:b]) for a, b in cuts if a < len(w)}
            k += 1
    return out


def alike(a, b):
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


def test_sketches(awkward, sample, empty):
    for df in (sample, awkward.select("doc_id", "text")):
        data = sorted(rows(df.select("doc_id", "text")), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
        t = [r.text or "" for r in data]
        nxt = t[1:] + t[:1]
        edited = [x[: len(x) - len(x) // 4] + y[: len(x) // 4] for x, y in zip(t, nxt, strict=True)]
        want = sorted((hashlib.sha256(e.encode()).hexdigest(), len(x), round(alike(units(x), units(e)), 9), round(alike(units(x), units(y)), 9)) for x, e, y in zip(t, edited, nxt, strict=True))
        out = rows(fingerprints.version_fingerprints(df))
        assert sorted((r.edited_sha256, r.n_chars, round(r.near_edited, 9), round(r.near_next, 9)) for r in out) == want
        by_text = {}
        ids = {r.doc_id: r.text or "" for r in data}
        for r in out:
            if r.doc_id is not None:
                by_text.setdefault(ids[r.doc_id], set()).add(r.fingerprint)
        assert all(len(v) == 1 for v in by_text.values())
    assert rows(fingerprints.version_fingerprints(empty)) == []


def test_small_sketches_are_tried_again(spark):
    pairs = spark.createDataFrame([(k, [10 * k + i for i in range(40)], [10 * k + i + 5 for i in range(40)], 2) for k in range(30)], "pair long, a array<long>, b array<long>, size long")
    got = rows(fingerprints.retried(pairs))
    assert len(got) == 30 and all(abs(r.like - 70 / 80) < 1e-12 for r in got)


# Operator 3.
def test_repeats_of_passages(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    sentence = lambda n=14: " ".join(word() for _ in range(n)).capitalize() + "."
    passage = " ".join(sentence() for _ in range(5))
    near = passage.split(". ")
    near[2] = word() + " " + near[2].lower()
    texts = {}
    for k in range(6):
        own = [sentence() for _ in range(8)]
        shared = passage if k < 3 else ". ".join(near) if k == 3 else ""
        texts[k] = " ".join([*own[:4], shared, *own[4:]]).replace("  ", " ")
    texts[6] = "Common short line of text here.\n" + sentence(20)
    texts[7] = "Common short line of text here.\n" + sentence(20)
    df = docs_of(spark, [(k, t, "en", "a") for k, t in texts.items()] + [(None, passage, "en", "a"), (9, None, "en", "a")])
    found = rows(passages.repeats(df))
    assert {r.doc_id for r in found} == {0, 1, 2, 3}
    assert all(r.first_id == 0 and r.removed == (r.doc_id != 0) for r in found)
    cut = passages.substring_dedup(df)
    left = {r.doc_id: r.text for r in rows(cut)}
    assert cut.columns == df.columns and left[0] == texts[0] and left[4] == texts[4] and left[6] == texts[6] and left[None] == passage and left[9] is None
    assert all(passage[60:300] not in left[k] for k in (1, 2)) and all(len(left[k]) < len(texts[k]) - 250 for k in (1, 2, 3))


def test_near_paragraphs_meet(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    pairs = 60
    rows_in = []
    for k in range(pairs):
        w = [word() for _ in range(40)]
        rows_in += [(2 * k, " ".join(w) + ".", "en", "a"), (2 * k + 1, " ".join([*w[:-1], word()]) + ".", "en", "a")]
    found = passages.repeats(docs_of(spark, rows_in))
    assert found.where("removed").count() >= 0.97 * pairs


def similarity(a, b):
    a, b = (set(zip(*(w[k:] for k in range(5)), strict=False)) for w in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("inside", [False, True])
def test_near_paragraphs_with_an_edit_anywhere(spark, inside):
    """One word changed, added or dropped at any place: of paragraphs that are lines, of 40 to 200
    words; and of runs of sentences inside a longer line."""
    rng = np.random.default_rng(31)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    said = lambda n, mark: [word() + ("." if i % mark == mark - 1 else "") for i in range(n)]
    rows_in, wanted = [], set()
    for k in range(150):
        n = int(rng.integers(60 if inside else 40, 200))
        one = said(n - n % 18 if inside else n, 18 if k % 3 else 400)
        if inside:
            one[-1] = one[-1].rstrip(".") + "."
        two, at = list(one), int(rng.integers(0, len(one)))
        two[at : at + 1] = [[word() + one[at][6:]], [one[at], word()], []][k % 3 if not one[at].endswith(".") else 0]
        if similarity(one, two) >= 0.8:
            wanted.add(2 * k + 1)
        for d, w in ((2 * k, one), (2 * k + 1, two)):
            around = [" ".join(said(36, 9)) for _ in range(2)] if inside else ["", ""]
            rows_in.append((d, f"{around[0]} {' '.join(w)} {around[1]}".strip(), "en", "a"))
    found = {r.doc_id for r in rows(passages.repeats(docs_of(spark, rows_in)).where("removed and no < 0"))}
    assert len(wanted) > 120 and found <= {2 * k + 1 for k in range(150)}
    assert len(found & wanted) >= 0.95 * len(wanted)


def test_passages_whose_middle_a_text_repeats(spark):
    """52 shared words, whose middle 40 also stand alone elsewhere in one of the two texts."""
    rng = np.random.default_rng(32)
    some = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(n))
    texts = {}
    for k in range(100):
        shared = some(52)
        texts[2 * k] = f"{some(70)} {shared} {some(70)}"
        texts[2 * k + 1] = f"{some(40)} {' '.join(shared.split()[6:46])} {some(60)} {shared} {some(30)}"
    found = rows(passages.repeats(docs_of(spark, [(d, t, "en", "a") for d, t in texts.items()])).where("removed"))
    exact = {r.doc_id for r in found if r.no is None and r.n_words == 52}
    assert exact == set(range(1, 200, 2))


def test_links_of_whole_documents_against_brute_force(spark, sample):
    """Every pair of similar lines of some hundred documents is in one cluster; no other line is."""
    docs = sample.orderBy("doc_id").limit(150)
    found = rows(passages.repeats(docs).where("no < 0 and removed"))
    gone = {}
    for r in found:
        gone.setdefault(r.doc_id, []).append((r.first, r.last))
    rules = passages.Rules()
    lines = []
    for r in sorted(rows(docs), key=lambda r: r.doc_id):
        for m in re.finditer(r"[^\n]+", r.text or ""):
            w = [x.lower() for x in WORD.findall(m.group())]
            if rules.min_run <= len(w) <= rules.long_line:
                lines.append((r.doc_id, m, w))
    pairs = [(a, b) for k, b in enumerate(lines) for a in lines[:k] if a[2] != b[2] and similarity(a[2], b[2]) >= 0.8]
    for a, b in pairs:
        ends = lambda x: (x[1].start(), x[1].end())
        assert any(f <= ends(x)[0] + 3 and last >= ends(x)[1] - 3 for x in (a, b) for f, last in gone.get(x[0], ())), (a[0], b[0])


def test_large_bucket_against_brute_force(spark):
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    base = [word() for _ in range(40)]
    texts = []
    for _ in range(700):  # variants at all distances: each changes some slots of one before it
        w = list((texts[int(rng.integers(len(texts)))] if texts and rng.random() < 0.7 else " ".join(base)).split())
        for k in rng.choice(40, int(rng.integers(1, 4)), replace=False):
            w[k] = word()
        texts.append(" ".join(w))
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in texts]
    wanted = list(range(len(texts)))

    def root(i):
        while wanted[i] != i:
            i = wanted[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                wanted[root(i)] = root(j)
    rules = passages.Rules()
    words = passages.cut_texts(texts, rules).word
    pids = passages.run_hashes(words, np.full(700, 40)).view(np.int64).tolist()
    held = [sorted(set(passages.gram_hashes(w, rules.shingle).view(np.int64).tolist())) for w in np.split(words, 700)]
    one = spark.createDataFrame([(1, p, s) for p, s in zip(pids, held, strict=True)], "key long, pid long, shingles array<long>")
    links = passages.near_links(one.select("key", "pid"), one.select("pid", "shingles"), rules)
    reached = {r.node: r.component for r in rows(components.components(links))}
    number = {p: i for i, p in enumerate(pids)}
    groups = {}
    for i, p in enumerate(pids):
        groups.setdefault(root(i), set()).add(p)
    got = {}
    for p in pids:
        got.setdefault(reached.get(p, p), set()).add(p)
    assert len(number) == 700 and 20 < len(groups) < 680
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_passages_inside_sentences(spark):
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), 6))
    texts, wanted = {}, set()
    for k in range(60):
        n = 51 + k % 10 if k < 50 else 40  # the last are too short for a passage
        shared = " ".join(word() + ("." if i % 26 == 25 else "") for i in range(n))
        for d in (2 * k, 2 * k + 1):
            before, after = (" ".join(word() + ("." if i % 26 == 5 else "") for i in range(int(rng.integers(30, 60)))) for _ in range(2))
            texts[d] = f"{before} {shared} {after}"
            if k < 50:
                wanted.add((d, shared, n, 2, 2 * k, d % 2 == 1))
    texts[200] = " ".join(["same"] * 120)
    df = docs_of(spark, [(d, t, "en", "a") for d, t in texts.items()])
    found = rows(passages.repeats(df))
    exact = {(r.doc_id, texts[r.doc_id][r.first : r.last], r.n_words, r.cluster_size, r.first_id, r.removed) for r in found if r.no is None and r.doc_id != 200}
    assert exact == wanted
    kept = [r for r in found if r.no is None and r.doc_id == 200 and not r.removed]
    assert [(r.first, r.last) for r in kept] == [(0, 51 * 5 - 1)]
    assert all(r.first >= kept[0].last for r in found if r.no is None and r.doc_id == 200 and r.removed)
    left = {r.doc_id: r.text for r in rows(passages.substring_dedup(df))}
    assert all(left[d] == texts[d] for d in range(0, 100, 2))
    assert not any(shared in left[d] for d, shared, *_, removed in wanted if removed)


def test_repeats_of_awkward_rows(awkward, empty):
    assert {r.doc_id for r in rows(passages.repeats(awkward))} <= {1, 2, 7, 8}
    cut = rows(passages.substring_dedup(awkward))
    assert {r.doc_id for r in cut} >= {1, 3, 4, 5, 6, None}
    assert rows(passages.substring_dedup(empty)) == []


# Operator 4.
def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    lengths = np.array([4, 1, 3])
    u, pair, first = rng.normal(size=8), rng.normal(size=(2, 2)), 0.3
    got, pairs = toxicity.marginals(u, lengths, pair, first, with_pairs=True)
    at, total = 0, np.zeros((2, 2))
    for n in lengths:
        s, z, p = u[at : at + n], 0.0, np.zeros(n)
        q = np.zeros((2, 2))
        for tags in np.ndindex(*(2,) * int(n)):
            w = np.exp(sum(x for x, t in zip(s, tags, strict=True) if t) + first * tags[0] + sum(pair[a, b] for a, b in zip(tags, tags[1:], strict=False)))
            z += w
            p += w * np.array(tags)
            for a, b in zip(tags, tags[1:], strict=False):
                q[a, b] += w
        assert np.allclose(got[at : at + n], p / z)
        total += q / z
        at += n
    assert np.allclose(pairs, total)


def test_toxic_documents_and_offsets(spark, awkward, empty):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    clean = [(" ".join(word() for _ in range(40)), 0) for _ in range(120)]
    bad = []
    for _ in range(60):
        w = [word() for _ in range(40)]
        for _ in range(3):
            w.insert(int(rng.integers(0, 40)), str(rng.choice(["vile", "nasty"])))
        bad.append((" ".join(w), 1))
    model = toxicity.fit(clean + bad, 0.1)
    text = "one vile two vile nasty three"
    df = docs_of(spark, [(1, text, "en", "a"), (2, "one two three", "en", "a")])
    got = {r.doc_id: r.toxicity for r in rows(toxicity.toxic_spans(df, model))}
    assert got[1].score > 0.8 > 0.2 > got[2].score
    assert [text[s.start : s.end] for s in got[1].spans] == ["vile", "vile nasty"] and not got[2].spans
    assert len(rows(toxicity.toxic_spans(awkward, model))) == len(AWKWARD) and rows(toxicity.toxic_spans(empty, model)) == []
    assert toxicity.fit([("a", 1)], 1.0).link[0] > 0 and toxicity.fit([], 0.0).link[0] < 0


def test_held_out_accuracy(spark, sf_dir):
    out = toxicity.op4_toxicity(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").dropDuplicates(["doc_id"])
    scored = rows(out.join(labels, "doc_id").select("held_out", "score", "toxic", "predicted"))
    assert all(0 <= r.score <= 1 for r in scored)
    assert sum(r.predicted for r in scored if r.toxic == 0) <= 0.02 * len(scored)


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.01"
    out = toxicity.op4_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").dropDuplicates(["doc_id"])
    scored = rows(out.join(labels.where("toxic is not null"), "doc_id").where("held_out").select("score", "toxic", "predicted", "spans"))
    bad, good = ([r for r in scored if r.toxic == t] for t in (1, 0))
    auc = np.mean([(a.score > b.score) + 0.5 * (a.score == b.score) for a in bad for b in good])
    recall = np.mean([r.predicted for r in bad])
    assert len(bad) >= 5 and auc >= 0.8 and recall >= 0.6
    assert all(len(r.spans) > 0 for r in bad if r.predicted)


# Operator 2.
def test_snapshots_collapse(spark, sf_dir):
    schema = "conv_id long, turn long, role string, text string, n int, k string, copies int"
    talk = lambda i, *texts: [(i, k, "user" if k % 2 == 0 else "assistant", t, 1, "k", 2) for k, t in enumerate(texts)]
    log = talk(1, "a") + talk(2, "a", "b") + talk(3, "a", "b", "c") + talk(4, "a", "x") + talk(5, "a", "b", "c") + talk(6, "b") + talk(7, None) + talk(8, "") + talk(None, "z", "a")
    log += talk(6, "b")  # repeated rows
    log += [(9, None, None, "late", 1, "k", 2), (9, 0, "user", "early", 1, "k", 2)]
    got = {r.conv_id: r for r in rows(chats.rendered(spark.createDataFrame(log, schema)))}
    assert set(got) == {3, 4, 6, 7, 8, 9, None}
    assert (got[3].copies, got[3].n_turns, got[6].n_turns) == (2, 3, 1)
    assert got[4].rendered == "<|user|>\na\n<|end|>\n<|assistant|>\nx\n<|end|>\n"
    assert got[9].rendered.endswith("<|unknown|>\nlate\n<|end|>\n")
    assert rows(chats.rendered(spark.createDataFrame([], schema))) == []
    assert harness.differences(spark, chats.op2_chats, chats.OP2_SQL, sf_dir) == ""


def test_tied_turns_like_sql(spark):
    rng = np.random.default_rng(8)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    log = [(c, pick(0, 0, 1, 2, None), pick("user", "assistant", "", None), pick("a", "b", "", None, "Z")) for c in range(60) for _ in range(int(rng.integers(1, 5)))]
    df = spark.createDataFrame(log, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    want = con.sql(chats.OP2_SQL).to_arrow_table().to_pylist()
    assert harness.rows_of(chats.rendered(df).toArrow().to_pylist()) == harness.rows_of(want)


# Names of docs that are names of the operators' own.
def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "Some words of a text that is long enough to be kept here.", 7, "w", [1], b"x", 0.5)], "doc_id long, text string, n_words int, _w string, ids array<int>, decoded binary, toxicity double")
    q = quality.quality(df)
    assert sorted(q.columns) == sorted({*df.columns, "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text", "clean_words", "base_failed", "kept"})
    assert (q.first().n_words, q.first()["_w"]) == (13, "w")
    b = bpe.bpe_roundtrip(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert sorted(b.columns) == sorted(df.columns) and bytes(b.first().decoded).decode() == df.first().text
    t = toxicity.toxic_spans(df, toxicity.fit([], 0.0))
    assert t.columns == df.columns and t.first().toxicity.spans == []


# All queries.
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, sf_dir, name, texts):
    """One row of each document or page; ranks, conversations, passages and words have other keys."""
    out = rows(queries.QUERIES[name](spark, sf_dir))
    if name == "op11_search":
        assert out and len({(r.item_id, r["rank"]) for r in out}) == len({(r.item_id, r.doc_id) for r in out}) == len(out) and {r.doc_id for r in out} <= set(texts)
    elif name == "op12_main_text":
        assert sorted(r.page_id for r in out) == sorted(r.page_id for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id").collect())
    elif name == "op13_variants":
        assert out and len({r.word for r in out}) == len(out)
    elif name not in ("op2_chats", "op3_passages"):
        assert sorted(r.doc_id for r in out) == sorted(texts)
