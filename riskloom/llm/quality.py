"""Operator 8: line-first cleaning, in DataFrame functions only.

Every line that holds a word is judged by itself: navigation (separators among its words),
symbols, shouting, boilerplate phrases, and a missing end mark on a short line. Failing
lines go; a document that loses more than max_loss of its words goes with them. Before
that, the base rules reject documents under min_words words or with more than
max_repeat percent of words inside 5-word windows that occur twice.

NULL and empty texts have no words: all counts are 0, they fail the base rules and are
not kept. Each row is judged alone, so ties and repeated rows are judged alike, other
columns pass through, and a long text is one row of work (about n log n of its words).
Windows are compared by 64-bit hash within one text.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, documents, let, unboxed, where_last, whole

#: Phrases of page furniture, lower case.
BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "click here",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "skip to content",
    "terms of use",
    "use of cookies",
)


@dataclass(frozen=True)
class LineRules:
    min_words: int = 10
    max_repeat: float = 20.0
    window: int = 5
    #: A line fails with at least this share of words that are separators only.
    nav_share: float = 0.15
    #: A line fails with at least this share of symbols among its characters.
    symbol_share: float = 0.10
    #: A line of at least shout_words words fails with this share of words that shout.
    shout_words: int = 3
    shout_share: float = 0.5
    #: A line without an end mark fails below this many words or without a mark inside.
    open_words: int = 20
    #: Documents that lose a larger share of their words are rejected.
    max_loss: float = 0.5


def _words(line: Column) -> Column:
    """The words of a line; only a line with unusual white space needs a regular expression."""
    plain = F.when(line.rlike(r"[\x09\x0B-\x0D]"), F.regexp_replace(line, r"[\x09\x0B-\x0D]", " ")).otherwise(line)
    return F.array_remove(F.split(plain, " "), "")


def _repeat_words(hashes: Column, window: int) -> Column:
    """Positions inside windows (hashes by start) that occur twice or more."""

    def in_groups(s: Column) -> Column:
        def twice(e: Column, i: Column) -> Column:
            same = lambda j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            return F.when(i > 0, same(i - 1)).otherwise(False) | same(i + 1)

        return F.filter(s, twice)

    marked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = F.sort_array(F.transform(let(marked, in_groups), lambda e: e["i"]))
    covered = let(
        starts,
        lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))),
            F.lit(0),
            lambda a, x: a + x,
        ),
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered)


def line_ok(line: Column, words: Column, rules: LineRules) -> Column:
    """Whether a line, with its words, stays."""
    n = F.size(words)
    share = lambda pattern: F.size(F.filter(words, lambda w: w.rlike(pattern))) / n
    any_of = lambda *marks: functools.reduce(operator.or_, [F.contains(line, F.lit(m)) for m in marks])
    nav = any_of(*"|»›•·>") & (share(r"^[|»›•·>]+$") >= rules.nav_share)
    symbols = line.rlike(r"[#*$%&|<>]") & (F.length(F.regexp_replace(line, r"[^#*$%&|<>]+", "")) >= rules.symbol_share * F.length(line))
    shouts = any_of("!!") & (n >= rules.shout_words) & (share(r"^[^\p{Ll}]*!!$") >= rules.shout_share)
    ended = F.right(F.element_at(words, -1), F.lit(4)).rlike(r"[.!?…:;][\"'”’»)\]]*$")
    inside = F.exists(words, lambda w: w.rlike(r"[.!?…][\"'”’»)]*$"))
    lower = F.lower(line)
    furniture = functools.reduce(operator.or_, [F.contains(lower, F.lit(phrase)) for phrase in BOILERPLATE])
    return ~(nav | symbols | shouts | (~ended & ((n < rules.open_words) | ~inside)) | furniture)


def quality(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, clean_text,
    clean_words, base_failed and kept, in place of columns of those names."""
    lines = F.filter(F.transform(F.split(whole(text), "\n"), lambda x: F.struct(x.alias("line"), _words(x).alias("words"))), lambda x: F.size(x["words"]) > 0)
    df = docs.withColumn("_op8_lines", lines)
    df = df.withColumns({"_op8_words": F.flatten("_op8_lines.words"), "_op8_kept": F.filter("_op8_lines", lambda x: line_ok(x["line"], x["words"], rules))})
    w = F.col("_op8_words")
    windows = F.when(
        F.size(w) >= rules.window,
        F.transform(F.sequence(F.lit(1), F.size(w) - (rules.window - 1)), lambda i: F.xxhash64(F.slice(w, i, rules.window))),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_op8_hashes", windows)
    df = df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(whole(text), r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("_op8_lines") - F.size(F.array_distinct("_op8_lines.line"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("_op8_hashes"), rules.window).cast("long"),
            "clean_text": F.array_join("_op8_kept.line", "\n"),
            "clean_words": F.aggregate("_op8_kept", F.lit(0).cast("long"), lambda a, x: a + F.size(x["words"])),
        }
    ).drop("_op8_lines", "_op8_words", "_op8_kept", "_op8_hashes")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat * F.col("n_words"))
    lost = F.col("n_words") - F.col("clean_words") > rules.max_loss * F.col("n_words")
    return df.withColumn("base_failed", failed).withColumn("kept", ~(failed | lost))


def cleaned(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text") -> DataFrame:
    """The documents that are kept, without their failing lines."""
    judged = quality(boxed(docs, F.col(text).alias("text")), rules)
    new = {text: F.col("clean_text"), "n_chars": F.length("clean_text")}
    return unboxed(where_last(judged, F.col("kept")), docs, **new)


def op8_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_words")


#: The same rules in DuckDB, the verdict of the lines included.
OP8_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), n as (
  select doc_id, t, w, len(w) as n_words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from d
), pos as (
  select doc_id, i, list_slice(w, i, i + 4) as win
  from (select doc_id, w, unnest(range(1, n_words - 3)) as i from n where n_words >= 5)
), twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as c from pos) where c > 1
), covered as (
  select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest(range(i, i + 5)) as p from twice) group by doc_id
), lines as (
  select doc_id, unnest(l) as line from n
), worded as (
  select doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as lws from lines
), judged as (
  select doc_id, len(lws) as lw,
    len(list_filter(lws, lambda x: regexp_full_match(x, '[|»›•·>]+'))) as nav,
    length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) as sym, length(line) as chars,
    len(list_filter(lws, lambda x: regexp_full_match(x, '[^\p{Ll}]*!!'))) as shouts,
    regexp_matches(lws[-1], '[.!?…:;]["''”’»)\]]{0,3}$') as ended,
    len(list_filter(lws, lambda x: regexp_matches(x, '[.!?…]["''”’»)]*$'))) > 0 as inside,
    regexp_matches(lower(line), 'accept cookies|all rights reserved|click here|enable javascript|lorem ipsum|privacy policy|sign up for our newsletter|skip to content|terms of use|use of cookies') as furniture
  from worded
), clean as (
  select doc_id, sum(lw) filter (where not (
    (nav > 0 and nav >= 0.15 * lw) or (sym > 0 and sym >= 0.1 * chars) or (lw >= 3 and shouts >= 0.5 * lw)
    or (not ended and (lw < 20 or not inside)) or furniture)) as clean_words
  from judged group by doc_id
), f as (
  select n.doc_id, n.n_words,
    length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(l) - len(list_distinct(l)) as n_dup_lines,
    coalesce(c.n_repeat_words, 0) as n_repeat_words, cast(coalesce(k.clean_words, 0) as bigint) as clean_words
  from n left join covered c using (doc_id) left join clean k using (doc_id)
)
select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not (n_words - clean_words > 0.5 * n_words) as kept
from f
"""
