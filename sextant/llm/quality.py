"""Quality rules: a threshold table compiled into one projection of built-in functions.

Each rule bounds a ratio of lengths, symbols, stop words or lines. The table is data;
:func:`verdict` turns it into one boolean column, so the rules run inside the scan stage,
without a shuffle and without Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import let, words

SYMBOLS = r"[#*$%&|<>]"

# fixed values: frequent function words of the languages of the corpus
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "was", "on", "are", "as", "with", "be", "by", "at",
    "this", "from", "or", "an", "not", "have", "has",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "que", "qui", "dans", "pour", "pas", "sur", "en",
    "au", "avec", "par",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein",
    "eine", "als", "auch", "für",
    "el", "los", "las", "y", "del", "se", "por", "con", "una", "para", "su", "al", "lo", "como", "más", "o", "no", "es",
)


@dataclass(frozen=True)
class Rule:
    """``low <= numerator / denominator <= high``; an open side is None."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_chars", "word_chars", "n_words", low=2.0, high=20.0),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.25),
    Rule("stop_words_per_word", "n_stop_words", "n_words", low=0.02),
    Rule("dup_lines_per_line", "n_dup_lines", "n_lines", high=0.5),
)
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _windows(w: Column) -> Column:
    """Hashes of all 3-word windows."""
    last = F.size(w) - F.lit(2)
    return F.when(last < 1, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
        lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))))


def _twins(by_hash: Column) -> Column:
    """Start positions, ascending, of the windows whose hash a neighbour in hash order shares."""
    n = F.size(by_hash)
    same = F.filter(by_hash, lambda e, k: (
        (k > 0) & (F.get(by_hash, k - 1)["h"] == e["h"]) | (k < n - 1) & (F.get(by_hash, k + 1)["h"] == e["h"])))
    return F.sort_array(F.transform(same, lambda e: e["p"]))


def _covered(starts: Column) -> Column:
    """Words under the 3-word windows that begin at ``starts`` (ascending)."""
    n = F.size(starts)
    return F.aggregate(
        F.transform(starts, lambda p, k: F.when(
            k < n - 1, F.least(F.lit(3), F.get(starts, k + 1) - p)).otherwise(F.lit(3))),
        F.lit(0), lambda acc, x: acc + x)


def measures(text: Column, check: Callable[[Column], Column]) -> Column:
    """``check`` of the measured counts of a text: a struct of long fields, never null.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a word),
    n_dup_lines (those equal to an earlier line), n_stop_words, n_repeat_words (words under
    3-word windows that occur twice or more). A null, empty or blank text counts zero
    everywhere. Everything is one expression whose intermediate arrays are bound once, so a
    filter on it may be moved freely.
    """
    body = F.coalesce(text, F.lit(""))

    def repeated(h: Column) -> Column:
        # sorting is left out where no window is repeated
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
            lambda by_hash: let(_twins(by_hash), _covered)))

    def counted(w: Column, lines: Column) -> Column:
        fields = {
            "n_words": F.size(w),
            "word_chars": F.aggregate(w, F.lit(0), lambda acc, x: acc + F.length(x)),
            "n_symbols": F.size(F.split(body, SYMBOLS)) - 1,
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_stop_words": F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))),
            "n_repeat_words": let(_windows(w), repeated),
        }
        return F.struct(*[c.cast("long").alias(n) for n, c in fields.items()])

    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(words(body), lambda w: let(lines, lambda x: let(counted(w, x), check)))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean for a rule table; a ratio without a denominator breaks no rule.

    Bounds are compared as ``numerator >= low * denominator``, so nothing is divided.
    """
    ok = F.lit(True)
    for rule in rules:
        top, bottom = m[rule.numerator], m[rule.denominator]
        if rule.low is not None:
            ok = ok & (top >= F.lit(rule.low) * bottom)
        if rule.high is not None:
            ok = ok & (top <= F.lit(rule.high) * bottom)
    return ok


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """(doc_id, counts, base_failed, kept) of every row; repeated rows are assessed one by one."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")
    found = measures(F.col(text), lambda m: F.struct(
        *[m[c].alias(c) for c in counts], base_failed(m).alias("base_failed"),
        (~base_failed(m) & verdict(m, rules)).alias("kept")))
    return docs.select("doc_id", found.alias("m")).select("doc_id", "m.*")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass; its columns as they are, whatever their names."""
    return docs.filter(measures(F.col(text), lambda m: ~base_failed(m) & verdict(m, rules)))
