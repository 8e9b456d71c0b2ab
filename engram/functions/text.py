"""Column helpers for text: lexicon counts, JS-compatible words, pattern lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_regex(pattern: str) -> str:
    """Java's ``\\b`` follows Unicode; the lexicons mean the ASCII boundary."""
    return pattern.replace(r"\b", WORD_EDGE)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(ascii_regex(pattern))


def matches_any(text: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    prefix = "(?i)" if ignore_case else ""
    return any_of([matches(text, prefix + p) for p in patterns])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def count_contained(text: Column, words: list[str]) -> Column:
    """How many list entries occur in ``text`` as substrings (repeats count)."""
    return reduce(
        lambda a, b: a + b, [text.contains(F.lit(w)).cast("int") for w in words]
    )


def contains_any(text: Column, words: list[str]) -> Column:
    return any_of([text.contains(F.lit(w)) for w in words])


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def labels_where(pairs: list[tuple[Column, str]]) -> Column:
    """The labels whose condition holds, in list order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(label)) for cond, label in pairs]))


def query_words(lowered: Column, longer_than: int = 2) -> Column:
    return F.filter(F.split(lowered, r"\s+"), lambda w: F.length(w) > longer_than)


def first_match(rules: list[tuple[Column, object]], otherwise: object) -> Column:
    out = F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise
    for cond, value in reversed(rules):
        out = F.when(cond, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def distinct_ignoring_case(values: Column) -> Column:
    """Drop later values that equal an earlier one when lower-cased."""
    lowered = F.transform(values, lambda v: F.lower(v))
    return F.filter(
        values, lambda v, i: F.array_position(lowered, F.lower(v)) == (i + 1).cast("long")
    )


def extract_phrases(text: Column, patterns: list[str], longer_than: int) -> Column:
    """Group 1 of every pattern, in pattern order, trimmed, long enough, first kept."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])
    trimmed = F.transform(found, lambda v: F.regexp_replace(v, r"^\s+|\s+\z", ""))
    return distinct_ignoring_case(F.filter(trimmed, lambda v: F.length(v) > longer_than))


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def round_down_to(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def one_of_chars(chars: str) -> str:
    """A character class by code point (variation selectors are not characters here)."""
    return "[" + "".join(c for c in chars if c != "️") + "]"


def no_strings() -> Column:
    return F.array().cast("array<string>")
