"""Scoring formulas shared by retrieval, maintenance and consolidation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions.text import query_words

DAY_MICROS = 86_400_000_000


def exact_avg(value) -> Column:
    """Mean of doubles that does not depend on their order: they are summed as decimals."""
    value = F.col(value) if isinstance(value, str) else value
    return F.sum(value.cast("decimal(38,15)")).cast("double") / F.count(value)


def timestamp(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def days_between(ts: Column, as_of) -> Column:
    return (F.unix_micros(timestamp(as_of)) - F.unix_micros(ts)) / F.lit(float(DAY_MICROS))


def recency(ts: Column, as_of, half_life: float = 30.0) -> Column:
    return F.exp(F.lit(-0.693) * days_between(ts, as_of) / F.lit(half_life))


def effective_confidence(confidence: Column, ts: Column, as_of) -> Column:
    decayed = confidence * F.exp(F.lit(-0.02) * days_between(ts, as_of))
    return F.greatest(F.lit(0.1), decayed)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def half_if_missing(value: Column) -> Column:
    """Missing and zero both mean "unknown" and read as one half."""
    return F.coalesce(F.nullif(value, F.lit(0.0)), F.lit(0.5))


def text_match(query_lower: Column, fields: list[Column]) -> Column:
    """.9 for the whole query inside a field, else .8 times the share of its words."""
    words = query_words(query_lower)

    def score(field: Column) -> Column:
        low = F.lower(field)
        matched = F.size(F.filter(words, lambda w: low.contains(w)))
        share = matched / F.greatest(F.size(words), F.lit(1))
        phrase = F.when(low.contains(query_lower), 0.9).otherwise(0.0)
        return F.when(F.length(field) > 0, F.greatest(phrase, share * 0.8))

    scores = [score(f) for f in fields]
    if len(scores) == 1:
        return F.coalesce(scores[0], F.lit(0.0))
    return F.coalesce(F.greatest(*scores), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; 0 for a zero vector."""
    def dot(x, y):
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    checked = F.when(
        F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")
    )
    return checked.otherwise(F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm))
