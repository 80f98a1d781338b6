"""Ranking kernels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults of the ranking contract.
HALF_LIFE_SECONDS = 30 * 86400.0
SUPERSEDED_PENALTY = 0.05
SUMMARY_PENALTY = 0.5
LOW_CONFIDENCE_TYPES = ("progress", "system")
LOW_CONFIDENCE = 0.5
RRF_K = 60


def sigmoid(x: Column) -> Column:
    """X20. Stable on both sides: the exponent is never positive."""
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def recency_decay(age_seconds: Column, half_life: float = HALF_LIFE_SECONDS) -> Column:
    """X21. Halves each half-life; the future counts as now."""
    if half_life <= 0:
        raise ValueError("the half-life must be positive")
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_seconds) / half_life)


def compose_score(relevance: Column, age_seconds: Column, confidence: Column, superseded: Column, tier: Column, half_life: float = HALF_LIFE_SECONDS) -> Column:
    """X22. Product of all signals."""
    return relevance * recency_decay(age_seconds, half_life) * confidence * F.when(superseded, SUPERSEDED_PENALTY).otherwise(1.0) * F.when(tier == "primary", 1.0).otherwise(SUMMARY_PENALTY)


def confidence(type_: Column) -> Column:
    """X23."""
    return F.when(type_.isin(*LOW_CONFIDENCE_TYPES), LOW_CONFIDENCE).otherwise(1.0)


def timestamp_ms(text: Column) -> Column:
    """X24. ISO text to epoch milliseconds; null if it is none."""
    return F.unix_millis(F.try_to_timestamp(text))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """X25 in double precision; null for a zero vector."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def estimate_tokens(text: Column) -> Column:
    """X12."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")
