"""Scores, probabilities and vectors as Column expressions. Results aren't rounded; round where they are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and the score of each status.
WEIGHTS = {"date": 0.20, "event": 0.20, "detail": 0.15, "location": 0.10, "nli": 0.15, "quality": 0.15, "similarity": 0.05}
DATE_SCORES = {"match": 1.0, "same_day_published": 0.85, "same_year": 0.45, "unknown": 0.30, "different": 0.0}
EVENT_SCORES = {"strong": 1.0, "moderate": 0.55, "weak": 0.15, "none": 0.0}
CLASS_CEILINGS = {"SUPPORT": 0.95, "CONTRADICTION": 0.95, "RELATED_CONTEXT": 0.25, "NON_EVIDENCE": 0.02}
MODE_CEILINGS = {"search_extract": 0.80, "search_snippet": 0.45}


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Into [low, high]; null gives low."""
    # greatest and least pass over nulls
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c.cast("double"), F.lit(low))))


def _lookup(c: Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def evidence_score(similarity: Column, label: Column, nli: Column, quality: Column, date: Column, event: Column, detail: Column, location: Column, has_location: Column, debunking: Column) -> Column:
    kind = F.lower(F.trim(F.coalesce(label, F.lit("neutral"))))
    s = (
        _lookup(date, DATE_SCORES, 0.30) * WEIGHTS["date"]
        + _lookup(event, EVENT_SCORES, 0.15) * WEIGHTS["event"]
        + clamp(detail) * WEIGHTS["detail"]
        + F.when(F.coalesce(has_location, F.lit(True)) & ~F.coalesce(location, F.lit(False)), 0.0).otherwise(1.0) * WEIGHTS["location"]
        + F.when(kind.isin("entailment", "contradiction"), clamp(nli)).otherwise(0.0) * WEIGHTS["nli"]
        + clamp(quality) * WEIGHTS["quality"]
        + clamp((F.coalesce(similarity, F.lit(0.0)) + 1) / 2) * WEIGHTS["similarity"]
    )
    s = F.when((date == "different") & ~F.coalesce(debunking, F.lit(False)), s * 0.5).otherwise(s)
    return clamp(F.when(kind == "neutral", s * 0.45).otherwise(s))


def capped(score: Column, evidence_class: Column, mode: Column) -> Column:
    """A score under the ceilings of its class and of the mode of retrieval."""
    return F.least(clamp(score), _lookup(evidence_class, CLASS_CEILINGS, 0.5), _lookup(mode, MODE_CEILINGS, 1.0))


def calibrated(p: Column, temperature: Column | float) -> Column:
    """Temperature scaling of a probability, clipped off 0 and 1."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return 1 / (1 + F.exp(-F.log(q / (1 - q)) / (temperature if isinstance(temperature, Column) else F.lit(temperature))))


def strength(score: Column) -> Column:
    return F.when(score.isNull(), "Not scored").when(score >= 0.75, "Strong").when(score >= 0.5, "Moderate").when(score > 0, "Weak").otherwise("None")


def consistency(cosine: Column) -> Column:
    return clamp((cosine + 1) / 2) * 100


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null, has no length or another size."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def hamming(a: Column, b: Column) -> Column:
    """Of two hashes held as bigint."""
    return F.bit_count(a.bitwiseXOR(b))
