"""Quality of cleaned text against its raw form, gates, and display buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import filled, let, noisy, score, words

TARGET, SCORE_WEIGHT, KEPT_WEIGHT = 0.85, 0.7, 0.3


def to_places(x: Column, places: int = 4) -> Column:
    """Rounded half up in binary arithmetic, so that any engine gives the same number."""
    return F.floor(x * 10**places + 0.5) / 10**places


def report(raw: Column, clean: Column) -> dict[str, Column]:
    """Measures, rounded to four places, and the percentage, as named columns."""
    raw, clean = filled(raw), filled(clean)
    kept = F.least(words(clean) / F.greatest(words(raw), F.lit(1)), F.lit(1.0))
    return {
        "raw_words": words(raw), "cleaned_words": words(clean), "raw_quality": to_places(score(raw)), "cleaned_quality": to_places(score(clean)),
        "improvement": to_places(score(clean) - score(raw)), "target_met": score(clean) >= TARGET,
        "confidence_pct": F.round((score(clean) * SCORE_WEIGHT + kept * KEPT_WEIGHT) * 100, 1), "word_retention": to_places(kept),
    }


def needs_correction(c: Column, confidence: Column) -> Column:
    return noisy(filled(c)) | let(score(c), lambda s: (F.least(confidence, s) < 0.65) | (s < 0.70))


def accuracy_bucket(pct: Column) -> Column:
    return F.when(pct >= 90, "green").when(pct >= 75, "amber").otherwise("red")
