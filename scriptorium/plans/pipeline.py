"""The whole way of a text: post-process, clean, resolve, correct where needed, format, measure, mine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import filled
from scriptorium.operators import cleaner, entities, formatting, fuzzy, quality, resolver


def corrected(df: DataFrame, text: str = "text", confidence: float = 1.0, vocabulary: tuple[str, ...] = (), kind: str = "auto") -> DataFrame:
    """``df`` with final_text and output_kind of its column ``text``.

    Only texts that need it reach the dictionary corrector; the others go by it as nulls, so every text is resolved once.
    """
    out = df.withColumn("__resolved", resolver.resolve(cleaner.clean(F.col(text))))
    if vocabulary:
        needy = quality.needs_correction(F.col("__resolved"), F.lit(confidence))
        fixed = fuzzy.corrector(vocabulary)(F.when(needy, F.col("__resolved")))
        out = out.withColumn("__resolved", F.coalesce(fixed, F.col("__resolved")))
    chosen = formatting.output_kind(F.col("__resolved")) if kind == "auto" else F.lit(kind)
    out = out.withColumn("output_kind", chosen)
    return out.withColumn("final_text", formatting.formatted(F.col("__resolved"), F.col("output_kind"))).drop("__resolved")


def reported(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """Final text, quality measures, and entities of the final and of the raw text."""
    out = corrected(df, text, **options)
    out = out.withColumns(quality.report(F.col(text), F.col("final_text")))
    return out.withColumns({"entities": entities.entity_map(F.col("final_text")), "raw_entities": entities.entity_map(filled(F.col(text)), whole=True)})
