"""The best of several readings of one text, and merging two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import blank, filled, score, words


def reading_value(c: Column, bonus: float = 0.005) -> Column:
    return score(c) * (1 + bonus * words(filled(c)))


def best_reading(candidates: DataFrame, key: str = "doc_id", bonus: float = 0.005) -> DataFrame:
    """(key, text) of the highest-valued reading that is not blank, the first of equals; empty if all are blank.

    A partial aggregate: no sort, and nothing but one reading a key and task moves.
    """
    value = F.when(~blank(filled(F.col("text"))), F.struct(reading_value(F.col("text"), bonus).alias("v"), (-F.col("ord")).alias("o")))
    best = candidates.groupBy(key).agg(F.max_by("text", value).alias("text"))
    return best.select(key, F.coalesce("text", F.lit("")).alias("text"))


def better_of_two(a: Column, b: Column) -> Column:
    return F.when(reading_value(a, 0.01) >= reading_value(b, 0.01), a).otherwise(b)


def weighted_merge(a: Column, b: Column, weight_a: float = 0.45, weight_b: float = 0.35, band: float = 0.05) -> Column:
    """Both readings, a line each, when their weighted values are close; else the higher one; a blank one loses."""
    a, b = filled(a), filled(b)
    x, y = reading_value(a) * weight_a, reading_value(b) * weight_b
    both = F.when(F.abs(x - y) < band, F.concat_ws("\n", a, b)).when(x >= y, a).otherwise(b)
    return F.when(blank(a), b).when(blank(b), a).otherwise(both)


def region_text(regions: Column, above: float = 0.05, separator: str = "\n") -> Column:
    """Texts of the regions (bbox, text, conf) whose confidence (1 if missing) is high enough, in order."""
    kept = F.filter(regions, lambda r: (F.coalesce(r["conf"], F.lit(1.0)) > above) & ~blank(filled(r["text"])))
    return F.array_join(F.transform(kept, lambda r: F.trim(r["text"])), separator)


def padded_box(bbox: Column, width: Column, height: Column) -> Column:
    """The upright box around a region's corners, padded by 15 % of its height or 6, within the image."""
    xs, ys = F.transform(bbox, lambda p: p["x"]), F.transform(bbox, lambda p: p["y"])
    pad = F.greatest(F.lit(6), ((F.array_max(ys) - F.array_min(ys)) * 0.15).cast("int"))
    return F.struct(
        F.greatest(F.lit(0), F.array_min(xs) - pad).alias("x1"), F.greatest(F.lit(0), F.array_min(ys) - pad).alias("y1"),
        F.least(width, F.array_max(xs) + pad).alias("x2"), F.least(height, F.array_max(ys) + pad).alias("y2"),
    )
