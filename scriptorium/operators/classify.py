"""Printed, handwritten or mixed, by votes of four measures of a page image."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Measure, bounds of its bins, weight, and whether low values speak for print.
VOTES = (("edge_density", 0.05, 0.10, 1.0, False), ("height_variance", 0.20, 0.40, 1.2, True), ("connectivity", 0.005, 0.015, 0.8, True), ("stroke_cov", 0.25, 0.50, 1.0, True))
WIN, LEAST = 0.65, 0.5


def decision() -> tuple[Column, Column]:
    """(doc_type, confidence) of the columns that VOTES names."""
    printed = F.lit(0.0)
    for name, low, high, weight, print_low in VOTES:
        ends = (weight, 0.0) if print_low else (0.0, weight)
        printed = printed + F.when(F.col(name) < low, ends[0]).when(F.col(name) < high, weight / 2).otherwise(ends[1])
    total = sum(v[3] for v in VOTES)
    p, h = printed / total, (F.lit(total) - printed) / total
    kind = F.when(p > WIN, "printed").when(h > WIN, "handwritten").otherwise("mixed")
    sure = F.when(p > WIN, p).when(h > WIN, h).otherwise(1 - F.abs(p - h))
    return kind, F.least(F.greatest(sure, F.lit(LEAST)), F.lit(1.0))


def route(doc_type: Column) -> Column:
    """Which recognisers a page goes to: printed for none named, mixed for anything unknown."""
    name = F.lower(F.trim(doc_type))
    return F.when(doc_type.isNull() | (doc_type == ""), "printed").when(name.isin("printed", "handwritten"), name).otherwise("mixed")
