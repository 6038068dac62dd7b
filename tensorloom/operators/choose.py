"""Size-driven choices as plain aggregates: one candidate a record, the cheapest wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cheapest(candidates: DataFrame, *keys: str) -> DataFrame:
    """``(keys..., mode, cost)`` from ``(keys..., mode, rank, cost)``: least cost, ties to the lower rank."""
    best = F.min(F.struct("cost", "rank", "mode"))
    return candidates.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col("best.mode").alias("mode"), F.col("best.cost").alias("cost"))


def ratio(original, compressed):
    """original / max(compressed, 1) as a double column."""
    return original.cast("double") / F.greatest(compressed.cast("double"), F.lit(1.0))


def formatted(value):
    """A ratio with two decimals and a multiplication sign."""
    return F.concat(F.format_string("%.2f", value), F.lit("×"))
