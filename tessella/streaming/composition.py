"""Compositions and displacement statistics over a stream: counts and sums merge, so a watermark and a window are all that it takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_composition(stream: DataFrame, ts: str, unit: str, celltype: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window start, unit, celltype, n; proportions follow by unit from the emitted counts."""
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), unit, celltype).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col(unit).alias("unit"), F.col(celltype).alias("celltype"), "n")


def windowed_sums(stream: DataFrame, ts: str, unit: str, celltype: str, value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sufficient statistics of the displacement block: sum and count by window, unit and type."""
    out = stream.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), unit, celltype).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col(unit).alias("unit"), F.col(celltype).alias("celltype"), "s", "n")
