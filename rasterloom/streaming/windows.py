"""Reducers over a stream of pixels: a slice per time window, late pixels up to a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.maths import col
from rasterloom.functions.reducers import Series


def windowed(pixels: DataFrame, bands: list[str], reducer: Callable, width: str, slide: str | None = None, late: str = "0 seconds") -> DataFrame:
    """``t, y, x`` and bands of each window, stamped with its start.

    ``pixels`` has a TIMESTAMP ``t``; a batch table works as well as a stream.  A pixel that is
    later than ``late`` behind the newest is dropped; state is kept for open windows only.
    The reducer must be one of those that need no order of their input.
    """
    at = F.window("t", width, slide) if slide else F.window("t", width)
    aggs = [col(reducer(Series(F.col(f"`{b}`"), F.col("t")))).cast("double").alias(b) for b in bands]
    out = pixels.withWatermark("t", late).groupBy(at.alias("w"), "y", "x").agg(*aggs)
    return out.select(F.col("w.start").alias("t"), "y", "x", *[f"`{b}`" for b in bands])
