"""Scoring of pairs as they arrive: every expression works on one row, so no state and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.composite import likeness


def score_stream(pairs: DataFrame, left: str = "m1", right: str = "m2", threshold: float | None = None) -> DataFrame:
    """``pairs``, streamed or not, with their likeness from 0 to 100 and, given a threshold, whether it is reached."""
    made = likeness(pairs, left, right, "likeness")
    return made if threshold is None else made.withColumn("reached", F.col("likeness") >= threshold)


def windowed_counts(scored: DataFrame, time: str, length: str = "1 hour", late: str = "1 day", threshold: float = 80.0) -> DataFrame:
    """Pairs and pairs at the threshold by window; rows later than ``late`` are left out."""
    held = scored.withWatermark(time, late).groupBy(F.window(time, length))
    return held.agg(F.count("*").alias("pairs"), F.sum((F.col("likeness") >= threshold).cast("int")).alias("reached"))
