"""Streams of segments: windowed motion per object, with late rows dropped by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import AXES


def windowed_extent(stream: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Rows, time span and box of each object per window; ``stream`` has object_id, ts and coordinates."""
    box = [F.max(c).alias(f"max_{c}") for c in AXES] + [F.min(c).alias(f"min_{c}") for c in AXES]
    grouped = stream.withWatermark("ts", late).groupBy(F.window("ts", window), "object_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), *box)
    return grouped.select("object_id", F.col("window.start").alias("start"), "n", "first", "last", *((F.col(f"max_{c}") - F.col(f"min_{c}")).alias(f"extent_{c}") for c in AXES))
