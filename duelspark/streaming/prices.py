"""Price monitoring on a stream: the batch expressions over watermarked event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N


def windowed_overround(stream: DataFrame, time: str, odds: tuple[str, str], every: str = "1 day", late: str = "2 days", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows with valid prices per window (and keys): count, mean, least and greatest overround.

    State is one row per open window and key; rows later than the watermark are left out."""
    a, b = (F.col(c) for c in odds)
    priced = stream.filter(N.odds_pair_valid(a, b)).withColumn("overround", N.overround(a, b)).withWatermark(time, late)
    grouped = priced.groupBy(F.window(time, every), *keys).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("overround").alias("mean_overround"), F.min("overround").alias("min_overround"), F.max("overround").alias("max_overround")
    )
    return grouped.select(F.col("window.start").alias("window_start"), *keys, "rows", "mean_overround", "min_overround", "max_overround")
