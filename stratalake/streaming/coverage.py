"""Coverage of cells over time as a stream: an extension beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_coverage(events: DataFrame, width: str = "1 day", late: str = "2 hours", key: str = "pixel", value: str = "value") -> DataFrame:
    """Per time window and cell: rows and valid rows; state is dropped once the watermark has passed a window. Works on streams and on tables."""
    seen = F.nanvl(F.col(value), F.lit(None).cast("double"))
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), key)
    return grouped.agg(F.count("*").alias("n"), F.count(F.when(seen != 0, 1)).alias("filled")).select(F.col("w.start").alias("start"), key, "n", "filled")
