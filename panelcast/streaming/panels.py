"""A panel from a stream of fact rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_panel(facts: DataFrame, width: str, delay: str) -> DataFrame:
    """(series_id, at, value): sums of (series_id, at, amount) rows over tumbling windows, each given out once, when no row more than ``delay`` late can change it; later rows are dropped."""
    timed = facts.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay)
    sums = timed.groupBy("series_id", F.window("at", width).alias("w")).agg(F.round(F.sum("amount"), 4).alias("value"))
    return sums.select("series_id", F.col("w.start").alias("at"), "value")
