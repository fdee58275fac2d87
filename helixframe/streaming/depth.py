"""Extension: call rates of samples over a stream of events, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_depth(events: DataFrame, window: str = "1 day", late: str = "2 days", threshold: float = 0) -> DataFrame:
    """(window, sample, n, call_rate, mean_depth) of events (ts, sample, depth)."""
    ok = F.when(F.col("depth") > threshold, F.col("depth"))
    g = events.withWatermark("ts", late).groupBy(F.window("ts", window), "sample")
    return g.agg(F.count("*").alias("n"), (F.count(ok) / F.count("*")).alias("call_rate"), F.avg(ok).alias("mean_depth"))
