"""A windowed count with Spark's own watermark, as the plain Structured Streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(rows: DataFrame, window: str, delay: str = "1 millisecond") -> DataFrame:
    """(w, item, n) of a stream or table of (item, ts_ms).

    In append mode a window is emitted once the watermark has passed its end; the last one stays open at the
    end of input.
    """
    ts = F.timestamp_millis("ts_ms")
    counted = rows.withColumn("ts", ts).withWatermark("ts", delay).groupBy(F.window("ts", window), "item").agg(F.count("*").alias("n"))
    return counted.select(F.unix_millis("window.start").alias("w"), "item", "n")
