"""Tumbling windows, the running watermark and late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one task numbers or scans in order; see running_watermark().
CHUNK = 1 << 16


def assign_windows(rows: DataFrame, window_ms: int) -> DataFrame:
    """Adds w, the start of the epoch-aligned window [w, w + window_ms) of ts_ms."""
    return rows.withColumn("w", F.col("ts_ms") - F.pmod(F.col("ts_ms"), F.lit(window_ms).cast("long")))


def _before(most: DataFrame, chunk: int, levels: int) -> DataFrame:
    """(chunk, prior): the greatest of the chunks before each, from (chunk, most)."""
    ahead = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    if levels <= 0:
        return most.select("chunk", F.max("most").over(ahead).alias("prior"))
    most = most.withColumn("group", F.floor(F.col("chunk") / chunk))
    groups = most.groupBy(F.col("group").alias("chunk")).agg(F.max("most").alias("most"))
    groups = _before(groups, chunk, levels - 1).select(F.col("chunk").alias("group"), F.col("prior").alias("earlier"))
    own = F.max("most").over(Window.partitionBy("group").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    return most.withColumn("own", own).join(groups, "group").select("chunk", F.greatest("own", "earlier").alias("prior"))


def running_watermark(rows: DataFrame, chunk: int = CHUNK, before: int | None = None, levels: int = 1) -> DataFrame:
    """Adds watermark: the greatest ts_ms of earlier arrivals less 1 ms, null for the first.

    Ranges of ``pos`` are chunks of bounded size; a chunk starts with the greatest of the chunks before it, and these come from
    chunks of chunks, ``levels`` times over.  A task orders at most ``chunk`` rows, and at last the chunks that are left: with one level
    and the usual chunk a row for each 2**32 numbers.  Sparse numbers from a wide range want more levels; numbers from
    0 that are dense and of a few chunks do without.  ``before`` is the greatest ts_ms before all rows.
    """
    rows = rows.withColumn("chunk", F.floor(F.col("pos") / chunk))
    prior = _before(rows.groupBy("chunk").agg(F.max("ts_ms").alias("most")), chunk, levels)
    own = F.max("ts_ms").over(Window.partitionBy("chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    high = F.greatest(own, F.col("prior"), F.lit(before).cast("long"))
    return rows.join(prior, "chunk").withColumn("watermark", high - 1).drop("chunk", "prior")


def mark_late(rows: DataFrame) -> DataFrame:
    """Adds late: the row is not after the watermark, even if its window is still open."""
    return rows.withColumn("late", F.coalesce(F.col("ts_ms") <= F.col("watermark"), F.lit(False)))


def on_time(rows: DataFrame) -> DataFrame:
    return mark_late(running_watermark(rows)).where("not late").drop("late", "watermark")
