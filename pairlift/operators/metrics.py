"""Counters of a run, by their usual names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _named(one: DataFrame, name: str) -> DataFrame:
    """(name, value) from the columns of a single row."""
    each = F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").cast("long").alias("v")) for c in one.columns])
    return one.select(F.explode(each).alias("e")).select(f"e.{name}", "e.v")


def run_metrics(rows: DataFrame, deltas: DataFrame, touched: DataFrame | None = None, observed: DataFrame | None = None, late: str = "UserInteractionCounterLateElements") -> DataFrame:
    """(metric, value); ``rows`` has late.

    Without samples the observed pairs are the deltas and the touched rows are theirs, so one pass over them gives all; with
    samples ``observed`` has a row with the pairs that new slots formed (value), and the row sums also count what was taken back.
    """
    per_row = deltas.groupBy("w", "item").agg(F.sum("delta").alias("delta"))
    sums = per_row.agg(F.coalesce(F.sum("delta"), F.lit(0)).alias("RowSumProcessWindowRowSum"), F.count("*").alias("ItemRowRescorerRescoredItems"))
    if touched is not None:
        sums = sums.drop("ItemRowRescorerRescoredItems").crossJoin(touched.agg(F.count("*").alias("ItemRowRescorerRescoredItems")))  # single rows
    name = "UserInteractionCounterObservedCooccurrences"
    sums = sums.withColumn(name, F.col("RowSumProcessWindowRowSum")) if observed is None else sums.crossJoin(observed.select(F.col("value").alias(name)))
    one = rows.agg(F.count_if("late").alias(late)).crossJoin(sums)
    return _named(one, "metric").withColumnRenamed("v", "value")


def observed_pairs(drawn: DataFrame, most: int) -> DataFrame:
    """(value): the ordered pairs that interactions form when they fill a slot, twice the slots filled before each."""
    return drawn.where(F.col("nth") <= most).agg(F.coalesce(F.sum(2 * (F.col("nth") - 1)), F.lit(0)).alias("value"))


def violations(deltas: DataFrame, cells: DataFrame) -> DataFrame:
    """(invariant, violations): symmetry, row sums, total and k22 >= 0; all should be 0."""
    upper = F.col("item") < F.col("other")
    two = deltas.where("item <> other").groupBy("w", F.least("item", "other").alias("a"), F.greatest("item", "other").alias("b"))
    odd = two.agg(F.sum(F.when(upper, F.col("delta"))).alias("x"), F.sum(F.when(~upper, F.col("delta"))).alias("y"))
    odd = odd.agg(F.count_if(~F.col("x").eqNullSafe(F.col("y"))).alias("symmetry"))
    bad = (F.col("n") + 3 * F.col("k11") - F.col("row_sum") - F.col("other_sum") < 0) | (F.col("k11") < 0)
    sums = cells.groupBy("item").agg(F.sum("k11").alias("s"), F.first("row_sum").alias("row_sum"), F.max("n").alias("n"), F.count_if(bad).alias("bad"))
    rest = sums.agg(
        F.count_if(F.col("s") != F.col("row_sum")).alias("row_sums"), F.when(F.sum("row_sum") != F.max("n"), 1).otherwise(0).alias("total"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k22")
    )
    return _named(odd.crossJoin(rest), "invariant").withColumnRenamed("v", "violations")  # single rows
