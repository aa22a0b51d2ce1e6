"""Scores of cells and the best partners of an item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlift.functions.scores import contingency, llr


def score_cells(cells: DataFrame, kind: str = "observed", decimals: int | None = None) -> DataFrame:
    """Adds k12, k21, k22 and score to cells with k11, row_sum, other_sum and n.

    ``decimals`` rounds the scores, so that the last bits of a logarithm decide nothing where results of several engines are compared.
    """
    _, k12, k21, k22 = contingency(F.col("k11"), F.col("row_sum"), F.col("other_sum"), F.col("n"), kind)
    cells = cells.withColumns({"k12": k12, "k21": k21, "k22": k22})
    score = llr(*[F.col(c) for c in ("k11", "k12", "k21", "k22")])
    return cells.withColumn("score", score if decimals is None else F.round(score, decimals))


def with_sums(totals: DataFrame) -> DataFrame:
    """Adds row_sum, other_sum and n to all-time cells (item, other, k11).

    The sums are as many as the items; AQE broadcasts them if their size at run time allows it.
    """
    sums = totals.groupBy("item").agg(F.sum("k11").alias("row_sum"))
    n = sums.agg(F.sum("row_sum").alias("n"))  # one row
    other = sums.select(F.col("item").alias("other"), F.col("row_sum").alias("other_sum"))
    return totals.join(sums, "item").join(other, "other").join(F.broadcast(n))


#: Parts that the cells of a partner are dealt out to when its row sums are looked up.
SPREAD = 8


def window_cells(deltas: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """For each touched (w, item), or each that has deltas: the cells of its row, with row sums and total as they stand after w.

    An item's touched windows are numbered.  A cell's count stands from the window of a delta until that of the next one,
    so it is written out for the numbers in between, and a number leads to its window: as many rows as come out.
    The partner's row sum is the last one up to the window, found in one pass over its cells and its sums in order.
    """
    steps = deltas.groupBy("item", "w").agg(F.sum("delta").alias("change"))
    if touched is None:
        steps = steps.withColumn("t", F.lit(1))
    else:
        none = F.lit(0).cast("long").alias("change")
        steps = steps.withColumn("t", F.lit(0)).unionByName(touched.select("item", "w", none, F.lit(1).alias("t")))
        steps = steps.groupBy("item", "w").agg(F.sum("change").alias("change"), F.max("t").alias("t"))
    own = Window.partitionBy("item").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    # nth: how many touched windows of the item come before
    steps = steps.select("item", "w", "t", "change", (F.sum("t").over(own) - F.col("t")).alias("nth"), F.sum("t").over(Window.partitionBy("item")).alias("all"), F.sum("change").over(own).alias("row_sum"))
    cell = Window.partitionBy("item", "other").orderBy("w")
    state = deltas.join(steps.select("item", "w", "nth", "all"), ["item", "w"]).select(
        "item", "other", F.sum("delta").over(cell.rowsBetween(Window.unboundedPreceding, 0)).alias("k11"), "nth", F.coalesce(F.lead("nth").over(cell), F.col("all")).alias("until")
    )
    state = state.where("nth < until").select("item", "other", "k11", F.explode(F.sequence("nth", F.col("until") - 1)).alias("nth"))
    cells = state.join(steps.where("t = 1").select("item", "nth", "w", "row_sum"), ["item", "nth"])
    part = F.pmod(F.xxhash64("item"), F.lit(SPREAD))
    empty = F.lit(None).cast("long")
    sums = steps.where("change <> 0").select(F.col("item").alias("other"), "w", empty.alias("item"), empty.alias("k11"), empty.alias("row_sum"), F.col("row_sum").alias("stands"), F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    both = cells.select("other", "w", "item", "k11", "row_sum", empty.alias("stands"), part.cast("int").alias("part")).unionByName(sums)
    up_to = Window.partitionBy("other", "part").orderBy("w", F.col("stands").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("other_sum", F.coalesce(F.last("stands", ignorenulls=True).over(up_to), F.lit(0))).where("item is not null")
    # a row per window; broadcast if that is small
    n = steps.groupBy("w").agg(F.sum("change").alias("change")).select("w", F.sum("change").over(Window.orderBy("w").rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    return both.join(n, "w").select("w", "item", "other", "k11", "row_sum", "other_sum", "n")


def top_k(scored: DataFrame, k: int, by: tuple[str, ...] = ("item",)) -> DataFrame:
    """The k best of each group, ties to the smaller other, as rank 1 to k."""
    if k <= 0:
        raise ValueError("k has to be positive")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("other")))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def latest(ranked: DataFrame) -> DataFrame:
    """Of per-window rankings, each item's last one: rows not touched since keep theirs."""
    last = F.max("w").over(Window.partitionBy("item"))
    return ranked.withColumn("last", last).where("w = last").drop("last")
