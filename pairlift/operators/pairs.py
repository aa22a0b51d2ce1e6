"""Item pairs of all windows in one plan (exact mode), and the states that follow from them.

A user's slots pair with each other; a pair belongs to the later of its two windows.  With c(u, w, i) the
user's interactions with item i in window w, the pairs of i and j != i in w number sum over users of
c(u, w1, i) c(u, w2, j) with max(w1, w2) = w; so users' repeats are counted before the self-join,
the join makes each unordered pair once, and the mirror image comes after aggregation.

A user with more than ``BLOCK`` counted rows is dealt out in blocks: each pair of blocks is a join key of its own, so
that no task has to pair more than two blocks of one user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Rows of a user that one task pairs with as many others.
BLOCK = 4096


def user_item_counts(rows: DataFrame) -> DataFrame:
    """(user, w, item, c) from (user, item, w)."""
    return rows.groupBy("user", "w", "item").agg(F.count("*").alias("c"))


def mirror(half: DataFrame, value: str) -> DataFrame:
    """Both orders of unordered pairs (w, item, other)."""
    both = F.array(F.struct(F.col("item").alias("item"), F.col("other").alias("other")), F.struct(F.col("other").alias("item"), F.col("item").alias("other")))
    return half.select("w", F.explode(both).alias("p"), value).select("w", "p.item", "p.other", value)


def _paired(a: DataFrame, b: DataFrame, on) -> DataFrame:
    """(w, item, other, x) for each two counts of a user that ``on`` lets meet."""
    return a.join(b, on).select(
        F.greatest("a.w", "b.w").alias("w"), F.least("a.item", "b.item").alias("item"), F.greatest("a.item", "b.item").alias("other"), (F.col("a.c") * F.col("b.c")).alias("x")
    )


def _meet(c: DataFrame) -> DataFrame:
    return _paired(c.alias("a"), c.alias("b"), (F.col("a.user") == F.col("b.user")) & (F.col("a.item") < F.col("b.item")))


def _meet_in_blocks(c: DataFrame) -> DataFrame:
    """As _meet for users with ``blocks``: block i meets the blocks from i on, each under a key of its own."""
    own = F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")
    c = c.withColumn("own", own)
    a = c.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", F.col("blocks") - 1))).alias("a")
    b = c.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), "own"))).alias("b")
    same = (F.col("a.user") == F.col("b.user")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    return _paired(a, b, same & ((F.col("a.i") < F.col("a.j")) | (F.col("a.item") < F.col("b.item"))))


def pair_deltas(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(w, item, other, delta): the ordered pairs that each window adds."""
    c = user_item_counts(rows)
    # counted where the self-join needs the rows anyway
    dealt = c.withColumn("blocks", F.ceil(F.count("*").over(Window.partitionBy("user")) / block).cast("int"))
    met = _meet(dealt.where("blocks = 1")).unionByName(_meet_in_blocks(dealt.where("blocks > 1")))
    half = met.groupBy("w", "item", "other").agg(F.sum("x").alias("delta"))
    own = Window.partitionBy("user", "item").orderBy("w")
    n = F.sum("c").over(own.rowsBetween(Window.unboundedPreceding, 0))
    same = (
        c.withColumn("n", n).withColumn("m", F.col("n") - F.col("c"))
        .select("w", "item", (F.col("n") * (F.col("n") - 1) - F.col("m") * (F.col("m") - 1)).alias("x"))
        .groupBy("w", "item").agg(F.sum("x").alias("delta")).where("delta > 0")
        .select("w", "item", F.col("item").alias("other"), "delta")
    )
    return mirror(half, "delta").unionByName(same)


def pair_totals(rows: DataFrame) -> DataFrame:
    """(item, other, k11) over all windows."""
    return pair_deltas(rows.withColumn("w", F.lit(0).cast("long"))).select("item", "other", F.col("delta").alias("k11"))


def row_sum_deltas(deltas: DataFrame) -> DataFrame:
    """(w, item, delta), without those that come to zero."""
    return deltas.groupBy("w", "item").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def row_sum_state(deltas: DataFrame) -> DataFrame:
    """(w, item, row_sum) for the windows that change an item's row sum."""
    up_to = Window.partitionBy("item").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    return row_sum_deltas(deltas).select("w", "item", F.sum("delta").over(up_to).alias("row_sum"))


def total_state(deltas: DataFrame) -> DataFrame:
    """(w, n): all ordered pairs up to each window; a row per window."""
    per = deltas.groupBy("w").agg(F.sum("delta").alias("delta"))
    return per.select("w", F.sum("delta").over(Window.orderBy("w").rowsBetween(Window.unboundedPreceding, 0)).alias("n"))


def matrix_state(deltas: DataFrame) -> DataFrame:
    """(w, item, other, cnt) for the windows that change a cell; cells that fall back to zero stay."""
    up_to = Window.partitionBy("item", "other").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select("w", "item", "other", F.sum("delta").over(up_to).alias("cnt"))


def touched_rows(deltas: DataFrame) -> DataFrame:
    """(w, item) that received a pair record in w."""
    return deltas.select("w", "item").distinct()
