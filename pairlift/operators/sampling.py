"""Item cut and per-user reservoir, in closed form over all windows (without feedback between windows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlift.functions.scores import draw


def _nth(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Adds ``name``: the rank from 1 of a row among those of its key in the order (w, pos).

    Counts per (key, w) give each window's base, so a sort covers one window of a key, not all of them.
    """
    counts = rows.groupBy(key, "w").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("w").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(key, "w", F.coalesce(before, F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy(key, "w").orderBy("pos"))
    return rows.withColumn("own", own).join(counts, [key, "w"]).withColumn(name, F.col("base") + F.col("own")).drop("own", "base")


def item_cut(rows: DataFrame, most: int) -> DataFrame:
    """Adds sampled: the first ``most`` interactions of an item, by window and arrival."""
    return _nth(rows, "item", "item_nth").withColumn("sampled", F.col("item_nth") <= most).drop("item_nth")


def item_counters(rows: DataFrame, most: int) -> DataFrame:
    """(w, item, n): the item counters after each window."""
    counts = rows.groupBy("item", "w").agg(F.count("*").alias("c"))
    up_to = Window.partitionBy("item").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("w", "item", F.least(F.sum("c").over(up_to), F.lit(most)).alias("n"))


def user_totals(rows: DataFrame) -> DataFrame:
    """Adds total: the user's interactions so far, sampled or not."""
    return _nth(rows, "user", "total")


def slot_of(nth: Column, total: Column, user: Column, most: int, seed: int) -> Column:
    """The reservoir slot of a user's nth sampled interaction; ``most`` or above: rejected."""
    return F.when(nth <= most, nth - 1).otherwise(draw(seed, user, total))


def reservoir(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """Adds nth, slot and accepted to the sampled rows of ``rows`` (with total)."""
    found = _nth(rows.where("sampled"), "user", "nth")
    found = found.withColumn("slot", slot_of(F.col("nth"), F.col("total"), F.col("user"), most, seed))
    return found.withColumn("accepted", F.col("slot") < most)


def slots(drawn: DataFrame) -> DataFrame:
    """(user, slot, item, total): who sits where in the end."""
    return drawn.where("accepted").groupBy("user", "slot").agg(F.max_by("item", "total").alias("item"), F.max("total").alias("total"))


def rejected(drawn: DataFrame) -> DataFrame:
    """(w, item, n): sampled interactions that found no slot; their items' counters go down by n."""
    return drawn.where("not accepted").groupBy("w", "item").agg(F.count("*").alias("n"))


def occupancy(drawn: DataFrame) -> DataFrame:
    """(user, slot, item, t_in, t_out, w_in, w_out): how long each accepted interaction keeps its slot."""
    after = Window.partitionBy("user", "slot").orderBy("total")
    return drawn.where("accepted").select(
        "user", "slot", "item", F.col("total").alias("t_in"), F.lead("total").over(after).alias("t_out"), F.col("w").alias("w_in"), F.lead("w").over(after).alias("w_out")
    )


def sampled_deltas(stays: DataFrame) -> DataFrame:
    """(w, item, other, delta) of the reservoirs' matrix.

    Two stays of a user that overlap in different slots add 1 where the later begins and take it back where
    the first ends.  Sums of zero stay: the cell exists.
    """
    a, b = stays.alias("a"), stays.alias("b")
    end = F.lit((1 << 62))
    meet = (F.col("a.user") == F.col("b.user")) & (F.col("a.slot") < F.col("b.slot"))
    meet &= (F.col("a.t_in") < F.coalesce("b.t_out", end)) & (F.col("b.t_in") < F.coalesce("a.t_out", end))
    first_end = F.least("a.t_out", "b.t_out")  # nulls do not count
    w_end = F.when(F.col("a.t_out").eqNullSafe(first_end), F.col("a.w_out")).otherwise(F.col("b.w_out"))
    pairs = a.join(b, meet).select(F.greatest("a.w_in", "b.w_in").alias("w_in"), w_end.alias("w_out"), F.col("a.item").alias("i"), F.col("b.item").alias("j"))
    signs = F.array(F.struct(F.col("w_in").alias("w"), F.lit(1).alias("x")), F.struct(F.col("w_out").alias("w"), F.lit(-1).alias("x")))
    each = pairs.select("i", "j", F.explode(signs).alias("s")).where("s.w is not null")
    half = each.groupBy("s.w", F.least("i", "j").alias("item"), F.greatest("i", "j").alias("other")).agg(F.sum("s.x").alias("x"))
    both = F.array(F.struct(F.col("item").alias("item"), F.col("other").alias("other")), F.struct(F.col("other").alias("item"), F.col("item").alias("other")))
    return half.select("w", F.explode(both).alias("p"), "x").groupBy("w", "p.item", "p.other").agg(F.sum("x").alias("delta"))


def sampled_touched(drawn: DataFrame, stays: DataFrame) -> DataFrame:
    """(w, item): for each user who accepted in w, the items in slots before w and those accepted in w.

    A user's very first interaction, if it is alone in its window, touches nothing.
    """
    active = drawn.where("accepted").groupBy("user", "w").agg(F.count("*").alias("c"), F.min("nth").alias("nth")).where("c > 1 or nth > 1")
    own = drawn.where("accepted").select("user", "w", "item").join(active.select("user", "w"), ["user", "w"])
    a, s = active.alias("a"), stays.alias("s")
    before = (F.col("a.user") == F.col("s.user")) & (F.col("s.w_in") < F.col("a.w")) & (F.coalesce("s.w_out", F.lit((1 << 62))) >= F.col("a.w"))
    held = a.join(s, before).select("a.w", "s.item")
    return own.select("w", "item").union(held).distinct()
