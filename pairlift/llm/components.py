"""Connected components by alternating large-star and small-star steps, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlift.llm.common import stash


def _measure(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
    return int(row.n), int(row.h)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each end of ``edges`` (two BIGINT columns); root is the least node of its component.

    A node's least neighbour comes from a grouped minimum, which tasks combine before the shuffle; no
    task gathers a node's neighbours.  Each step is written to the shared folder, so lineage stays short.
    The number of steps grows with the logarithm of the longest path.
    """
    a, b = edges.columns
    edges = stash(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"), "edges")
    before = _measure(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # both ends of a small step: the least smaller neighbour takes the others and the node itself
        large = stash(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        edges = stash(small.distinct(), "edges")
        after = _measure(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
