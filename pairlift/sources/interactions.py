"""Interactions (user, item, ts_ms, pos) from lines, files, streams and tables.

``pos`` is the arrival order.  It is a column, not a matter of task layout, so that sampling gives the same result for any partitioning.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path`` (a pattern, too); a warning if not."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    if not found:
        warnings.warn(f"no input at {path}", stacklevel=3)
    return bool(found)


def parse_lines(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """user, item, ts_ms from the ``value`` column; fields after the third are ignored.

    A missing or malformed field fails the query (ANSI mode).
    """
    parts = F.split("value", ",", -1)
    return lines.select(*[parts[i].cast("long").alias(n) for i, n in enumerate(("user", "item", "ts_ms"))], *keep)


def from_files(spark: SparkSession, path: str, modified_after: str | None = None, recursive: bool = False) -> DataFrame:
    """All lines under ``path``, files by modification time, lines in file order.

    A missing path is warned of and gives no rows.  The order in a file is that of the byte offsets at which Spark reads it: splits of a
    file have ascending partition ids.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "user long, item long, ts_ms long, pos long")
    reader = spark.read.option("recursiveFileLookup", recursive)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    lines = reader.text(path).select(
        "value", F.col("_metadata.file_modification_time").alias("file_modification_time"),
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
    )
    return with_order(parse_lines(lines.where("value <> ''"), (*PIECE, "line")))


#: What identifies a piece of a file that one task reads, in the order of reading.
PIECE = ("file_modification_time", "file_path", "block")


def with_order(rows: DataFrame, piece: tuple[str, ...] = PIECE, within: str = "line") -> DataFrame:
    """user, item, ts_ms and pos, the rank (from 0) by ``piece`` and, in a piece, by ``within``.

    A piece is numbered on its own; its offset is the row count of the pieces before it, of which there is a row each.
    """
    own = F.row_number().over(Window.partitionBy(*piece).orderBy(within)) - 1
    before = F.sum("n").over(Window.orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1))
    base = rows.groupBy(*piece).agg(F.count("*").alias("n")).select(*piece, F.coalesce(before, F.lit(0)).alias("base"))
    return rows.withColumn("own", own).join(base, list(piece)).select("user", "item", "ts_ms", (F.col("base") + F.col("own")).alias("pos"))


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 1, modified_after: str | None = None, recursive: bool = False) -> DataFrame:
    """A stream of lines, oldest files first: value, file_modification_time, file_path and block."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", recursive)
    lines = (
        reader.text(path)
        .select(
            "value", F.col("_metadata.file_modification_time").alias("file_modification_time"), F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block"),
        )
    )
    # file streams have no option for it
    return lines.where(F.col("file_modification_time") > F.lit(modified_after).cast("timestamp")) if modified_after else lines


def _millis(column: str) -> F.Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events: the user, the item in props.k; in the order of event_id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("long").alias("item"), _millis("ts").alias("ts_ms"), F.col("event_id").alias("pos"))


def _orders(spark: SparkSession, sf_dir: str, user: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet")  # noqa: E741
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col(user).alias("user"), F.col("l_partkey").alias("item"), _millis("o_orderdate").alias("ts_ms"), "l_orderkey", "l_linenumber"
    )


def from_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as interactions of an order with a part; without pos."""
    return _orders(spark, sf_dir, "l_orderkey").select("user", "item", "ts_ms")


def from_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as interactions of a customer with a part; without pos."""
    return _orders(spark, sf_dir, "o_custkey").select("user", "item", "ts_ms")
