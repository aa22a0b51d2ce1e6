"""The best partners of all items over all time without writing out the pairs.

Row sums and the total follow from the counts alone: item i has the sum over users of c(u, i) (C(u) - 1) ordered pairs, C(u)
being the user's interactions.  So an item's cells can be scored where they come together.  A user's counts are packed in
chunks of records (item, row sum, c) of the least width that holds them; an item meets the chunks of its users and all of
its cells are added up and scored in one place.  What is sent is as much as there are ordered pairs, so items go in rounds:
a round sends about ``ROUND_BYTES`` for each interaction, and its shuffle files go before the next one begins.

Scores in numpy only leave out what cannot be among the k best, with a margin for rounding; what is left is scored and
ranked by the columns that all other queries use.
"""

from __future__ import annotations

import gc
import math
import re
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlift.operators import ranking
from pairlift.operators.pairs import BLOCK
from pairlift.plans.scratch import new_folder

#: Packed bytes that a round sends for each interaction.
ROUND_BYTES = 40
#: Entries that a task adds up at a time, but for a larger single item.
HELD = 1 << 21
_BATCH_BYTES = 8 << 20


def _stash(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean(spark: SparkSession) -> None:
    """Shuffle files go when the driver collects the frames that made them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)


def _small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if not now or int(now[1]) > _BATCH_BYTES:
        spark.conf.set(name, str(_BATCH_BYTES))


def _narrow(low: int, high: int) -> str:
    """The least type that holds both."""
    return next((t for t in ("<u1", "<u2", "<u4") if low >= 0 and high <= np.iinfo(t).max), "<i8")


def _x_log_x(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    return x * np.log(np.maximum(x, 1.0))


def _may_be_best(item, row, other, other_sum, k11, n: int, k: int, decimals: int) -> np.ndarray:
    """Of cells sorted by item, the places of those that may be among an item's k best."""
    k12, k21 = row - k11, other_sum - k11
    k22 = n + k11 - k12 - k21
    every = _x_log_x(n + 2 * k11)
    score = 2.0 * (every - _x_log_x(row) - _x_log_x(k21 + k22) - _x_log_x(other_sum) - _x_log_x(k12 + k22) + _x_log_x(k11) + _x_log_x(k12) + _x_log_x(k21) + _x_log_x(k22))
    score = np.maximum(score, 0.0)
    margin = 2 * 10.0**-decimals + 256 * np.finfo(float).eps * float(every.max(initial=1.0))
    cut = np.concatenate([[0], np.flatnonzero(item[1:] != item[:-1]) + 1, [len(item)]])
    least = np.zeros(len(cut) - 1)
    for i in np.flatnonzero(np.diff(cut) > k):
        own = score[cut[i] : cut[i + 1]]
        least[i] = np.partition(own, len(own) - k)[len(own) - k] - margin
    at = np.flatnonzero(score >= np.repeat(least, np.diff(cut)))
    # equal cells score the same to the last bit: the k least others of them will do
    at = at[np.lexsort((other[at], other_sum[at], k11[at], item[at]))]
    new = np.ones(len(at), bool)
    new[1:] = (item[at[1:]] != item[at[:-1]]) | (k11[at[1:]] != k11[at[:-1]]) | (other_sum[at[1:]] != other_sum[at[:-1]])
    first = np.flatnonzero(new)
    nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    return at[nth < k]


def _summed(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Cells of (item, row, other, other_sum, x), sorted by item: x added up over equal (item, other)."""
    item, other = cols[0], cols[2]
    order = np.cumsum(np.append(0, item[1:] != item[:-1]))
    if len(other) and other.min() >= 0 and other.max() < 1 << 40 and order[-1] < 1 << 23:
        key = order << 40 | other
        by = np.argsort(key)
        key = key[by]
        new = np.append(True, key[1:] != key[:-1])
    else:
        by = np.lexsort((other, order))
        new = np.append(True, (order[by][1:] != order[by][:-1]) | (other[by][1:] != other[by][:-1]))
    first = np.flatnonzero(new)
    return [*(c[by[first]] for c in cols[:4]), np.add.reduceat(cols[4][by], first)]


CELLS = "item long, other long, k11 long, row_sum long, other_sum long"


def _reducer(record: np.dtype, n: int, k: int, decimals: int, held_most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size, most = 0, held_most

        def closed(cells: list[np.ndarray]) -> pa.RecordBatch:
            cells = [c[cells[4] > 0] for c in cells]  # a user's single interaction is no pair with itself
            at = _may_be_best(*cells, n, k, decimals)
            item, row, other, other_sum, k11 = (pa.array(c[at]) for c in cells)
            return pa.RecordBatch.from_arrays([item, other, k11, row, other_sum], names=["item", "other", "k11", "row_sum", "other_sum"])

        for b in batches:
            item, row, c = (b.column(i).to_numpy() for i in range(3))
            data = b.column(3).to_pylist()
            of = np.repeat(np.arange(len(item)), [len(x) // record.itemsize for x in data])
            entries = np.frombuffer(b"".join(data), record)
            other, own = entries["item"].astype(np.int64), c[of]
            held.append([item[of], row[of], other, entries["row"].astype(np.int64), own * entries["c"] - np.where(other == item[of], own, 0)])
            size += len(of)
            if size > most:
                cells = _summed([np.concatenate(x) for x in zip(*held, strict=True)])
                done = int(np.searchsorted(cells[0], cells[0][-1]))
                if done:
                    yield closed([x[:done] for x in cells])
                held = [[x[done:] for x in cells]]
                size = len(held[0][0])
                most = max(held_most, 2 * size)
        if size:
            yield closed(_summed([np.concatenate(x) for x in zip(*held, strict=True)]))

    return work


def _packer(record: np.dtype):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            user, j, item, row, c = (x.to_numpy() for x in b.columns)
            entries = np.empty(len(user), record)
            entries["item"], entries["row"], entries["c"] = item, row, c
            cut = np.flatnonzero((user[1:] != user[:-1]) | (j[1:] != j[:-1])) + 1
            first, last = np.append(0, cut)[: len(user)], np.append(cut, len(user))[: len(user)]
            raw, w = entries.tobytes(), record.itemsize
            data = [raw[i * w : e * w] for i, e in zip(first.tolist(), last.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(user[first]), pa.array(j[first]), pa.array(data, pa.binary())], names=["user", "j", "data"])

    return work


def top_k(rows: DataFrame, k: int, decimals: int, round_bytes: float = ROUND_BYTES, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """ranking.top_k of all cells of (user, item) rows: item, other, k11, the sums, score and rank."""
    spark = rows.sparkSession
    _small_batches(spark)
    folder = new_folder(spark, "partners")
    own = Window.partitionBy("user")
    counted = rows.where("user is not null").select(F.col("user").cast("long").alias("user"), F.col("item").cast("long").alias("item")).groupBy("user", "item").agg(F.count("*").alias("c"))
    counted = counted.select("user", "item", "c", (F.col("c") * (F.sum("c").over(own) - 1)).alias("pairs"), F.count("item").over(own).alias("items"))
    counted = _stash(counted, f"{folder}/counted")
    _clean(spark)
    sums = counted.groupBy("item").agg(F.sum("pairs").alias("row_sum"))
    known = counted.join(sums, "item").select("user", "item", "c", "row_sum", "items", F.ceil(F.col("items") / block).cast("int").alias("blocks"))
    known = _stash(known, f"{folder}/known")
    n = int(counted.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0])
    s = known.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("items"), F.sum("c"), F.min("item"), F.max("item"), F.max("row_sum"), F.max("c"))]).first()
    _delete(spark, f"{folder}/counted")
    record = np.dtype([("item", _narrow(s[2], s[3])), ("row", _narrow(0, s[4])), ("c", "<i8" if s[5] > 1 << 31 else _narrow(0, s[5]))])
    packed = known.select("user", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int").alias("j"), "item", "row_sum", "c")
    packed = packed.repartition("user", "j").sortWithinPartitions("user", "j", "item").mapInArrow(_packer(record), "user long, j int, data binary")
    packed = _stash(packed, f"{folder}/packed")
    _clean(spark)
    rounds = max(1, math.ceil(int(s[0]) * record.itemsize / max(1.0, round_bytes * int(s[1]))))
    for r in range(rounds):
        some = known.where(F.pmod(F.xxhash64(F.lit(r"round"), "item"), F.lit(rounds)) == r)
        some = some.select("user", "item", "c", "row_sum", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
        met = some.join(packed, ["user", "j"]).select("item", "row_sum", "c", "data").repartition("item").sortWithinPartitions("item")
        met.mapInArrow(_reducer(record, n, k, decimals, held), CELLS).write.mode("append").parquet(f"{folder}/cells")
        del some, met
        _clean(spark)
    _delete(spark, f"{folder}/known"), _delete(spark, f"{folder}/packed")
    cells = spark.read.schema(CELLS).parquet(f"{folder}/cells").withColumn("n", F.lit(n).cast("long"))
    return ranking.top_k(ranking.score_cells(cells, decimals=decimals), k)
