"""Window by window with versioned state: exact or sampled, with feedback, from batches or a file stream.

The scorer needs an all-item snapshot for each window and the sampler feeds rejections back into the
next window's item counters, so the driver closes windows one after the other.  It only sees window starts
and a few totals; all rows stay in DataFrames.  Every batch reads state version v - 1 and writes
version v as Parquet, then renames a complete ``meta/v=N`` into place, which is never changed again; the greatest is the current
version.  A batch that is run again starts from the same version, so replays give the same tables.  Nothing is kept
between batches in memory, and what no version needs any more is deleted.

The matrix, its row sums and the histories are sums.  They are kept as segments: a window appends one with its changes, and
a segment that is not much larger than what follows is merged with it, so that a row is written again only as
often as the logarithm of the state's size; a window reads the rows of the items that it touches.
"""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlift.config import Config
from pairlift.operators.pairs import mirror
from pairlift.operators.ranking import score_cells, top_k
from pairlift.operators.sampling import sampled_deltas, slot_of
from pairlift.operators.timing import assign_windows, mark_late, running_watermark
from pairlift.sources.interactions import PIECE, exists, parse_lines, stream_lines, with_order

TABLES = {
    "pending": "user long, item long, ts_ms long, pos long, w long",
    "item_counter": "item long, n long",
    "user_counter": "user long, total long, accepted long",
    "slots": "user long, slot long, item long",
}
#: Sums in segments: columns, and how many of them are keys.
SUMS = {"history": ("user long, item long, c long", 2), "cells": ("item long, other long, cnt long", 2), "row_sum": ("item long, row_sum long", 1)}
TOPK = "w long, item long, rank int, other long, k11 long, score double"
ROW_SUMS = "w long, item long, delta long"
FIRST = {"version": -1, "batch": -1, "n": 0, "max_ts": None, "rows": 0, "late": 0, "rescored": 0, "observed": 0, "splits": 0, "last": None, "segments": {name: [] for name in SUMS}}


@dataclass
class Engine:
    """State below ``path``; results in its ``topk`` and ``row_sums`` folders, one sub-folder for each version."""

    spark: SparkSession
    config: Config
    path: str

    # storage

    def _fs(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        p, fs = self._fs(name)
        return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []

    def _delete(self, name: str) -> None:
        p, fs = self._fs(name)
        fs.delete(p, True)

    def meta(self) -> dict:
        """What the current version says; FIRST before any."""
        versions = [int(x[2:]) for x in self._names("meta") if x.startswith("v=")]
        if not versions:
            return copy.deepcopy(FIRST)
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/meta/v={max(versions)}").collect()))

    def _publish(self, meta: dict, before: dict) -> None:
        new, fs = self._fs(f"meta/next-{meta['version']}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        p, _ = self._fs(f"meta/v={meta['version']}")
        if not fs.rename(new, p):
            raise OSError(f"can't publish {p}")
        # what only earlier versions need
        kept = {x for own in meta["segments"].values() for x, _ in own}
        for x in {x for own in before["segments"].values() for x, _ in own} - kept:
            self._delete(x)
        for x in self._names("meta"):
            if x != f"v={meta['version']}":
                self._delete(f"meta/{x}")
        for folder in ("state", "work"):
            for x in self._names(folder):
                if x != f"v={meta['version']}" or folder == "work":
                    self._delete(f"{folder}/{x}")

    def _read(self, version: int, name: str) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/state/v={version}/{name}")

    def _keep(self, df: DataFrame, where: str, schema: str) -> DataFrame:
        path = f"{self.path}/{where}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def _sums(self, meta: dict, name: str, some: DataFrame | None = None) -> DataFrame:
        """The sums of a table, or those of the keys in ``some``."""
        schema, n_keys = SUMS[name]
        paths = [f"{self.path}/{x}" for x, _ in meta["segments"][name]]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        if some is not None:
            rows = rows.join(some, some.columns, "left_semi")
        return rows.groupBy(*rows.columns[:n_keys]).agg(F.sum(rows.columns[-1]).alias(rows.columns[-1]))

    def _append(self, meta: dict, name: str, change: DataFrame, where: str) -> dict:
        """Adds a segment and merges the last ones while the one before is no more than twice as large."""
        own = [tuple(x) for x in meta["segments"][name]]
        n = self._keep(change, f"segments/{name}/{where}", SUMS[name][0]).count()
        first, total = len(own), n
        while first and own[first - 1][1] <= 2 * total:
            first -= 1
            total += own[first][1]
        own.append((f"segments/{name}/{where}", n))
        if first < len(own) - 1:
            merged = self._sums({"segments": {name: own[first:]}}, name)
            n = self._keep(merged, f"segments/{name}/{where}-merged", SUMS[name][0]).count()
            own[first:] = [(f"segments/{name}/{where}-merged", n)]
        return meta | {"segments": meta["segments"] | {name: own}}

    # input

    def add(self, rows: DataFrame, batch: int | None = None, flush: bool = False, splits: int = 0) -> None:
        """Takes rows (user, item, ts_ms, pos from 0 within the batch) and closes the windows that the watermark has passed.

        ``splits`` is how many pieces of files they come from.
        """
        meta = before = self.meta()
        if batch is not None and batch <= meta["batch"]:
            return  # a replay of a batch that is already in the current version
        prior = meta["version"]
        version = prior + 1
        work = f"work/v={version}"
        seen = mark_late(running_watermark(rows, before=meta["max_ts"], levels=0))
        seen = self._keep(assign_windows(seen, self.config.window_ms).drop("watermark"), f"{work}/arrived", "user long, item long, ts_ms long, pos long, late boolean, w long")
        counts = seen.agg(F.count("*").alias("n"), F.count_if("late").alias("late"), F.max("ts_ms").alias("max_ts")).first()
        high = max((x for x in (meta["max_ts"], counts.max_ts) if x is not None), default=None)
        fresh = seen.where("not late").drop("late").withColumn("pos", F.col("pos") + meta["rows"])
        pending = self._read(prior, "pending").unionByName(fresh)
        state = {t: self._read(prior, t) for t in TABLES if t != "pending"}
        end = F.col("w") + self.config.window_ms - 1
        closed = F.lit(True) if flush else (end <= high - 1) if high is not None else F.lit(False)
        pending = self._keep(pending, f"{work}/pending", TABLES["pending"])
        meta = meta | {
            "version": version, "batch": meta["batch"] if batch is None else batch, "max_ts": high, "rows": meta["rows"] + counts.n,
            "late": meta["late"] + counts.late, "splits": meta["splits"] + splits,
        }
        for r in sorted(pending.where(closed).select("w").distinct().collect()):  # one row for each closed window
            meta = self._close(pending.where(F.col("w") == r.w), r.w, state, meta, work)
        for t, df in state.items():
            self._keep(df, f"state/v={version}/{t}", TABLES[t])
        self._keep(pending.where(~closed), f"state/v={version}/pending", TABLES["pending"])
        self._publish(meta, before)

    def flush(self) -> None:
        """Closes all windows that are left; nothing may be pending then."""
        none = self.spark.createDataFrame([], "user long, item long, ts_ms long, pos long")
        self.add(none, flush=True)
        left = self._read(self.meta()["version"], "pending").count()
        if left:
            raise RuntimeError(f"{left} rows are pending after the last window")

    # a window

    def _close(self, rows: DataFrame, w: int, state: dict[str, DataFrame], meta: dict, work: str) -> dict:
        step = self._exact if self.config.skip_cuts else self._sampled
        where, work = f"v={meta['version']}-w={w}", f"{work}/w={w}"
        meta, deltas, touched, observed = step(rows, w, state, meta, work)
        deltas = self._keep(deltas, f"{work}/deltas", "item long, other long, delta long")
        touched = self._keep(touched, f"{work}/touched", "item long")
        sums = self._keep(deltas.groupBy("item").agg(F.sum("delta").alias("delta")).where("delta <> 0").select(F.lit(w).alias("w"), "item", "delta"), f"row_sums/w={w}", ROW_SUMS)
        meta = self._append(meta, "cells", deltas.withColumnRenamed("delta", "cnt"), where)
        meta = self._append(meta, "row_sum", sums.select("item", F.col("delta").alias("row_sum")), where)
        n = meta["n"] + (sums.agg(F.sum("delta")).first()[0] or 0)
        cells = self._sums(meta, "cells", touched).withColumnRenamed("cnt", "k11")
        if self.config.drop_zero_cells:
            cells = cells.where("k11 <> 0")
        row_sum = self._sums(meta, "row_sum")
        other = row_sum.select(F.col("item").alias("other"), F.col("row_sum").alias("other_sum"))
        cells = cells.join(row_sum, "item", "left").join(other, "other", "left").withColumn("n", F.lit(n).cast("long"))
        cells = cells.fillna(0, ["row_sum", "other_sum"])
        best = top_k(score_cells(cells, self.config.contingency, self.config.score_decimals), self.config.top_k)
        self._keep(best.select(F.lit(w).alias("w"), "item", "rank", "other", "k11", "score"), f"topk/w={w}", TOPK)
        return meta | {"n": n, "rescored": meta["rescored"] + touched.count(), "observed": meta["observed"] + observed, "last": w}

    def _exact(self, rows: DataFrame, w: int, state: dict[str, DataFrame], meta: dict, work: str) -> tuple[dict, DataFrame, DataFrame, int]:
        new = self._keep(rows.groupBy("user", "item").agg(F.count("*").alias("c")), f"{work}/new", SUMS["history"][0])
        users = new.select("user").distinct()
        old = self._sums(meta, "history", users).withColumnRenamed("c", "old")
        all_ = self._keep(old.join(new, ["user", "item"], "full").fillna(0, ["old", "c"]), f"{work}/active", "user long, item long, old long, c long")
        a, b = all_.alias("a"), all_.alias("b")
        pairs = a.join(b, (F.col("a.user") == F.col("b.user")) & (F.col("a.item") < F.col("b.item")) & ((F.col("a.c") > 0) | (F.col("b.c") > 0)))
        x = F.col("a.c") * F.col("b.c") + F.col("a.c") * F.col("b.old") + F.col("a.old") * F.col("b.c")
        half = pairs.groupBy(F.col("a.item").alias("item"), F.col("b.item").alias("other")).agg(F.sum(x).alias("delta")).withColumn("w", F.lit(w))
        n, m = F.col("old") + F.col("c"), F.col("old")
        same = all_.groupBy("item").agg(F.sum(n * (n - 1) - m * (m - 1)).alias("delta")).where("delta > 0").select("item", F.col("item").alias("other"), "delta")
        deltas = self._keep(mirror(half, "delta").drop("w").unionByName(same), f"{work}/pairs", "item long, other long, delta long")
        meta = self._append(meta, "history", new, f"v={meta['version']}-w={w}")
        return meta, deltas, deltas.select("item").distinct(), deltas.agg(F.sum("delta")).first()[0] or 0

    def _sampled(self, rows: DataFrame, w: int, state: dict[str, DataFrame], meta: dict, work: str) -> tuple[dict, DataFrame, DataFrame, int]:
        cut, most, seed = self.config.item_cut, self.config.user_cut, self.config.seed
        # item cut: the counter bounds how many interactions of this window are sampled
        order = Window.partitionBy("item").orderBy("pos")
        flagged = rows.withColumn("r", F.row_number().over(order)).join(state["item_counter"], "item", "left").fillna(0, ["n"])
        flagged = flagged.withColumn("sampled", F.col("n") + F.col("r") <= cut).drop("r", "n")
        # user stage: totals count everything, slots only what is sampled
        order = Window.partitionBy("user").orderBy("pos")
        drawn = flagged.join(state["user_counter"], "user", "left").fillna(0, ["total", "accepted"])
        drawn = drawn.withColumn("total", F.col("total") + F.row_number().over(order))
        nth = F.col("accepted") + F.sum(F.col("sampled").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
        drawn = drawn.withColumn("nth", nth).withColumn("slot", F.when(F.col("sampled"), slot_of(F.col("nth"), F.col("total"), F.col("user"), most, seed)))
        drawn = self._keep(
            drawn.select("user", "item", "pos", "total", "nth", "sampled", "slot", F.coalesce(F.col("slot") < most, F.lit(False)).alias("taken")),
            f"{work}/drawn", "user long, item long, pos long, total long, nth long, sampled boolean, slot long, taken boolean",
        )
        taken = drawn.where("taken")
        users = taken.select("user").distinct()
        before = state["slots"].join(users, "user", "left_semi")
        # stays in this window; what sat there before it began at 0
        stays = before.select("user", "slot", "item", F.lit(0).cast("long").alias("t_in"), F.lit(0).alias("w_in")).union(
            taken.select("user", "slot", "item", F.col("total").alias("t_in"), F.lit(1).alias("w_in"))
        )
        own = Window.partitionBy("user", "slot").orderBy("t_in")
        stays = stays.withColumn("t_out", F.lead("t_in").over(own)).withColumn("w_out", F.when(F.col("t_out").isNotNull(), 1))
        stays = self._keep(stays, f"{work}/stays", "user long, slot long, item long, t_in long, w_in int, t_out long, w_out int")
        # events of window 0 are pairs that were there before
        deltas = sampled_deltas(stays).where("w = 1").drop("w")
        active = taken.groupBy("user").agg(F.count("*").alias("c"), F.min("nth").alias("nth")).where("c > 1 or nth > 1").select("user")
        touched = stays.join(active, "user", "left_semi").select("item").distinct()
        # pairs formed by interactions that filled a slot: twice the slots filled before each
        observed = taken.where(F.col("nth") <= most).agg(F.sum(2 * (F.col("nth") - 1))).first()[0] or 0
        # state for the next window; rejections make room in their items' counters
        arrived = flagged.groupBy("item").agg(F.count("*").alias("c"))
        back = drawn.where("sampled and not taken").groupBy("item").agg(F.count("*").alias("back"))
        counter = state["item_counter"].join(arrived, "item", "full").join(back, "item", "left").fillna(0, ["n", "c", "back"])
        counter = counter.select("item", (F.greatest("n", F.least(F.lit(cut), F.col("n") + F.col("c"))) - F.col("back")).cast("long").alias("n"))
        totals = drawn.groupBy("user").agg(F.max("total").alias("t"), F.max(F.least(F.col("nth"), F.lit(most))).alias("a"))
        user = state["user_counter"].join(totals, "user", "full").select("user", F.coalesce("t", "total").alias("total"), F.greatest("a", "accepted").cast("long").alias("accepted"))
        last = stays.where("t_out is null").select("user", "slot", "item")
        slots = state["slots"].join(users, "user", "left_anti").unionByName(last)
        for name, df in (("item_counter", counter), ("user_counter", user), ("slots", slots)):
            state[name] = self._keep(df, f"{work}/{name}", TABLES[name])
        return meta, deltas, touched, observed

    # results

    def counters(self, meta: dict | None = None) -> dict[str, int]:
        """The run's counters by their usual names."""
        meta = meta or self.meta()
        late = "UserInteractionCounterLateElements" if self.config.skip_cuts else "ItemInteractionCounterLateElements"
        return {
            "SplitReaderNumSplits": meta["splits"], late: meta["late"], "UserInteractionCounterObservedCooccurrences": meta["observed"],
            "RowSumProcessWindowRowSum": meta["n"], "ItemRowRescorerRescoredItems": meta["rescored"],
        }

    def _results(self, name: str, schema: str) -> DataFrame:
        """Windows close in order, so those up to the last published one are complete."""
        last = self.meta()["last"]
        if last is None or not self._names(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.path}/{name}").where(F.col("w") <= last)

    def topk(self) -> DataFrame:
        return self._results("topk", TOPK)

    def row_sums(self) -> DataFrame:
        return self._results("row_sums", ROW_SUMS)

    # streams

    def stream(self, source: str, files_per_batch: int = 1, continuous: str | None = None):
        """Starts a query over the files of ``source``; it ends when they are read unless ``continuous`` gives an interval."""

        def each(batch: DataFrame, batch_id: int) -> None:
            batch = batch.withColumn("line", F.monotonically_increasing_id())
            rows = parse_lines(batch.where("value <> ''"), (*PIECE, "line"))
            kept = self._keep(rows, f"lines/b={batch_id}", "user long, item long, ts_ms long, file_modification_time timestamp, file_path string, block long, line long")
            self.add(with_order(kept), batch_id, splits=kept.select(*PIECE).distinct().count())
            self._delete(f"lines/b={batch_id}")

        lines = stream_lines(self.spark, source, files_per_batch, self.config.modified_after, self.config.recursive)
        writer = lines.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.path}/offsets")
        return (writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)).start()

    def run(self, source: str, files_per_batch: int = 1) -> None:
        """Reads all files of ``source``, or new ones at the configured interval until it is stopped, then closes the windows that are left.

        Without any input it warns and gives no results.
        """
        if exists(self.spark, source):
            every = self.config.interval
            self.stream(source, files_per_batch, f"{every} milliseconds" if every else None).awaitTermination()
        self.flush()
