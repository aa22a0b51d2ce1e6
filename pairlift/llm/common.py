"""Shared helpers: tables, scratch storage, word handling, bounded membership bitmaps."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word rule of every operator here: runs of anything but U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: The most that an Arrow batch to or from a Python worker holds, but for a longer single row.
BATCH_BYTES = 8 << 20

#: Rows that Spark's Parquet reader takes up at a time where texts are read; its own 4096 hold as many whole texts in each task.
READ_ROWS = 64

T = TypeVar("T")

_local_scratch: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES, so that a Python worker holds little at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
    if not now or int(now[1]) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


@contextlib.contextmanager
def short_reads(spark: SparkSession) -> Iterator[None]:
    """What is run inside reads Parquet by READ_ROWS rows at most; afterwards the session is as before."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    now = spark.conf.get(name)
    spark.conf.set(name, str(min(int(now), READ_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(name, now)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is ``spark.checkpoint.dir``; a folder of this machine is used only where that is unset and
    driver and executors are one local process.
    """
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="pairlift-")
    return "file://" + _local_scratch[app]


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    The result has no lineage before the files, so a lost executor costs only the tasks it ran.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_stashes() -> None:
    """Deletes what stash() wrote; frames that read it are unusable afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; its shared folder is the cluster's to clean
            continue


atexit.register(drop_stashes)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


class WordHash(dict):
    """64-bit hash of a word, remembered for the words of one task (at most ``limit`` of them)."""

    def __init__(self, seed: int = 0, limit: int = 1_000_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_worker_cache: dict[str, object] = {}


def worker_cache(name: str, make: Callable[[], T]) -> T:
    """What this worker remembers from task to task under ``name``; another name's memory goes first, so there is one at a time."""
    if name not in _worker_cache:
        forget()
        _worker_cache[name] = make()
    return _worker_cache[name]


def forget() -> None:
    """For operators that remember nothing: what other operators' tasks have left in this worker goes back to the system."""
    if not _worker_cache:
        return
    _worker_cache.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
    if trim:
        trim(0)


def word_hash() -> WordHash:
    return worker_cache("words", lambda: WordHash(limit=200_000))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, elementwise."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _odd(i: int, seed: int) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(i.to_bytes(8, "little"), seed) | 1)


def rolling(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A 64-bit hash of each run of k word hashes, in order; k is small."""
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * _odd(i, seed)
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def hash_column(column: Column, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), column)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_table(rows: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def bitmap(values: DataFrame, bits: int, chunk_bits: int = 18) -> np.ndarray:
    """A bitmap of 2**bits bits with a bit set for the top bits of each value (one BIGINT column).

    Its size does not depend on the data (2**bits / 8 bytes).  Tasks build whole chunks of it, so
    each chunk reaches the driver once.  As a filter it has no false negatives.
    """
    chunk_bits = min(chunk_bits, bits)
    name = values.columns[0]
    top = F.shiftrightunsigned(F.col(name), 64 - bits)
    spots = values.select(
        F.shiftright(top, chunk_bits).alias("chunk"), top.bitwiseAND((1 << chunk_bits) - 1).alias("spot")
    ).distinct()
    n_chunks = 1 << (bits - chunk_bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            chunk, spot = b.column(0).to_numpy(), b.column(1).to_numpy()
            for c in np.unique(chunk):
                bitset = own.setdefault(int(c), np.zeros(1 << chunk_bits, bool))
                bitset[spot[chunk == c]] = True
        for c, bitset in own.items():
            yield pa.RecordBatch.from_pydict({"chunk": [c], "bytes": [np.packbits(bitset).tobytes()]})

    built = spots.repartition(min(n_chunks, partitions(values.sparkSession)), "chunk").mapInArrow(
        build, "chunk long, bytes binary"
    )
    out = np.zeros(max(1, 1 << bits >> 3), np.uint8)
    width = max(1, 1 << chunk_bits >> 3)
    for row in built.collect():  # 2**bits / 8 bytes in all
        out[row.chunk * width : (row.chunk + 1) * width] = np.frombuffer(row.bytes, np.uint8)
    return out


def in_bitmap(bitset: np.ndarray, bits: int, values: np.ndarray) -> np.ndarray:
    spot = values.astype(np.uint64, copy=False) >> np.uint64(64 - bits)
    byte = bitset[(spot >> np.uint64(3)).astype(np.int64)]
    return (byte >> (np.uint8(7) - (spot & np.uint64(7)).astype(np.uint8))) & 1 == 1


def without(docs: DataFrame, gone: DataFrame, name: str, bits: int = 23) -> DataFrame:
    """The rows of ``docs`` whose column ``name`` is not in ``gone`` (one column of that type, without nulls).

    Only rows that a bitmap of the ids to go lets through are joined, so the others are not shuffled.
    """
    listed, names = bitmap(gone.select(F.xxhash64(gone.columns[0]).alias("h")), bits), docs.columns
    if not listed.any():
        return docs

    def some(wanted: bool) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = in_bitmap(listed, bits, b.column(len(names)).to_numpy().view(np.uint64)) == wanted
                yield b.filter(pa.array(keep)).select(range(len(names)))

        return docs.withColumn("_gone_hash", F.xxhash64(name)).mapInArrow(work, docs.schema)

    ids = gone.select(F.col(gone.columns[0]).alias("_gone_id"))
    return some(False).unionByName(some(True).join(ids, F.col(name) == F.col("_gone_id"), "left_anti"))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the length, for sorted columns of one length."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def concat(parts: Iterable[np.ndarray], dtype) -> np.ndarray:
    parts = list(parts)
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
