"""Approximate nearest neighbours by inner product: score-aware (anisotropic) quantisation.

After Guo and others (2020).  Directions are quantised in subspaces of two dimensions with 16 centroids each, four bits; norms
stay as they are.  The loss weighs the part of the residual that is parallel to the vector ``eta`` times as much as the rest, since
that part changes large inner products most; codebooks and codes are fitted for that loss.  A search adds up a query's table
entries for the codes, two codes (a byte) at a time.  What a row's residual may add to or take from that sum, at ``SPREAD``
standard deviations of a random direction, tells which rows may be among the best; all of those are scored exactly, however many there
are (in a crowd of near copies, all of it), in double precision on the original vectors.

Rows lie in cells, by the nearest of centroids fitted on the sample, and a query only meets the cells whose centroids are
most like it.  How many is measured: as many as hold ``WITHIN`` of the best rows of some vectors of the sample.  Large cells are dealt
out in blocks of ``BLOCK`` numbers.

Equal vectors are indexed once and a query vector is searched once, however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlift.llm.common import partitions, stash, table

TOP = 20
EVERY = 20
#: Vectors that the codebooks and cells are fitted on: those with the least hash.
SAMPLE = 8192
#: Rows for each cell that is aimed at, cells at most, numbers in a block of rows, queries scanned at a time.
CELL, CELLS, BLOCK, QUERIES = 8192, 512, 1 << 21, 256
SPREAD = 4.0
WITHIN = 0.99
#: Inner products above this share of the norms matter; it sets eta.
THRESHOLD = 0.2


class Codebooks(NamedTuple):
    centers: np.ndarray  # subspaces x 16 x 2
    eta: float

    def split(self, x: np.ndarray) -> np.ndarray:
        m = len(self.centers)
        out = np.zeros((len(x), 2 * m), np.float32)
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), m, 2)

    def encode(self, x: np.ndarray, rounds: int = 3) -> np.ndarray:
        """Codes, a byte each: nearest centroids first, then coordinate descent on the anisotropic loss."""
        v = self.split(x)
        norm = np.maximum((v * v).sum((1, 2)), 1e-30)
        code = np.empty(v.shape[:2], np.int64)
        rows = np.arange(len(v))
        for m, c in enumerate(self.centers):
            code[:, m] = ((v[:, m, None, :] - c) ** 2).sum(2).argmin(1)
        along = np.zeros(len(v), np.float32)
        for m, c in enumerate(self.centers):
            along += ((v[:, m] - c[code[:, m]]) * v[:, m]).sum(1)
        for _ in range(rounds):
            for m, c in enumerate(self.centers):
                r = v[:, m, None, :] - c
                part = (r * v[:, m, None, :]).sum(2)
                rest = along - part[rows, code[:, m]]
                loss = (r * r).sum(2) + (self.eta - 1) * (rest[:, None] + part) ** 2 / norm[:, None]
                code[:, m] = loss.argmin(1)
                along = rest + part[rows, code[:, m]]
        return code.astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query, pair of subspaces and byte, the sum of its two inner products."""
        t = np.einsum("qmd,mjd->qmj", self.split(q), self.centers)
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1, 256)


def pack(code: np.ndarray) -> np.ndarray:
    return code[:, 0::2] << 4 | code[:, 1::2]


def fit(x: np.ndarray, rounds: int = 4, seed: int = 3) -> Codebooks:
    """Codebooks for the rows of x: k-means by subspace, then least squares for the anisotropic loss in turn with encoding."""
    d = x.shape[1]
    m = 2 * max(1, -(-d // 4))  # subspaces, an even number
    eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
    rng = np.random.default_rng(seed)
    books = Codebooks(np.zeros((m, 16, 2), np.float32), eta)
    v = books.split(x)
    for s in range(m):
        c = v[rng.integers(0, len(v), 16), s] + rng.normal(0, 1e-4, (16, 2))
        for _ in range(12):
            near = ((v[:, s, None, :] - c) ** 2).sum(2).argmin(1)
            n = np.bincount(near, minlength=16)
            for j in range(2):
                total = np.bincount(near, weights=v[:, s, j], minlength=16)
                c[:, j] = np.where(n > 0, total / np.maximum(n, 1), c[:, j])
        books.centers[s] = c
    unit = v / np.sqrt(np.maximum((v * v).sum((1, 2), keepdims=True), 1e-30))
    size = m * 16 * 2
    for _ in range(rounds):
        code = books.encode(x, 2).astype(np.int64)
        at = (np.arange(m)[None, :, None] * 16 + code[:, :, None]) * 2 + np.arange(2)
        z = np.zeros((len(x), size), np.float32)
        np.put_along_axis(z, at.reshape(len(x), -1), unit.reshape(len(x), -1), 1)
        gram = (eta - 1) * (z.T @ z).astype(np.float64)
        gram[np.diag_indices(size)] += np.bincount(at.ravel(), minlength=size) + 1e-6
        right = eta * np.bincount(at.ravel(), weights=v.ravel(), minlength=size) + 1e-6 * books.centers.ravel()
        books = Codebooks(np.linalg.solve(gram, right).reshape(m, 16, 2).astype(np.float32), eta)
    return books


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions, in single precision, and norms of finite vectors of any size."""
    most = np.abs(x).max(1, keepdims=True)
    x = x / most
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return (x / size).astype(np.float32), (size * most)[:, 0]


def scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For each query and row the sum of table entries."""
    total = np.zeros((len(tables), len(codes)), np.float32)
    for b in range(codes.shape[1]):
        total += np.take(tables[:, b], codes[:, b], axis=1)
    return total


class Rows(NamedTuple):
    """A block of rows: their vectors, codes, norms, and how far a sum may be off for a query of norm 1."""

    ids: np.ndarray
    x: np.ndarray
    codes: np.ndarray
    norm: np.ndarray
    off: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray, books: Codebooks) -> "Rows":
        u, norm = unit(x)
        code = books.encode(u)
        near = books.centers[np.arange(len(books.centers)), code].reshape(len(u), -1)[:, : u.shape[1]]
        off = SPREAD * np.sqrt(((u - near) ** 2).sum(1) / u.shape[1]) * norm
        return cls(ids, x, pack(code), norm, off)

    def best(self, q: np.ndarray, books: Codebooks, top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows with the ``top`` largest inner products among those that the codes leave, and the products."""
        direction, size = unit(q)
        rough = scan(books.tables(direction), self.codes) * self.norm
        for i in range(len(q)):
            at = np.arange(len(self.ids))
            if len(at) > top:
                least = np.partition(rough[i] - self.off, -top)[-top]
                at = np.flatnonzero(rough[i] + self.off >= least)
            with np.errstate(over="ignore"):
                score = self.x[at] @ q[i]
            if len(at) > top:
                some = np.argpartition(-score, top - 1)
                some = np.flatnonzero(score >= score[some[top - 1]])  # with all that tie
                at, score = at[some], score[some]
            yield at, score


def cells_of(u: np.ndarray, n: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centroids of about n cells of directions."""
    rng = np.random.default_rng(seed)
    c = u[rng.permutation(len(u))[:n]].astype(np.float64)
    for _ in range(rounds):
        near = (u @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, u)
        some = np.bincount(near, minlength=len(c)) > 0
        c[some] = total[some]
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-30)
    return c


def probes(x: np.ndarray, centers: np.ndarray, top: int, asked: int = 256) -> int:
    """How many cells hold WITHIN of the best rows, over some of the sample's vectors."""
    if len(centers) == 1 or len(x) <= top:
        return len(centers)
    u, norm = unit(x)
    own = (u @ centers.T).argmax(1)
    q = u[:: max(1, len(u) // asked)]
    product = (q @ u.T) * norm
    product[np.arange(len(q)), np.arange(0, len(u), max(1, len(u) // asked))[: len(q)]] = -np.inf
    best = np.argpartition(-product, top - 1, axis=1)[:, :top]
    place = np.argsort(np.argsort(-(q @ centers.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, own[best], 1).ravel())
    return int(needed[min(len(needed) - 1, int(WITHIN * len(needed)))]) + 1


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)


def _search(vectors: DataFrame, d: int, top: int, sample: int) -> DataFrame:
    """(id, near): the nearest of each query vector, nearest first, one more than ``top``; vectors: (id, v, members, is_query)."""
    spark = vectors.sparkSession
    n = vectors.count()
    asked = vectors.where("is_query").select("id", "v")
    x = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v").combine_chunks()  # bounded by sample
    x = _matrix(x, d)
    u = unit(x)[0]
    books, centers = fit(u), cells_of(u, min(CELLS, max(1, -(-n // CELL))))
    n_probes = probes(x, centers, top)

    def placed(count: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                like = unit(_matrix(b.column("v"), d))[0] @ centers.T if b.num_rows else np.zeros((0, len(centers)))
                near = np.argpartition(-like, count - 1, axis=1)[:, :count] if count < len(centers) else np.tile(np.arange(len(centers)), (len(like), 1))
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(like) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), cells], names=["id", "v", "cells"])

        return work

    schema = "id long, v array<double>, cells array<long>"
    rows = stash(vectors.select("id", "v").mapInArrow(placed(1), schema).select("id", "v", F.col("cells")[0].alias("cell")), "placed")
    size = max(256, BLOCK // d)
    blocks = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))  # a row for each cell
    rows = rows.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("asks"), "id", "v")
    queries = asked.mapInArrow(placed(n_probes), schema).select("id", "v", F.explode("cells").alias("cell"))
    queries = queries.join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"), "id", "v")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [[], []], None
        for b in batches:
            c, k, asks, ids = (b.column(i).to_numpy() for i in range(4))
            v = _matrix(b.column("v"), d)
            cut = np.append(np.flatnonzero(np.append(True, (c[1:] != c[:-1]) | (k[1:] != k[:-1]) | (asks[1:] != asks[:-1]))), len(c)) if len(c) else [0]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if (c[i], k[i]) != now:
                    now, held, block = (c[i], k[i]), [[], []], None
                if not asks[i]:
                    held[0].append(ids[i:j]), held[1].append(v[i:j])
                    continue
                if block is None:
                    if not held[0]:
                        continue
                    block, held = Rows.of(np.concatenate(held[0]), np.concatenate(held[1]), books), [[], []]
                for a in range(i, j, QUERIES):
                    part = slice(a, min(j, a + QUERIES))
                    found = list(block.best(v[part], books, top + 1))
                    own = np.repeat(ids[part], [len(at) for at, _ in found])
                    at = np.concatenate([at for at, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(block.ids[at]), pa.array(np.concatenate([s for _, s in found]))], names=["query", "id", "score"])

    met = rows.union(queries).repartition(partitions(spark), "cell", "block").sortWithinPartitions("cell", "block", "asks")
    found = met.mapInArrow(work, "query long, id long, score double")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top + 1).select("query", "id")
    found = found.join(vectors.select("id", "v", "members"), "id").join(asked.select(F.col("id").alias("query"), F.col("v").alias("q")), "query")
    # the score that is returned adds up in order, the same wherever it is computed
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    scored = found.select("query", "members", product.alias("score"))
    # At most top + 1 classes of at most top + 1 members for a query.
    each = scored.select("query", "score", F.explode("members").alias("vec_id"))
    entry = F.struct((-F.col("score")).alias("minus"), "vec_id")
    lists = each.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, top + 1).alias("near"))
    return lists.select(F.col("query").alias("id"), F.transform("near", lambda e: F.struct((-e.minus).alias("score"), e.vec_id.alias("vec_id"))).alias("near"))


def nearest(vectors: DataFrame, is_query, top: int = TOP, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score: the ``top`` largest inner products of each query row with other rows.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id.  Rows without an id, and vectors
    that are null, empty, zero or hold null or non-finite components, take no part; vectors of different lengths don't
    meet.  Ties go to the smaller vec_id.  Rows that share a vec_id are all candidates, and none is its own query's.
    Other columns are ignored; an empty table gives none.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    rows = rows.withColumn("embedding", F.col("v")).where(~bad & F.exists("v", lambda x: x != 0)).drop("embedding")
    rows = stash(rows.select("vec_id", "v", F.size("v").alias("d"), is_query(F.col("vec_id")).alias("is_query")), "vectors")
    members = Window.partitionBy("v").orderBy("vec_id")
    least = rows.withColumn("r", F.row_number().over(members)).where(F.col("r") <= top + 1)
    classes = least.groupBy("v", "d").agg(F.min("vec_id").alias("least"), F.array_sort(F.collect_list("vec_id")).alias("members"))
    asked = rows.where("is_query").groupBy("v").agg(F.lit(True).alias("is_query"))
    # A class goes by its least vec_id; ids shared by classes are told apart by a hash.
    classes = stash(classes.join(asked, "v", "left").withColumn("is_query", F.coalesce("is_query", F.lit(False))).withColumn("id", F.col("least")), "classes")
    lists = None
    for r in classes.groupBy("d").agg(F.countDistinct("id").alias("ids"), F.count("*").alias("n"), F.max("is_query").alias("asked")).collect():  # a row per length
        if not r.asked:
            continue
        own = classes.where(F.col("d") == r.d)
        if r.ids < r.n:
            own = own.withColumn("id", F.xxhash64("v", "least"))
        got = _search(stash(own, "own"), r.d, top, sample)
        got = own.where("is_query").select("id", "v").join(got, "id").select("v", "near")
        lists = got if lists is None else lists.unionByName(got)
    if lists is None:
        return rows.selectExpr("vec_id as query_id", "1 as rank", "vec_id", "0d as score").limit(0)
    out = rows.where("is_query").select(F.col("vec_id").alias("query_id"), "v").join(lists, "v")
    near = F.slice(F.filter("near", lambda e: e.vec_id != F.col("query_id")), 1, top)
    out = out.select("query_id", F.posexplode(near).alias("at", "e"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "e.vec_id", "e.score")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: F.pmod(vec_id, F.lit(EVERY)) == 0)
