"""Substring deduplication by De Bruijn compaction.

The edges of the graph are the k-mers of k = 50 consecutive words; an edge leads from its first k - 1 words to its
last.  A word is removed if a k-mer over it also starts in a document with a smaller id.

* Only k-mers that may repeat become edges.  Each k-mer has an anchor, the least hash of the runs of 20 words in it;
  equal k-mers have equal anchors.  A document has an anchor for about every sixteenth word, and a join with the
  anchors that occur in several documents tells which k-mers of which documents to take up.
* Equal edges meet in a shuffle, sorted by document.  Those outside the least document are repeats.  Where a smaller
  document has the same next word, too, the next edge is a repeat as well, and likewise before; so repeats compact to
  paths, and only the ends of a path are written, as (document, position, start or end).  Edges with
  very many occurrences are dealt out over tasks.  Each task drops what is inside a path by its own rows alone; the few
  that are left, the least of each part and what may be an end, are settled by grouped minima and joins.
* The path ends of a document are joined with its text; the words between a start and its end go.

K-mers are compared by a 64-bit hash and verified by a second of 32 bits, anchors and neighbouring words by 64 bits.

A row is known by ``id``; ``doc`` is the order of its doc_id, which several rows may share.  Where doc_ids are
unique, ``id`` is both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlift.llm.common import bitmap, concat, in_bitmap, mix, partitions, runs, signed, stash, table, text_bytes, word_hash

K = 50
ANCHOR = 20
#: An edge in more documents is dealt out over several tasks.
HOT = 10_000
#: A run of equal edges with more rows than this is taken up in parts, too.
HELD = 200_000
LAST = (1 << 63) - 1

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return word_hash().of(words)


_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0][0]) < n:
        _powers.clear()
        m = max(1 << 16, 2 * n)
        for b in _BASES:
            inverse = np.uint64(pow(int(b), -1, 1 << 64))
            _powers.append(tuple(np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(m, x))]) for x in (b, inverse)))
    return _powers[base]


def windows(h: np.ndarray, k: int, base: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of k word hashes, from prefix sums."""
    up, down = _power(base, len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)])
    return mix((total[k:] - total[:-k]) * down[: len(h) - k + 1])


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if width > have:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def anchors(h: np.ndarray, k: int, anchor: int) -> np.ndarray:
    """The anchor of each k-mer."""
    return least(windows(h, anchor), k - anchor + 1)


def _anchors(k: int, anchor: int):
    """Rows (id, doc if it is there, anchor); the text is the last column."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names[:-1]
            found, size = [], []
            for t in text_bytes(b.column(len(names))):
                words = t.split()
                own = np.unique(anchors(_word_hashes(words), k, anchor)) if len(words) >= k else np.zeros(0, np.uint64)
                found.append(own), size.append(len(own))
            keys = [pa.array(np.repeat(b.column(i).to_numpy(), size)) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(signed(concat(found, np.uint64)))], names=[*names, "anchor"])

    return work


#: An occurrence of an edge, in the part ``salt`` of it; ``before`` and ``after`` are the words beside it, 0 for none.
KEY, PLACE = "edge long, check int, salt int, ", "pos int, before long, after long"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ") if c]


def _edges(k: int, anchor: int, who: str):
    """Rows (KEY, who, PLACE) for the k-mers with listed anchors."""
    names = _names(KEY + who + PLACE)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[list[np.ndarray]] = [[] for _ in names]
            keys_of = list(zip(*(b.column(c).to_pylist() for c in _names(who)), strict=True))
            for own_ids, t, listed in zip(keys_of, text_bytes(b.column("text")), b.column("listed").to_pylist(), strict=True):
                h = _word_hashes(t.split())
                keys = np.array([x["anchor"] for x in listed], np.int64)
                parts = np.array([x["parts"] for x in listed], np.int64)
                order = np.argsort(keys)
                keys, parts = keys[order], parts[order]
                own = signed(anchors(h, k, anchor))
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                pos = np.flatnonzero(keys[at] == own)
                if not len(pos):
                    continue
                around = np.concatenate([np.zeros(1, np.uint64), mix(h ^ np.uint64(0xA5A5A5A5)) | np.uint64(1), np.zeros(1, np.uint64)])
                # equal occurrences in one document, with equal neighbours, have one fate: the first stands for all, as -1 - pos
                edge = windows(h, k)[pos]
                _, first, times = np.unique(mix(edge + mix(around[pos] + np.uint64(3) * mix(around[pos + k + 1]))), return_index=True, return_counts=True)
                pos, n_parts, edge = pos[first], parts[at[pos[first]]], edge[first]
                spread = int(mix(np.array(own_ids[:1], np.int64).view(np.uint64))[0] >> np.uint64(1))
                rows = (
                    signed(edge), (windows(h, k, 1)[pos] >> np.uint64(32)).astype(np.uint32).view(np.int32),
                    np.where(n_parts > 1, spread % n_parts + 1, 0).astype(np.int32), *(np.full(len(pos), i, np.int64) for i in own_ids), np.where(times > 1, -1 - pos, pos).astype(np.int32),
                    signed(around[pos]), signed(around[pos + k + 1]),
                )
                for have, x in zip(held, rows, strict=True):
                    have.append(x)
                if sum(map(len, held[0])) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in held], names=names)
                    held = [[] for _ in names]
            if held[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in held], names=names)

    return work


def _continued(doc: np.ndarray, run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Whether a smaller document of the run has the same neighbouring word; 0 is none."""
    order = np.lexsort((word, run))
    start = runs(run[order], word[order])
    first = np.minimum.reduceat(doc[order], start[:-1])
    out = np.empty(len(doc), bool)
    out[order] = doc[order] > np.repeat(first, np.diff(start))
    return out & (word != 0)


def _paths(who: str):
    """Of sorted edge rows the path ends, with kind 1 for a start, 2 for an end and 3 for both.

    A repeat is no end of its path if a smaller document has the next word, too; then the next edge is a
    repeat as well.  That holds in a part of an edge's rows, too; what a part alone does not show to be inside a
    path comes out unsettled, as kind 0.
    """
    given = _names(KEY + who + PLACE)
    names = [c for c in given if c != "salt"] + ["kind"]

    def settle(c: list[np.ndarray], whole: bool) -> pa.RecordBatch:
        own = dict(zip(given, c, strict=True))
        at = runs(own["edge"], own["check"], own["salt"])
        run = np.repeat(np.arange(len(at) - 1), np.diff(at))
        doc = own["doc"] if "doc" in own else own["id"]
        repeat = doc > np.minimum.reduceat(doc, at[:-1])[run]
        kind = (~_continued(doc, run, own["before"])).astype(np.int32) + 2 * (~_continued(doc, run, own["after"])).astype(np.int32)
        part = (own["salt"] > 0) | (not whole)
        out = (repeat | part) & ((kind > 0) | ~repeat)
        own["kind"] = np.where(part, 0, kind).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(own[n][out]) for n in names], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        begun = None  # the key of a run that is too long to hold
        for b in batches:
            c = [x.to_numpy() for x in b.columns]
            if held is not None:
                c = [np.concatenate([x, y]) for x, y in zip(held, c, strict=True)]
            held = None
            if begun is not None and len(c[0]):
                inside = (c[0] == begun[0]) & (c[1] == begun[1]) & (c[2] == begun[2])
                n = len(inside) if inside.all() else int(np.argmin(inside))
                if n:
                    yield settle([x[:n] for x in c], False)
                c = [x[n:] for x in c]
            if len(c[0]):
                begun = None
                cut = int(runs(c[0], c[1], c[2])[-2])
                if cut:
                    yield settle([x[:cut] for x in c], True)
                held = [x[cut:] for x in c]
                if len(held[0]) > HELD:
                    begun = held[0][0], held[1][0], held[2][0]
                    yield settle(held, False)
                    held = None
        if held is not None:
            yield settle(held, True)

    return work


def _settle_parts(rows: DataFrame, doc: str) -> DataFrame:
    """(id, pos, kind) for unsettled rows.  The least document of an edge, and that of an edge with a neighbouring word, is
    the least of its part and so among them; minima are found in tasks before the shuffle and joined back."""
    edge = ["edge", "check"]
    out = rows
    for side in ("before", "after"):
        first = rows.where(F.col(side) != 0).groupBy(*edge, side).agg(F.min(doc).alias(f"first_{side}"))
        out = out.join(first, [*edge, side], "left")
    out = out.join(rows.groupBy(*edge).agg(F.min(doc).alias("first")), edge).where(F.col(doc) > F.col("first"))
    ends = [F.when(F.col(doc) > F.col(f"first_{s}"), 0).otherwise(x) for s, x in (("before", 1), ("after", 2))]
    return out.select("id", "pos", (ends[0] + ends[1]).cast("int").alias("kind")).where("kind > 0")


def covered(ends: list[tuple[int, int]], n_words: int, k: int) -> np.ndarray:
    """Which words the paths cover, of (pos, kind) with kind 1 for a start, 2 for an end and 3 for both."""
    at = sorted({(p, x) for p, kind in ends for x in ((0, 1) if kind == 3 else (kind - 1,))})
    edge = np.zeros(n_words + 1, np.int32)
    last = None
    for p, kind in at:
        a = p if last is None or (last[1] == 1 and kind == 0) else last[0]
        edge[a] += 1
        edge[p + k] -= 1
        last = (p, kind)
    return np.cumsum(edge[:-1]) > 0


def _everywhere(ends: list[tuple[int, int]], words: list[bytes], k: int) -> list[tuple[int, int]]:
    """The path ends (pos, kind) with those at -1 - pos repeated wherever the same k-mer has the same neighbours."""
    out = [e for e in ends if e[0] >= 0]
    if len(out) == len(ends):
        return out
    h = _word_hashes(words)
    own, around = windows(h, k), np.concatenate([np.zeros(1, np.uint64), h, np.zeros(1, np.uint64)])
    edge = np.arange(len(own))
    beside = mix(around[edge] + np.uint64(3) * mix(around[edge + k + 1])) + (edge == 0) + np.uint64(2) * (edge == len(own) - 1)
    key = mix(own + beside)
    order = np.argsort(key, kind="stable")
    at = key[order]
    for pos, kind in ends:
        if pos < 0:
            first, last = np.searchsorted(at, key[-1 - pos]), np.searchsorted(at, key[-1 - pos], side="right")
            out += [(int(p), kind) for p in order[first:last]]
    return out


def _cut(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (t or "").encode().split()
                gone = covered(_everywhere([(e["pos"], e["kind"]) for e in ends], words, k), len(words), k)
                rows.append((i, int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode()))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["id", "n_removed", "kept"])

    return work


def _among(docs: DataFrame, ids: DataFrame, bits: int) -> DataFrame:
    """The rows of ``docs`` (id and others) whose id may be among ``ids``; no shuffle of texts."""
    wanted, names = bitmap(ids.select(F.xxhash64("id").alias("h")), bits), docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = in_bitmap(wanted, bits, b.column("h").to_numpy().view(np.uint64))
            yield b.filter(pa.array(keep)).select(names)

    return docs.withColumn("h", F.xxhash64("id")).mapInArrow(work, docs.schema)


def removed(docs: DataFrame, k: int = K, anchor: int = ANCHOR, filter_bits: int = 23) -> DataFrame:
    """id, n_removed and kept text, for those rows of ``docs`` (id, doc unless it is the id, text) that lose words."""
    n = partitions(docs.sparkSession)
    doc = "doc" if "doc" in docs.columns else "id"
    who = "id long, doc long, " if doc == "doc" else "id long, "
    docs = docs.select(*dict.fromkeys(["id", doc]), "text")
    own = stash(docs.mapInArrow(_anchors(k, anchor), who + "anchor long"), "anchors")
    repeated = own.groupBy("anchor").agg(F.min(doc).alias("lo"), F.max(doc).alias("hi"), F.count("*").alias("n"))
    repeated = repeated.where("lo < hi").select("anchor", F.ceil(F.col("n") / HOT).cast("long").alias("parts"))
    listed = own.join(repeated, "anchor").groupBy("id").agg(F.collect_list(F.struct("anchor", "parts")).alias("listed"))
    listed = stash(listed, "listed")  # a row per document, bounded by its length
    edges = _among(docs, listed, filter_bits).join(listed, "id").select(*docs.columns, "listed").mapInArrow(_edges(k, anchor, who), KEY + who + PLACE)
    kinds = KEY.replace("salt int, ", "") + who + PLACE + ", kind int"
    ends = edges.repartition(n, "edge", "salt").sortWithinPartitions("edge", "check", "salt").mapInArrow(_paths(who), kinds)
    ends = stash(ends, "ends")
    parts = ends.where("kind = 0").drop("kind")
    ends = ends.where("kind > 0").select("id", "pos", "kind").union(_settle_parts(parts, doc))
    ends = stash(ends.groupBy("id").agg(F.collect_set(F.struct("pos", "kind")).alias("ends")), "path-ends")
    return _among(docs.select("id", "text"), ends, filter_bits).join(ends, "id").select("id", "text", "ends").mapInArrow(_cut(k), "id long, n_removed long, kept string")


def deduplicate(docs: DataFrame, k: int = K, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the words left, joined by a space) for each row of ``docs`` (doc_id, text).

    removed() returns the texts that are left.

    Null texts count as empty; texts of fewer than k words lose nothing.  A null doc_id counts as larger than any other.
    Rows that share a doc_id, or have none, are documents of their own, and none of them takes words from another.  Other columns
    are ignored; an empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # a null id comes after all others: it stands as LAST, and for that a real LAST moves down with all ids
    most = rows.agg(F.max("doc_id")).first()[0]
    order = F.coalesce(F.col("doc_id") - (1 if most == LAST else 0), F.lit(LAST))
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.withColumn("id", order)
        given = rows.select("id", "text")
    else:
        rows = stash(rows.withColumn("id", F.monotonically_increasing_id()), "numbered")  # the write fixes the numbers
        given = rows.select("id", order.alias("doc"), "text")
    base = rows.select("doc_id", "id", "text").mapInArrow(_plain, "doc_id long, id long, n_words long, kept_sha256 string")
    cut = removed(given, k, anchor).select("id", "n_removed", F.sha2("kept", 256).alias("cut_sha256"))
    return base.join(cut, "id", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256")
    )


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, digests = [], []
        for t in text_bytes(b.column(2)):  # one text's words at a time
            words = t.split()
            sizes.append(len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], names=["doc_id", "id", "n_words", "kept_sha256"]
        )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
