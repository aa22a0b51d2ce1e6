"""N-gram Jaccard join with parity sketches.

A document is the set of its distinct word shingles.  A parity sketch gives every shingle one bit and
XORs: a bit is set if an odd number of the set's shingles fall on it.  Two sets that differ in d shingles
have sketches that differ in at most d bits.  Two uses follow from that:

* Candidates.  At a similarity of t, sets of n and m <= n / t shingles differ in at most
  D = (n + m)(1 - t)/(1 + t).  Documents of a band of sizes share a sketch of P segments of 2**32 bits (kept as one
  64-bit hash per segment).  At most D segments of two similar documents differ; so of the first
  D + 1 segments of the one that are not empty, one at least is the same in the other.  Each document
  emits those segments (about a quarter as many as it has shingles), and equal ones meet in a shuffle.
  A document with too few such segments emits all it has, and tries again with other hashes; a pair is
  only missed at a level where both are like that, and then both are at the next.
* A filter.  A dense sketch of about two bits per shingle prunes candidates whose Hamming distance is above D.

What passes both is verified on the sets themselves.  Documents that share a segment aren't all paired: each
meets the least of them, links found that way are joined to components, and only documents of
one segment that are then still in different components are compared with each other, by sketch within the
task; only pairs that the sketch can't tell apart leave it.  So nothing is lost, and a group of
copies costs one comparison for each member.  Exact copies are one class from the beginning.

A passage that many documents share makes segments that many share.  Each document emits a few segments more than it needs;
so a document of which no more than those few are shared by over HOT documents is found by its others, by the same count as above.
In the groups of such a segment only the documents with more of them are compared with the rest.  Large groups are
dealt out in blocks, and each pair of blocks is compared on its own.

Shingles, classes and segments are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlift.llm.common import WordHash, bitmap, concat, in_bitmap, mix, partitions, rolling, runs, signed, stash, table, text_bytes, without, word_hash
from pairlift.llm.components import components

K = 5
PERCENT = 80
LEVELS = 40
GROWTH = 1.5
HOT = 50
#: Members of a group that one task compares with as many others.
BLOCK = 512


def shingles(text: bytes, own: WordHash, k: int = K) -> np.ndarray:
    """The sorted distinct shingles; a text of fewer than k words is one shingle, one without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(rolling(own.of(words), min(k, len(words)), 1000 + min(k, len(words))))


def bands(limit: int = 1 << 40) -> np.ndarray:
    """Upper bounds of the size bands; a set reaches at most into the next band."""
    out = [4]
    while out[-1] < limit:
        out.append(max(out[-1] + 2, int(out[-1] * GROWTH)))
    return np.array(out, np.int64)


BANDS = bands()


def most_apart(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The most that similar sets of n and m shingles can differ in."""
    return (n + m) * (100 - percent) // (100 + percent)


def segments(sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The segments that the sets emit: keys, which set each belongs to, and size << 16 | band << 8 | spare segments."""
    size = np.array([len(s) for s in sets], np.int64)
    band = np.searchsorted(BANDS, size)
    reach = size * 100 // percent
    which = np.concatenate([np.flatnonzero(size > 0), np.flatnonzero((size > 0) & (reach > BANDS[band]))])
    label = np.concatenate([band[size > 0], band[(size > 0) & (reach > BANDS[band])] + 1])
    keys, owners, metas = [], [], []
    for level in range(LEVELS + 1):
        if not len(which):
            break
        n = size[which]
        apart = most_apart(n, np.minimum(reach[which], BANDS[label]), percent)
        some = apart > 0  # others are only similar to equal sets, which are one class
        which, label, n, apart = which[some], label[some], n[some], apart[some]
        if not len(which):
            break
        parts = np.ceil(1.3 * (most_apart(BANDS[label], BANDS[label], percent) + 1)).astype(np.int64) + 3
        base = np.concatenate([[0], np.cumsum(parts)])
        row = np.repeat(np.arange(len(which)), n)
        token = np.concatenate([sets[w] for w in which])
        code = np.uint64(xxhash.xxh3_64_intdigest(b"segment", level))
        h = mix(token ^ code ^ (label[row].astype(np.uint64) << np.uint64(40)))
        spot = ((h >> np.uint64(32)) * parts[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64) + base[row]
        folded = np.zeros(base[-1], np.uint64)
        np.bitwise_xor.at(folded, spot, mix((h & np.uint64(0xFFFFFFFF)) + np.uint64(0x9E3779B97F4A7C15)))
        filled = folded != 0
        owner = np.repeat(np.arange(len(which)), parts)
        order = np.cumsum(filled)
        start = np.concatenate([[0], order])[base[:-1]]
        nth = order - start[owner]
        thin = nth[base[1:] - 1] <= apart
        extra = np.minimum(3 + apart // 20, 255)
        spare = np.clip(nth[base[1:] - 1] - apart - 1, 0, extra)
        out = filled & (nth <= (apart + 1 + extra)[owner])
        at = np.flatnonzero(out)
        own = owner[at]
        tag = (at - base[own]).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (label[own] * 64 + level).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        if level == LEVELS:  # never so in practice: whoever is left meets everyone left
            at, own = np.arange(len(which)), np.arange(len(which))
            folded, tag, spare = np.zeros(len(which), np.uint64), label.astype(np.uint64), np.zeros(len(which), np.int64)
        keys.append(mix(folded[at] + tag))
        owners.append(which[own])
        metas.append((n << 16 | label << 8 | spare)[own])
        which, label = which[thin], label[thin]
    return concat(keys, np.uint64), concat(owners, np.int64), concat(metas, np.int64)


def sketch(s: np.ndarray) -> bytes:
    """The dense parity sketch: 2**b bits, at least two per shingle."""
    bits = 1 << max(8, min(20, int(2 * len(s)).bit_length()))
    spot = (mix(s ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(spot, minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def fold(sk: np.ndarray, size: int) -> np.ndarray:
    """A sketch for fewer bits: XOR of its parts, which keeps the bound."""
    return np.bitwise_xor.reduce(sk.reshape(-1, size), axis=0) if len(sk) > size else sk


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches, all folded to ``size`` bytes, as rows of 64-bit words."""
    return np.stack([fold(np.frombuffer(x, np.uint8), size) for x in sketches]).view(np.uint64)


def _sets(batch_texts: list[bytes]) -> list[np.ndarray]:
    own = word_hash()
    return [shingles(t, own) for t in batch_texts]


def _class(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = _sets(text_bytes(b.column(1)))
        yield pa.RecordBatch.from_arrays([
            b.column(0), pa.array([len(s) for s in sets], pa.int64()),
            pa.array([_class(s) if len(s) else None for s in sets], pa.int64()),
            pa.array([sketch(s) if len(s) else None for s in sets], pa.binary()),
        ], names=["doc_id", "n_shingles", "class", "sketch"])


def _emit(percent: int, heads: np.ndarray, bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = text_bytes(b.column(0).filter(pa.array(in_bitmap(heads, bits, b.column(1).to_numpy().view(np.uint64)))))
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and size < 1 << 21:
                    size += len(texts[stop])
                    stop += 1
                sets = {_class(s): s for s in _sets(texts[at:stop]) if len(s)}
                at = stop
                names = np.array(list(sets), np.int64)
                own = list(sets.values())
                if not own:
                    continue
                keys, owner, meta = segments(own, percent)
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(names[owner]), pa.array(meta)], names=["key", "class", "meta"])

    return work


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and class, those of keys with two classes and more, each once."""
    held = None  # the last class of its key so far, and whether it has been passed on
    for b in batches:
        c = [x.to_numpy() for x in b.columns]
        if held is not None:
            c = [np.concatenate([x, y]) for x, y in zip(held[0], c, strict=True)]
        if not len(c[0]):
            continue
        same = c[0][1:] == c[0][:-1]
        new = np.append(True, ~(same & (c[1][1:] == c[1][:-1])))
        passed = np.zeros(len(new), bool)
        passed[0] = held is not None and held[1]
        c, passed = [x[new] for x in c], passed[new]
        same = c[0][1:] == c[0][:-1]
        shared = np.append(False, same) | np.append(same, False)
        out = shared & ~passed
        held = [x[-1:] for x in c], bool(shared[-1] or passed[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in c], names=["key", "class", "meta"])


def _near(percent: int):
    """Of candidates with sizes and sketches, those that may be similar."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            n, m = t.column("na").to_numpy(), t.column("nb").to_numpy()
            sa, sb = (t.column(c).to_pylist() for c in ("sa", "sb"))
            apart = most_apart(n, m, percent)
            ok = np.minimum(n, m) * 100 >= np.maximum(n, m) * percent
            width = np.array([[len(x), len(y)] for x, y in zip(sa, sb, strict=True)]).reshape(-1, 2)
            for w, v in np.unique(width, axis=0).tolist():
                at = np.flatnonzero((width[:, 0] == w) & (width[:, 1] == v) & ok)
                low = min(w, v)
                for i in range(0, len(at), 4096):
                    part = at[i : i + 4096]
                    one, other = (folded([s[j] for j in part], low) for s in (sa, sb))
                    ok[part] = np.bitwise_count(one ^ other).sum(1, dtype=np.int64) <= apart[part]
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return work


def _verify(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ok = []
            for x, y in zip(t.column("xa").to_pylist(), t.column("xb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return work


def _cross(percent: int):
    """Of rows sorted by key and blocks: pairs of different components whose sketches may belong to similar sets.

    Side 0 is a member of a group in one block, 1 and 2 are members of two blocks that meet.
    """

    def pairs(rows: list[tuple]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        if len({r[1] for r in rows}) < 2:
            return out
        name = np.array([r[0] for r in rows], np.int64)
        comp, n = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        must, side = np.array([r[4] for r in rows], bool), np.array([r[5] for r in rows])
        flat = folded([r[3] for r in rows], min(len(r[3]) for r in rows))
        own, other = np.flatnonzero((side == 1) | (side == 0) & must), np.flatnonzero(side != 1)
        step = max(1, 2_000_000 // max(1, len(other) * flat.shape[1]))
        for at in range(0, len(own), step):
            i = own[at : at + step]
            a, b = i[:, None], other[None]
            near = np.bitwise_count(flat[a] ^ flat[b]).sum(2, dtype=np.int64) <= most_apart(n[a], n[b], percent)
            near &= (comp[a] != comp[b]) & (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent)
            near &= (name[a] < name[b]) | ~must[b]  # two that must be compared meet twice
            for x, y in zip(*np.nonzero(near), strict=True):
                p, q = int(name[i[x]]), int(name[other[y]])
                out.append((min(p, q), max(p, q)))
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []
        seen: set[tuple[int, int]] = set()
        for b in batches:
            out = []
            for *key, name, comp, n, sk, must, side in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != held_key:
                    found = [p for p in pairs(held) if p not in seen]
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.update(found)
                    out += found
                    held_key, held = key, []
                held.append((name, comp, n, sk, must, side))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        out = [p for p in pairs(held) if p not in seen]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return work


def _in_blocks(rows: DataFrame) -> DataFrame:
    """``rows`` with the blocks (one, other) that they are compared in, and their side; as often as they have to be."""
    own, n_one, n_other = F.xxhash64("class"), F.col("n_one"), F.col("n_other")
    at = lambda one, other, side: F.struct(one.cast("long").alias("one"), other.cast("long").alias("other"), F.lit(side).alias("side"))
    first = F.transform(F.sequence(F.lit(0), n_other - 1), lambda x: at(F.pmod(own, n_one), x, 1))
    second = F.transform(F.sequence(F.lit(0), n_one - 1), lambda x: at(x, F.pmod(own, n_other), 2))
    places = F.when((n_one == 1) & (n_other == 1), F.array(at(F.lit(0), F.lit(0), 0))).otherwise(F.when(F.col("must"), F.concat(first, second)).otherwise(second))
    return rows.withColumn("at", F.explode(places)).select("key", "at.one", "at.other", "class", "root", "n", "sketch", "must", "at.side")


def _links(docs: DataFrame, pairs: DataFrame, classes: DataFrame, percent: int, filter_bits: int) -> DataFrame:
    """The similar ones of candidate ``pairs`` (a, b)."""
    one = classes.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    other = classes.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near = stash(pairs.join(one, "a").join(other, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_near(percent), "a long, b long"), "near")
    ends = near.select("a").union(near.select("b")).select(F.col("a").alias("class")).distinct()
    wanted = bitmap(classes.join(ends, "class", "left_semi").select(F.xxhash64("least").alias("least")), filter_bits)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = in_bitmap(wanted, filter_bits, b.column("h").to_numpy().view(np.uint64))
            sets = {_class(s): s for s in _sets(text_bytes(b.column("text").filter(pa.array(keep)))) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array([s.tobytes() for s in sets.values()], pa.binary())], names=["class", "members"])

    if not wanted.any():
        return near
    sets = docs.select("text", F.xxhash64("doc_id").alias("h")).mapInArrow(members, "class long, members binary")
    sets = stash(sets.join(ends, "class", "left_semi").groupBy("class").agg(F.first("members").alias("members")), "sets")
    full = near.join(sets.select(F.col("class").alias("a"), F.col("members").alias("xa")), "a")
    full = full.join(sets.select(F.col("class").alias("b"), F.col("members").alias("xb")), "b")
    return stash(full.select("a", "b", "xa", "xb").mapInArrow(_verify(percent), "a long, b long"), "links")


def similar(docs: DataFrame, percent: int = PERCENT, filter_bits: int = 24, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs`` (doc_id, text).

    Two rows link when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is
    the least doc_id reachable.  Null and empty texts link with nothing and are their own component.
    Rows of equal sets are one class, so repeated rows share a component.  Other columns are ignored; an
    empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    base = stash(docs.mapInArrow(_classify, "doc_id long, n_shingles long, class long, sketch binary"), "classified")
    classes = base.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = stash(classes, "classes")
    # one document of each class will do, and few others pass the filter
    heads = bitmap(classes.select(F.xxhash64("least").alias("least")), filter_bits)
    keys = docs.select("text", F.xxhash64("doc_id").alias("h")).mapInArrow(_emit(percent, heads, filter_bits), "key long, class long, meta long")
    found = keys.repartition(partitions(spark), "key").sortWithinPartitions("key", "class").mapInArrow(_groups, "key long, class long, meta long")
    found = stash(found, "groups")
    # Each meets the member of its group that is in most groups, so that a family has few centres.
    weights = found.groupBy("class").agg(F.count("*").alias("weight"))
    centre = found.join(weights, "class").groupBy("key").agg(F.max(F.struct("weight", "class")).alias("centre")).select("key", F.col("centre.class").alias("centre"))
    stars = found.join(centre, "key").where("class <> centre").select(F.least("class", "centre").alias("a"), F.greatest("class", "centre").alias("b"))
    stars = stash(stars.distinct(), "stars")
    links = _links(docs, stars, classes, percent, filter_bits)
    roots = stash(components(links), "roots")
    # groups that are not in one component yet
    rows = found.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    mixed = rows.groupBy("key").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members"), F.bit_xor(F.xxhash64("class")).alias("sign"),
    ).where("lo <> hi and members > 2").drop("lo", "hi")
    # Of the groups with the same members one is enough; all of them count in what follows.
    mixed = stash(mixed.join(mixed.groupBy("sign", "members").agg(F.min("key").alias("first")), ["sign", "members"]).select("key", "members", (F.col("key") == F.col("first")).alias("is_first")), "mixed-keys")
    rows = stash(rows.join(mixed, "key"), "mixed")
    band = F.shiftright("meta", 8).bitwiseAND(255)
    hot = rows.where(F.col("members") > HOT).withColumn("band", band)
    short = hot.groupBy("class", "band").agg(F.count("*").alias("shared"), F.min(F.col("meta").bitwiseAND(255)).alias("spare")).where("shared > spare")
    hot = stash(hot.join(short.select("class", "band", F.lit(True).alias("must")), ["class", "band"], "left").where("is_first").select("key", "class", "root", F.coalesce("must", F.lit(False)).alias("must")), "hot")
    blocks = hot.groupBy("key").agg(*[F.ceil(x / block).cast("int").alias(c) for c, x in (("n_one", F.count_if("must")), ("n_other", F.count("*")))])
    hot = hot.join(blocks.where("n_one > 0"), "key")
    one = F.lit(1)
    rows = rows.where((F.col("members") <= HOT) & F.col("is_first")).select("key", "class", "root", F.lit(True).alias("must"), one.alias("n_one"), one.alias("n_other")).unionByName(hot)
    rows = _in_blocks(rows.join(classes.select("class", "n", "sketch"), "class"))
    place = ["key", "one", "other"]
    rest = rows.repartition(partitions(spark), *place).sortWithinPartitions(*place).mapInArrow(_cross(percent), "a long, b long").distinct()
    rest = stash(rest.join(stars, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = links.union(_links(docs, rest, classes, percent, filter_bits))
        roots = stash(components(links), "roots")
    least = (
        classes.select("class", "least").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    )
    heads = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(heads, "root").select("class", "component_id")
    return base.join(named, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that of the least doc_id, nulls last (of several rows with one
    id, any of them).

    Null and empty texts are components of their own, so all of them stay; an empty table gives none.
    """
    found = stash(similar(docs, percent), "similar")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = found.where("doc_id is not null and doc_id <> component_id").select("doc_id")
        if not found.where("doc_id is null and component_id is not null").isEmpty():  # a null id, of which there is one at most
            docs = docs.where("doc_id is not null")
        return without(docs, gone, "doc_id")
    # Repeated ids: number the rows, and keep the first of each component.
    numbered = stash(docs.withColumn("_row_id", F.monotonically_increasing_id()), "numbered")
    found = similar(numbered.select(F.col("_row_id").alias("doc_id"), "text"), percent)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_row_id"))
    return without(numbered, gone, "_row_id").drop("_row_id")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))
