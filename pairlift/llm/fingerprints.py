"""Document fingerprints: a canonical exact digest.

A text's canonical form is its NFKC form, case-folded, NFKC again, with each run of white space
turned into one space and trimmed.  Its fingerprint is the 128-bit xxh3 of that form.  Documents
whose digests are equal are compared byte by byte; should two different canonical forms share a
digest, the fingerprints of all but the first (in byte order) get a suffix ``#1``, ``#2`` and so on,
so that equal fingerprints always mean equal canonical texts.  The likeness of two fingerprints is 1.0 if
the canonical bytes are equal, else 0.0: a digest knows no nearness in between.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlift.llm.common import bitmap, in_bitmap, partitions, stash, table, text_bytes

SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, digest64 long, form binary, edited_form binary"
)


def canonical(text: str) -> bytes:
    """The canonical form, as UTF-8."""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(form: bytes, bits: int = 128) -> str:
    """The first ``bits`` bits of the form's xxh3, in hex; fewer than 128 serve to test equal buckets."""
    return xxhash.xxh3_128_hexdigest(form)[: bits // 4]


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """Keys of which the i-th goes to partition i of ``repartition(n, key)``."""
    rows = (
        spark.range(0, 40 * n + 200)
        .groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p"))
        .agg(F.min("id").alias("id"))
        .collect()
    )  # n rows
    at = {r.p: r.id for r in rows}
    return [at.get(i, i) for i in range(n)]


#: Bytes of text that a task sorts, about.
RANGE_BYTES = 64 << 20


def _cuts(docs: DataFrame, range_bytes: int) -> list[tuple[bool, int, int]]:
    """Where ranges begin, in the order of (doc_id is null, doc_id, hash of the text).

    There are as many as there are shuffle partitions, or more if ranges would be larger than range_bytes.
    An id that fills ranges (null is such a one) is cut by the hash.
    """
    ids = docs.select("doc_id")
    total, nulls, size = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull()), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(partitions(docs.sparkSession), -(-size // range_bytes))
    n_ids = max(1, round(n * (total - nulls) / max(1, total)))
    at = sorted(int(x) for x in ids.approxQuantile("doc_id", [i / n_ids for i in range(1, n_ids)], 0.1 / n)) if n_ids > 1 else []
    cuts = {}
    for x in at:
        cuts[False, x] = cuts.get((False, x), 0) + 1
    if nulls:
        cuts[True, 0] = max(1, round(n * nulls / total))
    # an id at m quantiles gets m ranges of its own hashes; the first begins where the id does
    return sorted((*key, (j << 64) // m - (1 << 63)) for key, m in cuts.items() for j in range(m))


def _part(cuts: list[tuple[bool, int, int]]):
    """The number of cuts up to a row, looked up among every 64th cut and then among those in between."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("h"))
    as_array = lambda some: F.array(*[F.struct(F.lit(a).alias("none"), F.lit(b).cast("long").alias("id"), F.lit(c).cast("long").alias("h")) for a, b, c in some])
    if not cuts:
        return F.lit(0)
    groups = [cuts[i : i + 64] for i in range(0, len(cuts), 64)]
    group = F.size(F.filter(as_array([g[0] for g in groups]), lambda c: c <= key))
    within = F.size(F.filter(F.get(F.array(*map(as_array, groups)), group - 1), lambda c: c <= key))
    return F.when(group == 0, 0).otherwise((group - 1) * 64 + within)


def in_order(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Deals the rows out by ranges of (doc_id, hash of the text), in order, each range followed by the next one's first row.

    The result is partitioned by ``part`` and sorted; rows with ``after`` = 1 only serve as the
    following document.  One shuffle moves each text once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    cuts = _cuts(docs, range_bytes)
    n = len(cuts) + 1
    rows = docs.withColumn("h", F.xxhash64("text")).withColumn("part", _part(cuts))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")
    firsts = {r.part: (r.f.none, r.f.id, r.f.h) for r in rows.groupBy("part").agg(F.min(order).alias("f")).collect()}  # n rows
    held = sorted(firsts)
    keys = F.array(*[F.lit(k) for k in even_keys(spark, max(n, partitions(spark)))])
    if held:
        # by part: its first row, and the part before it
        some = [firsts.get(p, (False, 0, 0)) for p in range(n)]
        first = F.get(F.array(*[F.struct(F.lit(a).alias("none"), F.lit(b).cast("long").alias("id"), F.lit(c).cast("long").alias("h")) for a, b, c in some]), F.col("part"))
        before = {p: held[i - 1] for i, p in enumerate(held)}
        previous = F.get(F.array(*[F.lit(before.get(p, 0)) for p in range(n)]), F.col("part"))
        own = F.struct(F.col("part").alias("part"), F.lit(0).alias("after"))
        places = F.when(order == first, F.array(own, F.struct(previous.alias("part"), F.lit(1).alias("after")))).otherwise(F.array(own))
        rows = rows.select("doc_id", "text", "h", F.explode(places).alias("at")).select("doc_id", "text", "h", "at.part", "at.after")
    else:
        rows = rows.withColumn("after", F.lit(0))
    return (
        rows.withColumn("key", F.get(keys, F.col("part")))
        .repartition(max(n, partitions(spark)), "key")
        .sortWithinPartitions("part", "after", F.col("doc_id").asc_nulls_last(), "h", "text")
        .select("part", "after", "doc_id", "text")
    )


def _digests(docs: DataFrame, bits: int, keep_forms: bool) -> DataFrame:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = {"doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64(), "digest64": pa.int64(), "form": pa.binary(), "edited_form": pa.binary()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (part, doc_id, text, form)
        for batch in batches:
            out: list[tuple] = []
            for part, after, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None and after:
                    continue
                form = canonical(text)
                if held is not None:
                    _, own_id, own, own_form = held
                    new = edited(own, text)
                    new_form = canonical(new)
                    out.append((
                        own_id, len(own), hashlib.sha256(new.encode()).hexdigest(), digest(own_form, bits), digest(new_form, bits),
                        float(new_form == own_form), float(form == own_form),
                        xxhash.xxh3_64_intdigest(digest(own_form, bits)) - (1 << 63),
                        own_form if keep_forms else None, new_form if keep_forms else None,
                    ))
                held = None if after else (part, doc_id, text, form)
            cols = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, cols, strict=True)], names=names)

    return in_order(docs).mapInArrow(work, SCHEMA)


def _forms(docs: DataFrame, bits: int, shared: np.ndarray, shared_bits: int) -> DataFrame:
    """Digest and packed form of the documents whose digest may be that of another row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            forms = [canonical(b.decode()) for b in text_bytes(batch.column(0))]
            names = [digest(f, bits) for f in forms]
            h = np.array([xxhash.xxh3_64_intdigest(x) for x in names], np.uint64)
            keep = np.flatnonzero(in_bitmap(shared, shared_bits, h ^ np.uint64(1 << 63)))
            yield pa.RecordBatch.from_pydict({
                "fingerprint": pa.array([names[i] for i in keep], pa.string()),
                "form": pa.array([pack.compress(forms[i]) for i in keep], pa.binary()),
            })

    return docs.select("text").mapInArrow(work, "fingerprint string, form binary")


def fingerprints(docs: DataFrame, bits: int = 128, filter_bits: int = 23) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): n_chars, the digests of it and of its edited text, likeness.

    The following document is the next by doc_id (nulls last; equal ids by a hash of the text), and after the last
    the first.  Null text counts as empty; an empty text's edited text is empty.  Rows repeat as in ``docs``.  Other
    columns of ``docs`` are ignored.  An empty table gives none.

    Byte comparison: rows of buckets of two and more are found by a bitmap of 2**filter_bits bits
    (a filter without false negatives), and the least and greatest form of each bucket are compared;
    tasks combine those before the shuffle, so a bucket of any size reaches a task as one row per task.
    """
    docs = docs.select("doc_id", "text")
    base = stash(_digests(docs, bits, False).drop("form", "edited_form"), "digests")
    multiple = base.groupBy("digest64").count().where("count > 1").select("digest64")
    shared = bitmap(multiple, filter_bits)
    out = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    if not shared.any():
        return base.select(out)
    clash = (
        _forms(docs, bits, shared, filter_bits)
        .groupBy("fingerprint")
        .agg(F.min("form").alias("a"), F.max("form").alias("b"))
        .where("a <> b")
        .select("fingerprint")
    )
    clash = stash(clash, "clashes")
    if clash.isEmpty():
        return base.select(out)
    # Different texts share a digest: number the forms of such buckets.  At 128 bits not expected at any size.
    full = stash(_digests(docs, bits, True), "forms")
    forms = full.select("fingerprint", "form").union(full.select("edited_fingerprint", "edited_form"))
    order = Window.partitionBy("fingerprint").orderBy("form")
    numbered = (
        forms.join(clash, "fingerprint", "left_semi").distinct().withColumn("k", F.row_number().over(order) - 1).where("k > 0")
    )
    for name, form in (("fingerprint", "form"), ("edited_fingerprint", "edited_form")):
        own = numbered.select(F.col("fingerprint").alias(name), F.col("form").alias(form), "k")
        full = full.join(own, [name, form], "left").withColumn(
            name, F.when(F.col("k").isNull(), F.col(name)).otherwise(F.concat(F.col(name), F.lit("#"), F.col("k")))
        ).drop("k")
    return full.select(out)


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
