"""Mixing sources to target weights, with DataFrame functions only.

Every source gets a token target: the total size shared by weight, no source above ``cap`` times
its own size, the excess shared among the others.  A target is met by whole epochs of the source and
then a fractional one, drawn by Efraimidis-Spirakis sampling: a document of quality weight w gets the key
-ln(u)/w with u uniform from a hash of its id, and the documents with the least keys are taken
while their sizes, summed in key order, stay within what is left (a document that alone is larger does not count).  Then up to ``FILLERS`` further documents fill the
gap, each the largest that fits in it, and where none fits the smallest, if that brings the source nearer to its target; such a
document may be one that is taken already, but none is taken more often than ``cap`` times.

No task sees a whole source.  Keys fall into buckets of about ``bucket_rows`` rows; bucket sums find
the one bucket per source in which the budget ends, and only that bucket's rows are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlift.llm.common import WORD, stash, table

SEED = "mix-1"
#: Documents that may be added to fill the gap that whole documents leave.
FILLERS = 12
#: Quality weights of labelled documents; others weigh 1.
LABEL_WEIGHTS = {1: 2.0, 0: 0.5}


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str, key: Column) -> Column:
    """A number in (0, 1], a multiple of 2**-52, that only depends on seed and key."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """``sources`` (source, source_size) with weight and target; a row per source, so one task."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("weight", F.element_at(share, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    # Sources fill up in the order of most / weight; the level is set by the first that doesn't fill up.
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everywhere = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumns({"all_size": F.sum("source_size").over(everywhere), "all_weight": F.sum("weight").over(everywhere)}).withColumns({
        "full_size": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "full_weight": F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    })
    level = (F.col("all_size") - F.col("full_size")) / (F.col("all_weight") - F.col("full_weight"))
    s = s.withColumn("own_level", F.when(level * F.col("weight") <= F.col("most"), level))
    s = s.withColumn("level", F.max("own_level").over(everywhere))
    target = F.coalesce(F.least(F.col("most"), F.col("level") * F.col("weight")), F.col("most"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: str = SEED, bucket_rows: int = 1000, tie: str | None = None) -> DataFrame:
    """How often each row of ``docs`` (doc_id, size long, source, and its weight as quality) is taken.

    Returns the rows with source_size, target (the source's), epochs, extra (times beyond those) and taken.
    Sources weigh ``weights`` in turn, by code point, null (a source of its own) last.  Repeated
    rows are documents of their own.  A source without words has the target 0.  Equal keys go by doc_id, size and the column
    ``tie``, if one is named (it is returned, too).  An empty table gives none; other columns of ``docs`` do not matter.
    """
    # The row number is fixed by the write; it only tells equal rows apart.
    ties = [tie] if tie else []
    key = -F.log(uniform(seed, F.col("doc_id"))) / F.col("quality")
    rows = stash(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("size").cast("long").alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row"), *ties),
        "sizes",
    )
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    counts = rows.groupBy("source").agg(F.count("*").alias("n_docs"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = stash(
        sources.alias("a").join(counts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(
            "a.source", "source_size", "target", F.floor(share).cast("int").alias("epochs"),
            F.ceil(F.col("n_docs") / bucket_rows).cast("long").alias("buckets"),
        ).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")),
        "sources",
    )
    # 1 - exp(-key) lies in [0, 1) and grows with the key; it is even for the weight 1.
    r, s = rows.alias("r"), sources.alias("s")
    same = F.col("r.source").eqNullSafe(F.col("s.source"))
    spot = F.least(F.floor((1 - F.exp(-F.col("key"))) * F.col("buckets")), F.col("buckets") - 1)
    placed = r.join(s, same).select("r.*", "source_size", "target", "epochs", "left", spot.alias("bucket"))
    placed = placed.withColumn("fits", F.col("size") <= F.col("left"))
    own_size = F.when(F.col("fits"), F.col("size")).otherwise(0)
    sums = placed.groupBy("source", "bucket").agg(F.sum(own_size).alias("sum"), F.first("left").alias("left"))
    up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        sums.withColumn("through", F.sum("sum").over(up_to))
        .where(F.col("through") > F.col("left"))
        .groupBy("source")
        .agg(F.min("bucket").alias("end"), F.min_by(F.col("through") - F.col("sum"), "bucket").alias("base"))
    )
    l = stash(last, "ends").alias("l")  # noqa: E741
    placed = placed.alias("p").join(l, F.col("p.source").eqNullSafe(F.col("l.source")), "left").select("p.*", "end", "base")
    ending = F.col("bucket") == F.col("end")
    in_key_order = Window.partitionBy("source").orderBy("key", "doc_id", "size", *ties, "row").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.where(ending).withColumn("through", F.col("base") + F.sum(own_size).over(in_key_order))
    chosen = inside.withColumn("extra", (F.col("fits") & (F.col("through") <= F.col("left"))).cast("int"))
    outside = placed.where(~ending | F.col("end").isNull()).withColumn(
        "extra", F.when(F.col("fits") & ((F.col("end").isNull() & (F.col("left") > 0)) | (F.col("bucket") < F.col("end"))), 1).otherwise(0)
    )
    picked = outside.drop("end", "base").unionByName(chosen.drop("through", "end", "base"))
    reached = picked.groupBy("source").agg((F.first("left") - F.coalesce(F.sum(F.when(F.col("extra") == 1, F.col("size"))), F.lit(0))).alias("gap"))
    reached = stash(reached, "gaps")
    picked = picked.alias("c").join(reached.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source")), "left").select("c.*", "gap")
    # Per source a few documents of each size that may help, which is bounded by the longest text.
    some = picked.where((F.col("epochs") + F.col("extra") + 1 <= cap) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("gap")))
    nth = F.row_number().over(Window.partitionBy("source", "size").orderBy("extra", "key", "doc_id", *ties, "row"))
    pool = (
        some.withColumn("nth", nth).where((F.col("nth") <= FILLERS) & (F.col("nth") <= F.greatest(F.lit(1.0), F.col("gap") / F.col("size"))))
        .groupBy("source")
        .agg(F.first("gap").alias("gap"), F.collect_list(F.struct("size", F.struct("extra", "key", "doc_id", *ties, "row").alias("doc"))).alias("pool"))
    )
    best = (
        "array_min(transform(filter(pool, p -> abs(p.size - acc.gap) < acc.gap and not array_contains(acc.rows, p.doc.row)), "
        "p -> struct(p.size > acc.gap as over, abs(p.size - acc.gap) as off, p.doc as doc, p.size as size)))"
    )
    filler = (
        pool.selectExpr(
            f"aggregate(sequence(1, {FILLERS}), named_struct('gap', cast(gap as double), 'rows', cast(array() as array<bigint>)), "
            f"(acc, i) -> named_struct('gap', acc.gap - coalesce({best}.size, 0), "
            f"'rows', concat(acc.rows, filter(array({best}.doc.row), r -> r is not null)))).rows as rows"
        )
        .select(F.explode("rows").alias("row"))
        .withColumn("more", F.lit(1))
    )
    return (
        picked.drop("gap").join(filler, "row", "left")
        .withColumn("extra", F.col("extra") + F.coalesce("more", F.lit(0)))
        .withColumn("taken", (F.col("size") * (F.col("epochs") + F.col("extra"))).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "epochs", "extra", "taken", *ties)
    )


def with_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with the quality weight that its label gives (the highest, of several), or 1."""
    mapping = F.create_map(*[F.lit(x) for kv in LABEL_WEIGHTS.items() for x in kv])
    known = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("label"))
    weight = F.coalesce(F.try_element_at(mapping, F.col("label").cast("int")), F.lit(1.0))
    return docs.join(known, F.col("doc_id") == F.col("label_id"), "left").withColumn("quality", weight).drop("label_id", "label")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"))


def mixture(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The mix of ``docs`` itself: each row as often as it is taken, none for those that aren't.

    Null and empty texts have the size 0 and are taken like any other; a null source is one of its own, and an empty
    table gives none.  Rows that share a doc_id are told apart by a 128-bit hash of all their columns; rows that
    are equal in all are taken together as often as they are each.  Other columns stay as they are.

    What is taken is decided on ids and sizes; texts move once, to meet it.
    """
    repeated = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    sized_docs = docs.select("doc_id", "source", words(F.col("text")).alias("size"))
    keys = ["doc_id"]
    if repeated:
        digest = F.struct(F.xxhash64(F.lit(1), *docs.columns).alias("a"), F.xxhash64(F.lit(2), *docs.columns).alias("b"))
        docs = docs.withColumn("_digest", digest)
        sized_docs = docs.select("doc_id", "source", words(F.col("text")).alias("size"), "_digest")
        keys.append("_digest")
    taken = mix(with_quality(sized_docs, labels), tie="_digest" if repeated else None)
    copies = taken.groupBy(*keys).agg(F.sum(F.col("epochs") + F.col("extra")).alias("copies")).where("copies > 0").alias("taken")
    own = (docs.dropDuplicates(keys) if repeated else docs).alias("own")
    columns = [F.col(f"own.`{c}`") for c in docs.columns if c != "_digest"]
    same = [F.col(f"own.{k}").eqNullSafe(F.col(f"taken.{k}")) for k in keys]
    joined = own.join(copies, same[0] & same[1] if repeated else same[0])
    return joined.select(*columns, F.explode(F.sequence(F.lit(1), F.col("taken.copies").cast("int"))).alias("_copy")).drop("_copy")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_quality(sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), known AS (SELECT doc_id AS label_id, max(quality) AS label FROM labels GROUP BY 1
), keyed AS (
  SELECT doc_id, source, size,
    -ln((CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) + 1) / 4503599627370496.0::DOUBLE)
      / CASE label WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS k
  FROM sized LEFT JOIN known ON doc_id = label_id
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight
  FROM sized GROUP BY source
), capped AS (SELECT *, 3.0::DOUBLE * source_size AS most FROM src
), filled AS (
  SELECT *, sum(source_size::DOUBLE) OVER () AS all_size, sum(weight) OVER () AS all_weight,
    coalesce(sum(most) OVER w, 0) AS full_size, coalesce(sum(weight) OVER w, 0) AS full_weight
  FROM capped WINDOW w AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, max(CASE WHEN (all_size - full_size) / (all_weight - full_weight) * weight <= most
    THEN (all_size - full_size) / (all_weight - full_weight) END) OVER () AS level FROM filled
), goals AS (
  SELECT source, source_size, coalesce(least(most, level * weight), most) AS target FROM levels
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM goals
), drawn AS (
  SELECT d.doc_id, d.source, d.size, d.k, source_size, target, epochs, target - epochs * source_size AS rest,
    sum(CASE WHEN d.size <= target - epochs * source_size THEN d.size ELSE 0 END) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS through
  FROM keyed d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
), chosen AS (SELECT *, CASE WHEN rest > 0 AND size <= rest AND through <= rest THEN 1 ELSE 0 END AS extra FROM drawn
), gaps AS (
  SELECT *, rest - coalesce(sum(CASE WHEN extra = 1 THEN size END) OVER (PARTITION BY source), 0) AS gap FROM chosen
), pool_0 AS (
  SELECT * EXCLUDE (gap, rn), gap AS gap_0, 0 AS more_0 FROM (
    SELECT *, row_number() OVER (PARTITION BY source, size ORDER BY extra, k, doc_id) AS rn FROM gaps WHERE epochs + extra + 1 <= 3 AND size > 0 AND size < 2 * gap
  ) WHERE rn <= """ + str(FILLERS) + """ AND rn <= greatest(1.0, gap_0 / size)
)"""


def _round(i: int) -> str:
    off = f"abs(size - gap_{i - 1})"
    fits = f"more_{i - 1} = 0 AND {off} < gap_{i - 1}"
    first = f"row_number() OVER (PARTITION BY source ORDER BY NOT ({fits}), size > gap_{i - 1}, {off}, extra, k, doc_id) = 1"
    return f"""
, try_{i} AS (SELECT *, CASE WHEN {first} AND {fits} THEN 1 ELSE 0 END AS now_{i} FROM pool_{i - 1}),
pool_{i} AS (SELECT *, more_{i - 1} + now_{i} AS more_{i},
  gap_{i - 1} - sum(CASE WHEN now_{i} = 1 THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap_{i} FROM try_{i})"""


OP1_SQL = _SQL + "".join(_round(i) for i in range(1, FILLERS + 1)) + f"""
SELECT g.doc_id, g.source, g.size, g.source_size, g.target,
  CAST(g.size * (g.epochs + g.extra + coalesce(p.more_{FILLERS}, 0)) AS BIGINT) AS taken
FROM gaps g LEFT JOIN pool_{FILLERS} p ON g.doc_id = p.doc_id AND p.more_{FILLERS} = 1
"""
