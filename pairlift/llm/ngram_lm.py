"""Language-model scoring with a log-frequency Bloom filter (Talbot and Osborne, 2007).

Counts of tokens and of token pairs come from all training documents, in one pass and one shuffle.  The pairs' counts are
quantised: level j stands for LOW[j - 1] occurrences and more, in steps of about the square root of two.  A pair is put into
a Bloom filter once for each level up to its own; a reader probes level after level until one is missing.  The
tokens' counts are exact and lie beside the filter.  Both come in shards by n-gram hash, each sized by what is in it, so
every pair of every count has its place at any size.  Up to ``MAX_BROADCAST`` bytes the shards go to the workers by
broadcast; beyond, the distinct n-grams of each few texts are sent to the shards and the answers back.

The probability of a token v after u interpolates what followed u with the tokens' own shares,

    p(v | u) = (1 - w) min(LOW / c(u), B_j P(v)) / Z + w P(v),    w = m / (c(u) + m),  P(v) = (c(v) + 0.1) / (N + 0.1 (V + 1)),

and P(v) alone where the filter has no (u, v) or u is unknown.  LOW is no more than the pair's count, so without false positives the
first part sums to at most 1.  A false positive of level j has a chance of about f ** j, f being the filter's rate, over
all v; B_j bounds what it can add to B_j P(v), and so all of them together to EXCESS, for which Z makes up.  So over the
vocabulary and the one unseen token the probabilities after any u sum to at most 1 (in expectation over the filter's hashes).

Tokens and pairs are 64-bit hashes.
"""

from __future__ import annotations

import itertools
import pickle
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlift.llm.common import concat, mix, partitions, runs, signed, stash, table, text_bytes, word_hash

FOLDS, HELD_OUT = 10, 0
#: The weight m of the tokens' own shares, in tokens.
PRIOR = 500.0
EXCESS = 0.2
BITS_PER_ENTRY = 10
PROBES = 6
#: A larger model (bytes) is not broadcast.
MAX_BROADCAST = 160 << 20
SHARD_BITS = 13

END = np.uint64(0x3C6EF372FE94F82B)
START = np.uint64(0xBB67AE8584CAA73B)

#: The least count of each level, from level 1.
LOW = np.unique(np.ceil(2 ** (np.arange(126) / 2) - 1e-9).astype(np.int64))
COUNT_OF = np.concatenate([[0], LOW])


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in a row, each text closed by END, and where texts begin (and the end)."""
    own = word_hash()
    words = [t.lower().split() for t in texts]
    size = np.array([len(w) + 1 for w in words], np.int64)
    base = np.concatenate([[0], np.cumsum(size)])
    out = np.full(base[-1], END, np.uint64)
    inside = np.ones(base[-1], bool)
    inside[base[1:] - 1] = False
    out[inside] = own.of([x for w in words for x in w])
    return out, base


def pairs(h: np.ndarray, base: np.ndarray) -> np.ndarray:
    """For each token the hash of it and its predecessor."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[base[:-1]] = START
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + h)


def _chunks(texts: list[bytes], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and size < most:
            size += len(texts[stop])
            stop += 1
        yield at, stop
        at = stop


def level(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(LOW, n, side="right")


# counts and shards


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, pair, n): the tokens (START for each text) and the pairs of some texts."""
    for b in batches:
        texts = text_bytes(b.column(0))
        for at, stop in _chunks(texts, 1 << 23):
            h, base = tokens(texts[at:stop])
            for pair, x in ((False, np.concatenate([h, np.full(stop - at, START)])), (True, pairs(h, base))):
                x.sort()
                cut = runs(x)
                n = len(cut) - 1
                yield pa.RecordBatch.from_arrays([pa.array(signed(x[cut[:-1]])), pa.array(np.full(n, pair)), pa.array(np.diff(cut))], names=["gram", "pair", "n"])


def _summed(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of n over equal grams, which are sorted."""
    cut = runs(gram)
    return gram[cut[:-1]], np.add.reduceat(n, cut[:-1]) if len(gram) else n


def _spots(h: np.ndarray, lev: np.ndarray | int, bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """The bit positions of (n-gram, level) in a filter of ``bits`` bits (under 2**32), probe by probe."""
    x = mix(h + np.uint64(0xA24BAED4963EE407) * np.asarray(lev, np.uint64))
    low, high, bits = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1), np.asarray(bits, np.uint64)
    for p in range(PROBES):
        yield ((low + np.uint64(p) * high & np.uint64(0xFFFFFFFF)) * bits >> np.uint64(32)).astype(np.int64)


def build(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bits of the filter for distinct n-grams and their counts."""
    lev = level(n)
    bits = np.zeros(max(64, -(-int(lev.sum()) * BITS_PER_ENTRY // 8) * 8), bool)
    own = np.arange(len(h))
    for step in range(1, int(lev.max(initial=0)) + 1):
        own = own[lev[own] >= step]
        for spot in _spots(h[own], step, len(bits)):
            bits[spot] = True
    return bits


SHARDS = "shard long, bits long, ones long, filter binary, words binary, tokens long, kinds long"


def _shard(shard: int, gram: np.ndarray, pair: np.ndarray, n: np.ndarray) -> dict[str, list]:
    h, c = _summed(gram[~pair], n[~pair])
    bits = build(*_summed(gram[pair], n[pair]))
    own = h != START
    return {
        "shard": [shard], "bits": [len(bits)], "ones": [int(np.count_nonzero(bits))], "filter": [np.packbits(bits, bitorder="little").tobytes()],
        "words": [h.tobytes() + c.astype(np.int64).tobytes()], "tokens": [int(c[own].sum())], "kinds": [int(own.sum())],
    }


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (gram, pair, n) sorted by gram, a row for each shard; one shard's distinct n-grams are held at a time."""
    now, held = None, [[], [], []]

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(_shard(now, *(concat(x, t) for x, t in zip(held, (np.uint64, bool, np.int64), strict=True))))

    for b in batches:
        gram, pair, n = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy()
        shard = (gram >> np.uint64(64 - SHARD_BITS)).astype(np.int64)
        cut = runs(shard)
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if shard[i] != now:
                if now is not None:
                    yield closed()
                now, held = int(shard[i]), [[], [], []]
            for kind in (False, True):
                of = np.flatnonzero(pair[i:j] == kind) + i
                g, c = _summed(gram[of], n[of])
                held[0].append(g), held[1].append(np.full(len(g), kind)), held[2].append(c)
    if now is not None:
        yield closed()


class Filter(NamedTuple):
    """Shards of a filter side by side: the bits of each, and where its bytes begin."""

    bits: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def levels(self, h: np.ndarray) -> np.ndarray:
        lev = np.zeros(len(h), np.uint8)
        left, step = np.arange(len(h)), 0
        shard = (h >> np.uint64(64 - SHARD_BITS)).astype(np.int64) if len(self.bits) > 1 else np.zeros(len(h), np.int64)
        while len(left) and step < len(LOW):
            step += 1
            own, first = shard[left], self.first[shard[left]]
            ok = np.ones(len(left), bool)
            for spot in _spots(h[left], step, self.bits[own]):
                ok &= (self.data[first + (spot >> 3)] >> (spot & 7).astype(np.uint8)) & 1 == 1
            left = left[ok]
            lev[left] = step
        return lev


class Words(NamedTuple):
    """Sorted token hashes and their counts."""

    h: np.ndarray
    n: np.ndarray

    def count(self, h: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, self.n[at], 0).astype(np.int64)


def _words(data: bytes) -> Words:
    x = np.frombuffer(data, np.uint64)
    return Words(x[: len(x) // 2], x[len(x) // 2 :].view(np.int64))


class Model(NamedTuple):
    total: int  # N
    kinds: int  # V
    rate: float  # of false positives
    words: Words | None  # None: in the shards
    grams: Filter | None

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.1) / (self.total + 0.1 * (self.kinds + 1))

    def probability(self, lev: np.ndarray, c: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of tokens of count c after tokens of count ``before``, the pairs having these levels."""
        own = self.unigram(c)
        j = lev.astype(float)
        most = np.minimum(EXCESS / 2**j / np.maximum(self.rate, 1e-9) ** j, 1e300)
        seen = np.minimum(COUNT_OF[lev] / np.maximum(before, 1), most * own) / (1 + EXCESS + 2 * self.rate)
        w = PRIOR / (before + PRIOR)
        return np.where(lev > 0, (1 - w) * seen, 0.0) + w * own


def fit(docs: DataFrame, max_broadcast: int = MAX_BROADCAST) -> tuple[Model, DataFrame]:
    """The model of all texts of ``docs``, and its shards.

    Every count of every token and pair is in it; beyond max_broadcast bytes the shards stay in their table.
    """
    counted = docs.select("text").mapInArrow(_count, "gram long, pair boolean, n long")
    n = min(1 << SHARD_BITS, partitions(docs.sparkSession))
    dealt = counted.repartition(n, F.shiftrightunsigned("gram", 64 - SHARD_BITS)).sortWithinPartitions("gram")
    shards = stash(dealt.mapInArrow(_shards, SHARDS), "lm-shards")
    size = F.sum(F.octet_length("filter") + F.octet_length("words"))
    row = shards.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("tokens"), F.sum("kinds"), F.sum("bits"), F.sum("ones"), size)]).first()
    model = Model(int(row[0]), int(row[1]), (row[3] / max(1, row[2])) ** PROBES, None, None)
    if row[4] > max_broadcast:
        return model, shards
    found = {r.shard: r for r in shards.select("shard", "bits", "filter", "words").toLocalIterator()}  # at most max_broadcast bytes
    bits, parts = np.zeros(1 << SHARD_BITS, np.int64), [b""] * (1 << SHARD_BITS)
    for k, r in found.items():
        bits[k], parts[k] = r.bits, bytes(r.filter)
    # a shard without n-grams is a filter of eight zero bits
    parts, bits = [p or b"\0" for p in parts], np.maximum(bits, 8)
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
    own = [_words(bytes(found[k].words)) for k in sorted(found)]
    words = Words(concat([x.h for x in own], np.uint64), concat([x.n for x in own], np.int64))
    if not len(words.n) or words.n.max() < 1 << 32:
        words = Words(words.h, words.n.astype(np.uint32))
    return model._replace(words=words, grams=Filter(bits, first, np.frombuffer(b"".join(parts), np.uint8))), shards


# scores

SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _scored(m: Model, base: np.ndarray, c: np.ndarray, start: int, lev: np.ndarray) -> list[np.ndarray]:
    """Tokens, known tokens, base score and score of each text, from its tokens' counts, that of START and its pairs' levels."""
    before = np.empty_like(c)
    before[1:] = c[:-1]
    before[base[:-1]] = start
    sums = [(c > 0).astype(np.int64), np.log10(m.unigram(c)), np.log10(m.probability(lev, c, before))]
    return [np.diff(base), *(np.add.reduceat(x, base[:-1]) for x in sums)]


def score_texts(texts: list[bytes], m: Model) -> list[np.ndarray]:
    h, base = tokens(texts)
    kind, back = np.unique(h, return_inverse=True)
    gram, place = np.unique(pairs(h, base), return_inverse=True)
    return _scored(m, base, m.words.count(kind)[back], int(m.words.count(np.array([START]))[0]), m.grams.levels(gram)[place])


def _rows(ids: pa.Array, found: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *map(pa.array, found)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])


def _by_broadcast(rows: DataFrame, model: Model) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by max_broadcast

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts, ids = text_bytes(b.column(1)), b.column(0)
            for at, stop in _chunks(texts):
                yield _rows(ids.slice(at, stop - at), score_texts(texts[at:stop], m))

    return rows.mapInArrow(work, SCORES)


ANSWERS = ["group", "shard", "words", "grams"]


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and levels for the groups' n-grams, of rows (shard, group, bits, words, grams) sorted by shard, each shard's own row first."""
    now, words, grams = -1, None, None
    none = Words(np.zeros(0, np.uint64), np.zeros(0, np.int64)), Filter(np.array([8]), np.array([0]), np.zeros(1, np.uint8))

    def answers(asked: list[bytes], one: Callable[[np.ndarray], np.ndarray], kind: type) -> list[bytes]:
        """For several groups' n-grams at once, each distinct one looked up once; cut as they were asked."""
        kinds, back = np.unique(np.frombuffer(b"".join(asked), np.uint64), return_inverse=True)
        found = one(kinds).astype(kind, copy=False)[back].tobytes()
        size = np.dtype(kind).itemsize
        cut = np.concatenate([[0], np.cumsum([len(x) for x in asked])]) // 8 * size
        return [found[i:j] for i, j in itertools.pairwise(cut.tolist())]

    for b in batches:
        shard, cut = b.column(0).to_numpy(), runs(b.column(0).to_numpy())
        out: list[list] = [[], [], [], []]
        for i, j in itertools.pairwise(cut.tolist()):
            if shard[i] != now:
                now, (words, grams) = int(shard[i]), none
            group, bits, x, y = (c.slice(i, j - i).to_pylist() for c in b.columns[1:])
            if group[0] is None:  # the shard itself stands before the groups' rows
                words, grams = _words(x[0]), Filter(np.array([bits[0]]), np.array([0]), np.frombuffer(y[0], np.uint8))
                group, x, y = group[1:], x[1:], y[1:]
            if group:
                out[0] += group
                out[1] += [now] * len(group)
                out[2] += answers(x, words.count, np.int64)
                out[3] += answers(y, grams.levels, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=ANSWERS)


def _by_shards(rows: DataFrame, model: Model, shards: DataFrame) -> DataFrame:
    """As _by_broadcast, with the counts in shards.

    Groups of texts become a row that knows each token's and pair's place among the group's distinct ones (shard -1), and a row
    of these for each shard.  The shards return counts and levels, and each group's rows meet again.
    """
    spark = rows.sparkSession
    schema = "group long, shard long, words binary, grams binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(1)
        for b in batches:
            texts, ids = text_bytes(b.column(1)), b.column(0)
            for at, stop in _chunks(texts, 1 << 23):
                h, base = tokens(texts[at:stop])
                kind, back = np.unique(np.append(h, START), return_inverse=True)
                gram, place = np.unique(pairs(h, base), return_inverse=True)
                own = pickle.dumps((ids.slice(at, stop - at).to_pylist(), base, back.astype(np.int32), place.astype(np.int32)))
                edges = np.arange(1, 1 << SHARD_BITS).astype(np.uint64) << np.uint64(64 - SHARD_BITS)
                cut = [np.concatenate([[0], np.searchsorted(x, edges), [len(x)]]) for x in (kind, gram)]
                asked = np.flatnonzero(np.diff(cut[0]) + np.diff(cut[1]))
                parts = [[x[c[k] : c[k + 1]].tobytes() for k in asked] for x, c in zip((kind, gram), cut, strict=True)]
                group = np.full(len(asked) + 1, uuid.uuid4().int >> 65, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group), pa.array([-1, *asked.tolist()], pa.int64()), pa.array([pack.compress(own), *parts[0]], pa.binary()), pa.array([b"", *parts[1]], pa.binary())], names=ANSWERS
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()

        def finish(own: bytes, counts: list[bytes], levels: list[bytes]) -> pa.RecordBatch:
            ids, base, back, place = pickle.loads(unpack.decompress(own))
            c = np.frombuffer(b"".join(counts), np.int64)[back]
            lev = np.frombuffer(b"".join(levels), np.uint8)[place]
            return _rows(pa.array(ids, pa.int64()), _scored(model, base, c[:-1], int(c[-1]), lev))

        own, counts, levels = None, [], []
        for b in batches:
            for shard, x, y in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                if shard >= 0:
                    counts.append(x), levels.append(y)
                    continue
                if own is not None:
                    yield finish(own, counts, levels)
                own, counts, levels = x, [], []
        if own is not None:
            yield finish(own, counts, levels)

    asked = stash(rows.mapInArrow(ask, schema), "probes")
    none = F.lit(None).cast("long")
    met = shards.select("shard", none.alias("group"), "bits", "words", F.col("filter").alias("grams"))
    met = met.union(asked.where("shard >= 0").select("shard", "group", none, "words", "grams"))
    met = met.repartition(min(1 << SHARD_BITS, partitions(spark)), "shard").sortWithinPartitions("shard", F.col("group").asc_nulls_first())
    found = met.mapInArrow(_look, schema).union(asked.where("shard < 0"))
    return found.repartition(partitions(spark), "group").sortWithinPartitions("group", "shard").mapInArrow(merge, SCORES)


def score(docs: DataFrame, model: Model, shards: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score for each row of ``docs`` (doc_id, text).

    Null texts count as empty, and an empty text is its end token.  Repeated rows repeat; other columns are ignored;
    an empty table gives none.  Training tables without rows leave the prior: every token 0.1 / 0.1.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _by_shards(rows, model, shards) if model.words is None else _by_broadcast(rows, model)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, shards = fit(docs.where(~held_out(F.col("doc_id"))))
    return score(docs, model, shards).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
