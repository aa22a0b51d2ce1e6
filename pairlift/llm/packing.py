"""Best-fit packing of tokenised documents by exact-complement hashing.

Documents become token pieces of at most ``capacity`` tokens.  How many pieces there are of each
length is all the plan needs, and there are at most ``capacity`` lengths whatever the input, so the
driver plans over that table: longest pieces first, it looks up the gap in the index of
single lengths, of sums of two, then of three, and uses a combination as often as the counts allow; where
no combination fills a gap exactly, the longest piece that fits goes in and the search goes on with the
rest of the gap.  Each pattern uses up a length, so there are few patterns; they hold places for all pieces.
A piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import itertools
import operator
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairlift.llm.common import short_reads, stash, table, text_bytes, worker_cache

CAPACITY = 4096
END_ID = 1
#: Bytes of text, but for a longer single one, whose words are held at a time.
CHUNK = 1 << 20
VOCABULARY = "word_bpe_49k.json"
_PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
#: Letters whose lower case and composed form do not depend on their neighbours.
_PLAIN = re.compile("[A-Za-z\u00aa-\u012f\u0131-\u024f]+")


class _Recent(dict):
    """A dict of at most about ``limit`` entries that forgets those not used for longest.

    Entries live in two generations: when the young one is half of the limit, it becomes the old one, and what is
    looked up in the old one moves back.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.half = max(1, limit // 2)
        self.old: dict[bytes, bytes] = {}

    def renew(self) -> None:
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()

    def __missing__(self, key: bytes) -> bytes | None:
        """From the old generation, or None."""
        found = self.old.get(key)
        if found is not None:
            self[key] = found
        return found


def _byte_letters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, or else the next from 256."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in own)
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


class WordEncoder:
    """Token ids of texts, the same as the tokenizer's on the whole text.

    The vocabulary's pre-tokeniser drops white space and never joins across it, so the ids of a text are
    those of its words in order.  A worker remembers about ``limit`` words and as many stems, the words without the
    punctuation after them.  A new stem of plain letters, which is one pre-token and in normal form, goes to the
    vocabulary's merges directly; any other new word through the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.known, self.stems = _Recent(limit), _Recent(limit)
        self.letters = _byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _stem(self, word: bytes) -> bytes:
        s = word.decode()
        if not s.isalpha() or not (s.isascii() or _PLAIN.fullmatch(s)):
            return self.whole(s)
        if not s.isascii():
            s = s.lower().encode().decode("latin-1").translate(self.letters)
        return b"".join([self.packed[t.id] for t in self.merges.tokenize(s)])

    def learn(self, words: Iterable[bytes]) -> None:
        """Adds lower-case words."""
        known, stems = self.known, self.stems
        for w in words:
            stem = w.rstrip(_PUNCTUATION)
            n = len(stem)
            if stem.isalpha() or stem.decode().isalpha():
                ids = stems[stem]
                if ids is None:
                    ids = stems[stem] = self._stem(stem)
                if n < len(w):
                    rest = known[w[n:]]
                    if rest is None:
                        rest = known[w[n:]] = self.whole(w[n:].decode())
                    ids += rest
                known[w] = ids
            else:
                known[w] = self.whole(w.decode())

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and size < CHUNK:
                size += len(texts[stop])
                stop += 1
            self.known.renew(), self.stems.renew()
            # special tokens in a text count as such, in this case only
            words = [[] if b"<|" in t else t.lower().split() for t in texts[at:stop]]
            every = list(itertools.chain.from_iterable(words))
            ids = list(map(self.known.__getitem__, every))
            if None in ids:
                new = list(itertools.compress(range(len(ids)), map(operator.is_, ids, itertools.repeat(None))))
                self.learn({every[i] for i in new})
                for i in new:
                    ids[i] = self.known[every[i]]
            first = 0
            for t, w in zip(texts[at:stop], words, strict=True):
                yield b"".join(ids[first : first + len(w)]) if b"<|" not in t else self.whole(t.decode())
                first += len(w)
            at = stop


def encoder(path: str) -> WordEncoder:
    """This worker's encoder; it outlives a task."""
    return worker_cache("encoder " + path, lambda: WordEncoder(path))


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of each row of ``docs`` (doc_id, text); null text counts as empty and gives the end id alone."""
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(b.column(0).to_pylist(), own.encode(text_bytes(b.column(1))), strict=True):
                ids += end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, PIECES)


def _exact(left: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths with the sum ``gap``, longest first."""
    if left[gap]:
        return [gap]
    have = left > 0

    def pair(total: int, most: int) -> tuple[int, int] | None:
        low = max(1, -(-total // 2))
        high = min(total - 1, most)
        if high < low:
            return None
        ok = have[low : high + 1] & have[total - high : total - low + 1][::-1]
        spots = np.flatnonzero(ok)
        for s in spots[::-1]:
            b = low + int(s)
            if b != total - b or left[b] >= 2:
                return b, total - b
        return None

    if two := pair(gap, gap):
        return list(two)
    for c in np.flatnonzero(have[: gap - 1])[::-1]:
        c = int(c)
        if 3 * c < gap:
            break
        left[c] -= 1
        have[c] = left[c] > 0
        two = pair(gap - c, c)
        left[c] += 1
        have[c] = True
        if two:
            return [c, *two]
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths in order, how many sequences) that place every piece."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[list[int], int]] = []
    for longest in range(capacity, 0, -1):
        while left[longest]:
            pattern, gap = [longest], capacity - longest
            left[longest] -= 1
            while gap:
                more = _exact(left, gap)
                if more is None:
                    fits = np.flatnonzero(left[: gap + 1])
                    if not len(fits):
                        break
                    more = [int(fits[-1])]
                for m in more:
                    left[m] -= 1
                pattern += more
                gap -= sum(more)
            use = Counter(pattern)
            times = 1 + min(int(left[x]) // n for x, n in use.items())
            for x, n in use.items():
                left[x] -= n * (times - 1)
            out.append((pattern, times))
    return out


def places(patterns: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For ranks of pieces of a length, in runs: the run's first (length << 44 | rank), sequence and offset."""
    used: Counter[int] = Counter()
    runs, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            runs.append((length << 44 | used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    runs.sort()
    cols = np.array(runs, np.int64).reshape(-1, 3)
    return cols[:, 0], cols[:, 1], cols[:, 2]


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, bucket_rows: int = 1000) -> DataFrame:
    """Places for all pieces of ``docs``: the columns of pieces(), sequence_id and offset.

    Ranks come from counts by (length, bucket) and a sort within buckets of about ``bucket_rows``
    rows, so no task sees all pieces of a length.  Equal rows are pieces of their own and may swap places.
    An empty table gives no rows; other columns are ignored.
    """
    with short_reads(docs.sparkSession):
        cut = stash(pieces(docs, path, capacity, end_id), "pieces")
    histogram = cut.groupBy("length").agg(F.count("*").alias("n"))
    counts = {int(r.length): int(r.n) for r in histogram.collect()}  # at most `capacity` rows
    first, sequence, offset = places(plan(counts, capacity))
    spark = cut.sparkSession
    sizes = spark.createDataFrame([(x, -(-n // bucket_rows)) for x, n in counts.items()], "length long, buckets long")
    ids = ["doc_id", "piece", "start", "ids_crc32"]
    dealt = cut.join(F.broadcast(sizes), "length").withColumn("bucket", F.pmod(F.xxhash64(*ids), F.col("buckets"))).drop("buckets")
    up_to = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("base"))
    )
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*ids)) - 1
    ranked = dealt.withColumn("own", rank).join(base, ["length", "bucket"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own")).alias("rank"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column("length").to_numpy() << 44 | b.column("rank").to_numpy()
            at = np.searchsorted(first, key, side="right") - 1
            cols = [*b.columns[:5], pa.array(sequence[at] + key - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(work, PIECES + ", sequence_id long, offset long")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_vocabulary())
