"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words, all of them encoded, whatever the text's length.  A passage's input is
the frequencies of pairs of neighbouring character classes, its word lengths and how much of it
repeats earlier words of the document.  The network (Ilse, Tomczak and Welling, 2018) maps passages to
h = tanh(W x + b), weighs them by gated attention, softmax of w . (tanh(V h) * sigmoid(U h)), and scores the
weighted mean of h.  It learns from document labels only.

Training runs on the driver over at most ``PASSAGES`` evenly spaced passages of each of at most ``sample`` labelled
documents, those with the least hash of their ids; that is the one bounded sample here.  Scoring takes all passages and
needs no shuffle.  It is done in double precision and a score's logit is rounded to ``DECIMALS``, so that equal texts
get equal scores whatever stands beside them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlift.llm.common import forget, mix, table, text_bytes

PASSAGE = 64
SAMPLE = 2000
PASSAGES = 128
DECIMALS = 6
THRESHOLD = 0.7
#: Longer texts (bytes) are encoded on their own, in pieces of this size.
LONG = 1 << 20
FOLDS, HELD_OUT = 4, 2

_GROUPS = [b" ", b"\t\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"'\"`", b"-_", b"#*%&$@^~+=", b"|<>\\/{}[]()"]
CLASSES = len(_GROUPS) + 3
_CLASS = np.full(256, CLASSES - 1, np.int64)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i
_CLASS[0xC0:] = CLASSES - 3
_CLASS[0x80:0xC0] = CLASSES - 2
FEATURES = CLASSES * CLASSES + 4


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Passage features of the texts, and where each text's passages begin (and the end); a text has one at least.

    Takes about 80 bytes for each of the texts, so callers hand over 1 MB or so.
    """
    # A line break after each text keeps words and pairs apart.
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    cls = _CLASS[data]
    inside = cls > 1
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    start = np.flatnonzero(begins)
    word_doc = doc[start]
    n_words = np.bincount(word_doc, minlength=len(texts))
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    base = np.concatenate([[0], np.cumsum(n_passages)])
    nth = np.arange(len(start)) - np.concatenate([[0], np.cumsum(n_words)])[word_doc]
    word_passage = base[word_doc] + nth // PASSAGE
    # a byte belongs to the passage of the last word begun in its document, or else to the first
    seen = np.cumsum(begins) - 1
    own = base[doc]
    ok = seen >= 0
    same = np.zeros(len(data), bool)
    if len(start):
        same[ok] = word_doc[seen[ok]] == doc[ok]
        own = np.where(same, word_passage[np.maximum(seen, 0)], own)
    total = base[-1]
    pair = np.concatenate([_CLASS[10:11], cls[:-1]]) * CLASSES + cls  # the first byte follows a line break, too
    counts = np.bincount(own * (CLASSES * CLASSES) + pair, minlength=total * CLASSES * CLASSES).reshape(total, -1)
    out = np.zeros((total, FEATURES), np.float32)
    out[:, : CLASSES * CLASSES] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    if len(start):
        end = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
        words = np.bincount(word_passage, minlength=total)
        some = np.maximum(1, words)
        place = np.arange(len(data)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(data)]])))
        code = np.where(inside, mix((data.astype(np.uint64) << np.uint64(20)) + place.astype(np.uint64)), np.uint64(0))
        word = np.add.reduceat(code, start)
        key = mix(word + mix(word_doc.astype(np.uint64)))
        run = key.copy()
        run[2:] = mix(key[2:] + np.uint64(3) * key[1:-1] + np.uint64(5) * key[:-2])
        for i, k in ((1, key), (2, run)):
            first = np.zeros(len(k), bool)
            first[np.unique(k, return_index=True)[1]] = True
            out[:, -i] = np.bincount(word_passage, weights=first, minlength=total) / some
        out[:, -3] = np.bincount(word_passage, weights=end - start, minlength=total) / some
        out[:, -4] = np.log1p(words)
    return out, base


def _first(keys: np.ndarray) -> np.ndarray:
    """Whether each key is the first of its kind."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    out = np.empty(len(keys), bool)
    out[order] = np.append(True, keys[1:] != keys[:-1])
    return out


def encode_long(text: bytes, step: int = LONG) -> np.ndarray:
    """What encode() gives for one text, whose bytes are taken up in pieces; memory is some 15 times the text's at most."""
    pieces = lambda: ((at, np.frombuffer(text[at : at + step], np.uint8)) for at in range(0, len(text), step))
    n_words, last = 0, 10
    for _, part in pieces():
        inside = np.concatenate([[_CLASS[last]], _CLASS[part]]) > 1
        n_words += int(np.count_nonzero(inside[1:] & ~inside[:-1]))
        last = int(part[-1])
    n_passages, cells = max(1, -(-n_words // PASSAGE)), CLASSES * CLASSES
    out = np.zeros((n_passages, FEATURES), np.float32)
    word = np.zeros(n_words, np.uint64)
    letters = np.zeros(n_passages, np.int64)
    counts, now = np.zeros((1, cells), np.int64), 0  # of the passage that a piece ends in

    def finish(rows: np.ndarray, first: int) -> None:
        out[first : first + len(rows), :cells] = np.sqrt(rows / np.maximum(1, rows.sum(1, keepdims=True)))

    begun, start, last = 0, 0, 10  # the words so far, the start of the last of them, the byte before a piece
    for at, part in itertools.chain(pieces(), [(len(text), np.array([10], np.uint8))]):  # a line break ends the text
        cls = _CLASS[part]
        before = np.concatenate([[_CLASS[last]], cls[:-1]])
        last = int(part[-1])
        inside = cls > 1
        begins = inside & (before <= 1)
        nth = begun + np.cumsum(begins) - 1
        passage = np.maximum(nth, 0) // PASSAGE
        low, high = int(passage[0]), int(passage[-1]) + 1
        block = np.bincount((passage - low) * cells + before * CLASSES + cls, minlength=(high - low) * cells).reshape(-1, cells)
        if low > now:
            finish(counts, now)
        else:
            block[0] += counts[0]
        finish(block[:-1], low)
        counts, now = block[-1:], high - 1
        own = np.flatnonzero(begins)
        place = at + np.arange(len(part)) - np.concatenate([[start], own + at])[nth - begun + 1]
        some = np.flatnonzero(inside)
        if len(some):
            cut = np.flatnonzero(np.append(True, nth[some][1:] != nth[some][:-1]))
            code = mix((part[some].astype(np.uint64) << np.uint64(20)) + place[some].astype(np.uint64))
            word[nth[some][cut]] += np.add.reduceat(code, cut)
            letters[low:high] += np.bincount(passage[some] - low, minlength=high - low)
        if len(own):
            start, begun = int(own[-1]) + at, begun + len(own)
    finish(counts, now)
    if n_words:
        own = np.arange(n_words) // PASSAGE
        words = np.bincount(own, minlength=n_passages)
        key = mix(word + mix(np.zeros(1, np.uint64)))
        del word
        out[:, -1] = np.bincount(own, weights=_first(key), minlength=n_passages) / words
        run = key.copy()
        run[2:] = mix(key[2:] + np.uint64(3) * key[1:-1] + np.uint64(5) * key[:-2])
        del key
        out[:, -2] = np.bincount(own, weights=_first(run), minlength=n_passages) / words
        out[:, -3] = letters / words
        out[:, -4] = np.log1p(words)
    return out


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """encode(), with a long text on its own."""
    if len(texts) == 1 and len(texts[0]) > LONG:
        x = encode_long(texts[0])
        return x, np.array([0, len(x)])
    return encode(texts)


def _chunks(texts: list[bytes], most: int = LONG) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes; a longer text is alone."""
    at = 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) <= most:
            size += len(texts[stop])
            stop += 1
        yield at, stop
        at = stop


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray  # encoder, FEATURES x hidden
    b: np.ndarray
    v: np.ndarray  # attention, hidden x gate
    u: np.ndarray
    a: np.ndarray  # gate
    c: np.ndarray  # head, hidden
    d: np.ndarray  # and its bias

    def score(self, x: np.ndarray, base: np.ndarray) -> np.ndarray:
        """A number from 0 to 1 for each bag of rows base[i] to base[i + 1]."""
        m = Model(*(np.asarray(a, np.float64) for a in self))
        h, e = np.empty((len(x), len(m.b))), np.empty(len(x))
        for at in range(0, len(x), 4096):
            part = np.tanh((x[at : at + 4096] - m.mean) / m.scale @ m.w + m.b)
            h[at : at + 4096], e[at : at + 4096] = part, np.tanh(part @ m.v) * _sigmoid(part @ m.u) @ m.a
        return _sigmoid(np.round(_pool(h, e, base)[-1] @ m.c + m.d[0], DECIMALS))


def _pool(h: np.ndarray, e: np.ndarray, base: np.ndarray):
    """Of passages h with attention logits e: their shares and bags, and the weighted mean of each bag."""
    bag = np.repeat(np.arange(len(base) - 1), np.diff(base))
    e = np.exp(e - np.maximum.reduceat(e, base[:-1])[bag])
    share = e / np.add.reduceat(e, base[:-1])[bag]
    return share, bag, np.add.reduceat(share[:, None] * h, base[:-1], axis=0)


def _forward(m: Model, x: np.ndarray, base: np.ndarray):
    h = np.tanh(x @ m.w + m.b)
    t, g = np.tanh(h @ m.v), _sigmoid(h @ m.u)
    share, bag, z = _pool(h, (t * g) @ m.a, base)
    return h, t, g, share, bag, z, z @ m.c + m.d[0]


def train(x: np.ndarray, base: np.ndarray, y: np.ndarray, hidden: int = 32, gate: int = 16, epochs: int = 20, seed: int = 7) -> Model:
    """Fits the network by Adam on bags; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), np.maximum(x.std(0), 0.02)
    x = ((x - mean) / scale).astype(np.float32)
    f32 = lambda a: np.asarray(a, np.float32)
    p = [
        f32(rng.normal(0, 0.5 / np.sqrt(x.shape[1]), (x.shape[1], hidden))), f32(np.zeros(hidden)), f32(rng.normal(0, 0.3, (hidden, gate))),
        f32(rng.normal(0, 0.3, (hidden, gate))), f32(rng.normal(0, 0.3, gate)), f32(rng.normal(0, 0.3, hidden)), f32(np.zeros(1)),
    ]
    m1, m2 = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    step, n = 0, len(y)
    for epoch in range(epochs):
        order = rng.permutation(n)
        rate = 0.004 * (1 - epoch / epochs) + 0.0002
        for at in range(0, n, 64):
            ids = order[at : at + 64]
            size = base[ids + 1] - base[ids]
            rows = np.repeat(base[ids] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            xb, bb = x[rows], np.concatenate([[0], np.cumsum(size)])
            m = Model(None, None, *p)
            h, t, g, share, bag, z, s = _forward(m, xb, bb)
            ds = f32((_sigmoid(s) - y[ids]) * weight[ids] / len(ids))
            dz = ds[:, None] * m.c
            dshare = (dz[bag] * h).sum(1)
            de = share * (dshare - np.add.reduceat(share * dshare, bb[:-1])[bag])
            dt, dg = de[:, None] * m.a * g * (1 - t * t), de[:, None] * m.a * t * g * (1 - g)
            dh = share[:, None] * dz[bag] + dt @ m.v.T + dg @ m.u.T
            dx = dh * (1 - h * h)
            grads = [xb.T @ dx + 1e-4 * m.w, dx.sum(0), h.T @ dt, h.T @ dg, (t * g).T @ de, z.T @ ds + 1e-4 * m.c, np.array([ds.sum()])]
            step += 1
            for i, q in enumerate(grads):
                m1[i] = 0.9 * m1[i] + 0.1 * q
                m2[i] = 0.999 * m2[i] + 0.001 * q * q
                p[i] = f32(p[i] - rate * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8))
    return Model(f32(mean), f32(scale), *p)


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | float:
    """A model from the labelled rows of the training folds; the rate of label 1 (or 0.5) if there is one class only."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so its broadcast is

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            rows = []
            for at, stop in _chunks(texts):
                x, base = features(texts[at:stop])
                for a, b in zip(base[:-1], base[1:], strict=True):
                    some = np.arange(a, b) if b - a <= PASSAGES else np.linspace(a, b - 1, PASSAGES).astype(np.int64)
                    rows.append(x[some].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["doc_id", "quality", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality").mapInArrow(work, "doc_id long, quality int, x binary")
    rows = sorted(rows.collect(), key=lambda r: (r.doc_id, r.x))
    y = np.array([r.quality for r in rows])
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    bags = [np.frombuffer(r.x, np.float16).reshape(-1, FEATURES) for r in rows]
    base = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return train(np.concatenate(bags).astype(np.float32), base, y)


def score_texts(texts: list[bytes], model: Model | float) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(texts), model)
    parts = [model.score(*features(texts[at:stop])) for at, stop in _chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id and score for each row of ``docs`` (doc_id, text); null counts as empty, which is one passage without words.

    Repeated rows repeat; an empty table gives none; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_texts(text_bytes(b.column(1)), model))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model | float, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, as they are, with all their columns.

    Null texts count as empty and are judged like any; repeated rows have one fate, and an empty table gives none.
    """
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            yield b.filter(pa.array(score_texts(text_bytes(b.column(at)), model) >= threshold))

    return docs.mapInArrow(work, docs.schema)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
