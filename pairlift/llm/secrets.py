"""Secret scans with a recursive decoding worklist.

A text is scanned as it is (the base findings); then every encoded part is unwrapped into a new
layer, which is scanned and unwrapped in turn until no layer yields another (URL escapes, Unicode
escapes, base64, and gzip, zlib, bzip2 or Zstandard streams inside base64).  Each character of a layer knows the span of the
original text it came from, so findings in any layer map back to the original.  A layer seen before
in the same document is not opened again, which ends cycles.

Base64 over several lines is joined, and tried from each of the first four characters, so that what
stands before it in the run only spoils the bytes it shares.

Documents are independent, so there is no shuffle.  A stream that inflates to more than ``max_layer`` bytes is scanned
in pieces of that size that overlap, so that memory is bounded; original texts have no limit.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlift.llm.common import forget, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # the same matches as AKIA[A-Z0-9]+ of 18 or more: a run has one end
HEX = re.compile(r"[0-9a-f]{16,}")
MAX_LAYER = 1 << 24
#: Characters that the pieces of a long stream share.
OVERLAP = 1 << 16

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
_STREAM = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]", re.S)
#: Printable UTF-8 long enough for a finding.
_TEXT = re.compile(
    rb"(?:[\t\r\n\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){16,}"
)


class Span(NamedTuple):
    kind: str
    start: int
    end: int


class Layer(NamedTuple):
    """A text and, for each of its characters, the original span; None stands for the original itself."""

    text: str
    starts: np.ndarray | None
    ends: np.ndarray | None

    def origin(self, a: int, b: int) -> tuple[int, int]:
        if self.starts is None:
            return a, b
        return int(self.starts[a:b].min()), int(self.ends[a:b].max())


def matches(text: str) -> list[Span]:
    """The findings of one layer, leftmost and non-overlapping within a kind, by start and then kind."""
    found = [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [Span("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [Span("hex", *m.span()) for m in HEX.finditer(text)]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def _piece(layer: Layer, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    if layer.starts is None:
        own = np.arange(a, b)
        return own, own + 1
    return layer.starts[a:b], layer.ends[a:b]


def _utf8(data: bytes, strict: bool = False) -> list[tuple[str, int, int]] | None:
    """Characters with the byte range of each; bytes that are not UTF-8 give U+FFFD each, or None for all if strict."""
    try:
        text = data.decode(errors="strict" if strict else "surrogateescape")
    except UnicodeDecodeError:
        return None
    out, at = [], 0
    for c in text:
        odd = "\udc80" <= c <= "\udcff"
        n = 1 if odd else len(c.encode())
        out.append(("\ufffd" if odd else c, at, at + n))
        at += n
    return out


def _percent(run: str) -> list[tuple[str, int, int]] | None:
    data = bytes.fromhex(run.replace("%", ""))
    got = _utf8(data)
    return got and [(c, 3 * a, 3 * b) for c, a, b in got]


def _escape(run: str) -> list[tuple[str, int, int]] | None:
    try:
        if run.startswith("&#"):
            return [(chr(int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])), 0, len(run))]
        if run.startswith(("\\u{", "\\U")):
            return [(chr(int(run[3:-1] if run[2] == "{" else run[2:], 16)), 0, len(run))]
        if run.startswith("\\x"):
            got = _utf8(bytes.fromhex(run.replace("\\x", "")))
            return got and [(c, 4 * a, 4 * b) for c, a, b in got]
        text = b"".join(int(run[i + 2 : i + 6], 16).to_bytes(2, "big") for i in range(0, len(run), 6)).decode("utf-16-be")
        out, at = [], 0
        for c in text:
            n = 6 if ord(c) < 0x10000 else 12
            out.append((c, at, at + n))
            at += n
        return out
    except (ValueError, OverflowError):
        return None


def _in_place(layer: Layer, pattern: re.Pattern, decode) -> list[Layer]:
    """The lines with escapes, decoded in place, each as a layer."""
    out, text, done = [], layer.text, -1
    for first in pattern.finditer(text):
        if first.start() < done:
            continue
        a = text.rfind("\n", 0, first.start()) + 1
        b = text.find("\n", first.end())
        done = b = len(text) if b < 0 else b
        chars, starts, ends, at = [], [], [], a
        for m in pattern.finditer(text, a, b):
            got = decode(m[0])
            if not got:
                continue
            s, e = _piece(layer, at, m.start())
            chars.append(text[at : m.start()])
            starts.append(s), ends.append(e)
            s, e = _piece(layer, *m.span())
            chars.append("".join(c for c, _, _ in got))
            starts.append(np.array([s[i] for _, i, _ in got]))
            ends.append(np.array([e[j - 1] for _, _, j in got]))
            at = m.end()
        if at == a:
            continue
        s, e = _piece(layer, at, b)
        chars.append(text[at:b])
        out.append(Layer("".join(chars), np.concatenate([*starts, s]), np.concatenate([*ends, e])))
    return out


class _Source:
    """Pieces of bytes as a file."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.left = parts, b""

    def read(self, n: int) -> bytes:
        if not self.left:
            self.left = next(self.parts, b"")
        out, self.left = self.left[:n], self.left[n:]
        return out


def _inflate(parts: Iterator[bytes], size: int) -> Iterator[bytes]:
    """What a stream holds, streams inside it inflated in turn, in pieces of at most ``size`` bytes; as far as it is sound."""
    first = next(parts, b"")
    while 0 < len(first) < 4 and (more := next(parts, b"")):
        first += more
    parts = itertools.chain([first], parts)
    if first[:2] == b"\x1f\x8b" or first[:1] == b"\x78":
        inner = _inflate_zlib(parts, size)
    elif first[:3] == b"BZh":
        inner = _inflate_bz2(parts, size)
    elif first[:4] == b"\x28\xb5\x2f\xfd":
        inner = _inflate_zstd(parts, size)
    else:
        yield from parts
        return
    head = next(inner, None)
    if head is None:  # not a stream after all
        yield first
        yield from parts
        return
    yield from _inflate(itertools.chain([head], inner), size)


def _inflate_zlib(parts: Iterator[bytes], size: int) -> Iterator[bytes]:
    d = zlib.decompressobj(47)
    for left in parts:
        while not d.eof:
            try:
                out = d.decompress(left, size)
            except zlib.error:
                return
            left = d.unconsumed_tail
            if out:
                yield out
            if not left and len(out) < size:
                break


def _inflate_bz2(parts: Iterator[bytes], size: int) -> Iterator[bytes]:
    d = bz2.BZ2Decompressor()
    for left in parts:
        while not d.eof:
            try:
                out = d.decompress(left, size)
            except OSError:
                return
            left = b""
            if out:
                yield out
            if d.needs_input:
                break


def _inflate_zstd(parts: Iterator[bytes], size: int) -> Iterator[bytes]:
    with zstandard.ZstdDecompressor().stream_reader(_Source(parts)) as r:
        try:
            while out := r.read(size):
                yield out
        except zstandard.ZstdError:
            return


def _readable(text: str) -> bool:
    return bool(text) and sum((c.isprintable() and c != "\ufffd") or c in "\t\r\n" for c in text) >= 0.95 * len(text)


def _unpacked(data: bytes, start: int, end: int, limit: int) -> Iterator[Layer]:
    """What is in a compressed stream, readable or not; each piece has the span of the whole run."""
    decoder, tail, held = codecs.getincrementaldecoder("utf-8")("replace"), "", b""

    def layer(piece: bytes, final: bool) -> Iterator[Layer]:
        nonlocal tail
        text = tail + decoder.decode(piece, final)
        tail = text[-min(OVERLAP, limit // 2) :]
        if text:
            n = len(text)
            yield Layer(text, np.broadcast_to(np.int64(start), n), np.broadcast_to(np.int64(end), n))

    for piece in _inflate(iter([data]), limit):
        if held and len(held) + len(piece) > limit:
            yield from layer(held, False)
            held = b""
        held += piece
    yield from layer(held, True)


def _base64(layer: Layer, limit: int) -> Iterator[Layer]:
    for pattern in (_BASE64, _WRAPPED):
        for m in pattern.finditer(layer.text):
            starts, ends = _piece(layer, *m.span())
            at = np.array([i for i, c in enumerate(m[0]) if c not in "= \t\r\n"])
            run, starts, ends = "".join(m[0].split()).rstrip("="), starts[at], ends[at]
            for skip in range(4):
                part = run[skip:]
                part = part[: len(part) - (len(part) % 4 == 1)]
                yield from _decoded(part, starts[skip:], ends[skip:], limit, (int(starts.min()), int(ends.max())))


def _decoded(run: str, starts: np.ndarray, ends: np.ndarray, limit: int, whole: tuple[int, int]) -> Iterator[Layer]:
    """What base64 from the run's first character on holds: all of it if readable, its readable parts, and streams."""
    data = base64.b64decode(run.translate({45: 43, 95: 47}) + "=" * (-len(run) % 4))
    for at in sorted({0, *(m.start() for m in _STREAM.finditer(data))}):
        if _inflates(data[at:]):
            yield from _unpacked(data[at:], *whole, limit)
    parts = [m.span() for m in _TEXT.finditer(data)]
    if parts != [(0, len(data))]:
        got = _utf8(data, strict=True)
        if got and _readable("".join(c for c, _, _ in got)):
            parts.append((0, len(data)))
    for a, b in parts:
        got = _utf8(data[a:b])
        yield Layer(  # byte i comes from the characters that hold its bits
            "".join(c for c, _, _ in got),
            np.array([starts[(a + i) * 8 // 6] for _, i, _ in got]),
            np.array([ends[min(-(-(a + j) * 8 // 6), len(run)) - 1] for _, _, j in got]),
        )


def _inflates(data: bytes) -> bool:
    """Whether a compressed stream begins here."""
    for of in (_inflate_zlib, _inflate_bz2, _inflate_zstd):
        if (of is _inflate_zlib) == (data[:2] == b"\x1f\x8b" or data[:1] == b"\x78") and next(of(iter([data]), 64), None):
            return True
    return False


def unwrap(layer: Layer, limit: int = MAX_LAYER) -> Iterator[Layer]:
    if "%" in layer.text:
        yield from _in_place(layer, _PERCENT, _percent)
    if "\\" in layer.text or "&#" in layer.text:
        yield from _in_place(layer, _ESCAPE, _escape)
    yield from _base64(layer, limit)


def scan(text: str, limit: int = MAX_LAYER) -> tuple[list[Span], list[Span]]:
    """The base findings of a text, and all findings with those in its decoded layers."""
    base = matches(text)
    todo, seen, found = [unwrap(Layer(text, None, None), limit)], set(), set(base)
    while todo:  # depth first, a layer at a time
        inner = next(todo[-1], None)
        if inner is None:
            todo.pop()
            continue
        key = (hashlib.blake2b(inner.text.encode("utf-8", "replace"), digest_size=16).digest(), inner.origin(0, len(inner.text)))
        if key in seen:
            continue
        seen.add(key)
        found.update(Span(s.kind, *inner.origin(s.start, s.end)) for s in matches(inner.text))
        todo.append(unwrap(inner, limit))
    return base, in_order(list(found))


def written(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find_secrets(docs: DataFrame, max_layer: int = MAX_LAYER) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) for each row of ``docs``; null text: empty arrays.

    Repeated rows repeat; other columns are ignored; an empty table gives none.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            got = [scan(t or "", max_layer) for t in b.column(1).to_pylist()]
            lists = [pa.array([[s._asdict() for s in g[i]] for g in got], pa.list_(span)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, f"doc_id long, base {kind}, spans {kind}")


def redact(docs: DataFrame, mark: str = "[secret]", max_layer: int = MAX_LAYER) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mark`` (overlapping ones as one) and n_chars to match.

    Rows without findings, null and empty texts among them, stay as they are, and so do all other columns.  Repeated rows
    repeat; an empty table gives none.
    """
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            texts = b.column(at).to_pylist()
            counts = b.column(count).to_pylist() if count is not None else []
            for i, t in enumerate(texts):
                if t and (spans := scan(t, max_layer)[1]):
                    out, end = [], 0
                    for s in spans:
                        if s.start >= end:
                            out += [t[end : s.start], mark]
                        end = max(end, s.end)
                    texts[i] = "".join([*out, t[end:]])
                    if count is not None:
                        counts[i] = len(texts[i])
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            if count is not None:
                cols[count] = pa.array(counts, b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return docs.mapInArrow(work, docs.schema)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    join = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(join("base"), 256).alias("base_sha256"), join("spans").alias("spans"))
