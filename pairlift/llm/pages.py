"""HTML extraction with a site style tree (after Yi, Liu and Li, 2003).

The pages of a host are merged by element paths.  For every path the tree knows on how many pages it
occurs (m), which sequences of child elements it has there (presentation) and which texts stand in its
branch (content).  The presentation importance is the entropy of the child sequences to the base m; a text on c of m
pages has the entropy log c / log m, and the content importance is the mean of one minus that.  Template parts look alike
everywhere and score near 0.  Few pages say little, so ``DOUBT`` pages that differ in everything are added to each path; then a branch
below ``LOW`` goes.  If that were all of a page, the low branch with the most text stays, so an article that a host repeats is kept.

What the tree can't see, such as adverts and comments that differ from page to page, goes by what elements say about themselves:
element names and roles; and names of classes and ids, but those never for what holds the main text.  An element named so as a whole
("comments") goes if it holds less than four fifths of the text, one with the word in its name ("related-posts") if less than half, and
both go in any case beside an article or main element; neither goes if such an element is inside.  Of what is left the articles (or else the main elements) are the text if they
hold a fair share of it, and else all of it is.

The tree is a grouped count: rows (host, path, feature) combine in tasks before the shuffle, so a host of any
size spreads over all tasks.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlift.llm.common import stash, table, worker_cache

LOW = 0.2
#: Pages of doubt that count against a template; of pages that are all alike it takes three.
DOUBT = 0.6
#: Articles with less than this share of the text left are teasers, not the text.
FAIR = 0.25
#: Elements further below their region's root are no branches of their own.
DEPTH = 64
PRESENTATION = 0.3
#: Up to this many low branches (8 bytes each) are broadcast; more are joined.
MAX_BROADCAST = 1 << 20

_NAME = re.compile(r"/?[A-Za-z][A-Za-z0-9:-]*")
#: The rest of a tag, with and without heed to quotes; possessive, so that a failure costs one pass.
_REST = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split()
)
_NOISE = set("head script style noscript template nav footer aside form button select option input textarea iframe svg canvas dialog menu title object audio video map".split())
_NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription sidebar sidenav menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments commentlist reply replies respond disqus related recommended share "
    "sharing social widget pagination pager toolbar login signup register hidden skip".split()
)
#: Parts of names that say what is elsewhere, as in "has-sidebar".
_ABOUT = set("has no with without is not enabled disabled on off".split())
#: Parts of names that speak of the text itself.
_TEXT_WORDS = set("article body content entry main post story text".split())
_KEEP = {"html", "body", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Within an article only these go by their names.
_HOLDERS = set("article aside details div dl fieldset figure footer header nav ol section table ul".split())
_CLOSE = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_BOUND = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "article", "main", "section", "div", "body", "html"}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Element:
    __slots__ = ("tag", "path", "noise", "region", "branch", "suspect", "owner", "depth", "up", "children")

    def __init__(self, tag: str, path: int, up: "Element | None", noise: bool = False, region: int = 0, suspect: int = -1):
        self.tag, self.path, self.up, self.noise, self.region, self.suspect = tag, path, up, noise, region, suspect
        self.children: list[str] = []
        self.owner = self  # the element that a text in here belongs to: the innermost that is a block or noise
        self.branch: Element | None = None  # the innermost branch around, up to the region's root
        self.depth = 0


class Block(NamedTuple):
    text: str
    branches: tuple[int, ...]  # paths below the region's root, outermost first
    region: int  # 2 within an article, 1 within a main element, 0 elsewhere
    suspect: int = -1  # the innermost suspect around


#: A name is noise as a whole, in part, or beside a word for the text.
WHOLE, PART, BESIDE = 3, 2, 1


class Suspect(NamedTuple):
    named: int
    up: int  # the next suspect around


class Page(NamedTuple):
    blocks: list[Block]  # outside of noise, in order
    styles: dict[int, str]  # the child sequences of their branches
    suspects: list[Suspect]
    safe: set[int]  # suspects with an article or main element inside


def _sign(tag: str, attributes: str) -> tuple[int, bool, int, int]:
    """Hash of tag and class, whether the element is noise, the region it opens, and how its name is noise (0: not at all); remembered."""
    signs, key = worker_cache("signs", dict), (tag, attributes)
    if key in signs:
        return signs[key]
    names, role, hidden = "", "", False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            names += " " + value
        elif name == "role":
            role = value.strip().lower()
        hidden |= name == "hidden" or (name == "aria-hidden" and value.lower() == "true")
    named = 0
    for token in names.split() if tag not in _KEEP else ():
        parts = [w.lower() for w in _WORDS.findall(token)]
        if token.lower() in _NOISE_WORDS:
            named = WHOLE
        elif not _NOISE_WORDS.isdisjoint(parts) and _ABOUT.isdisjoint(parts):
            named = max(named, PART if _TEXT_WORDS.isdisjoint(parts) else BESIDE)
    noise = tag in _NOISE or role in _NOISE_ROLES or hidden
    region = 2 if tag == "article" or role == "article" else 1 if tag == "main" or role == "main" else 0
    if region and named == WHOLE:  # an article that is a comment or an advert
        region = 0
    sign = xxhash.xxh3_64_intdigest(f"{tag} {re.sub('[0-9]+', '', names)}"), noise, region, named
    if len(signs) > 100_000:
        signs.clear()
    signs[key] = sign
    return sign


def parse(page: str) -> Page:
    """Takes time in proportion to the page, whatever its markup."""
    blocks: list[Block] = []
    styles: dict[int, str] = {}
    suspects: list[Suspect] = []
    safe: set[int] = set()
    root = Element("", 0, None)
    stack = [root]
    open_tags: Counter[str] = Counter()
    held: list[str] = []
    owner = root

    def flush() -> None:
        nonlocal held
        if held:
            text = " ".join("".join(held).split())
            held = []
            if text and not owner.noise:
                path, e = [], owner.branch
                while e is not None:
                    path.append(e.path)
                    e = e.up.branch
                blocks.append(Block(text, tuple(path[::-1]), owner.region, owner.suspect))

    def close(n: int) -> None:
        while len(stack) > n:
            e = stack.pop()
            open_tags[e.tag] -= 1
            if e.branch is e and not e.noise:
                styles.setdefault(e.path, " ".join(e.children))

    def close_open(tags: set[str]) -> None:
        if any(open_tags[t] > 0 for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    close(i)
                    break
                if stack[i].tag in _BOUND:
                    break

    def add_text(s: str) -> None:
        nonlocal owner
        now = stack[-1].owner
        if held and now.noise != owner.noise:
            flush()
        if not held:
            owner = now
        if not now.noise:
            held.append(html.unescape(s))

    at, end, quotes = 0, len(page), True
    while at < end:
        lt = page.find("<", at)
        if lt != at:
            add_text(page[at : lt if lt >= 0 else end])
            if lt < 0:
                break
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        m = _NAME.match(page, lt + 1)
        rest = None
        if m:
            rest = _REST.match(page, m.end()) if quotes else None
            if rest is None:  # a quote that is never closed: from here on quotes say nothing
                quotes = False
                stop = page.find(">", m.end())
                if stop < 0:
                    add_text(page[lt:])
                    break
                rest = page[m.end() : stop], stop + 1
            else:
                rest = rest[0][:-1], rest.end()
        if not m:
            add_text("<")
            at = lt + 1
            continue
        attributes, at = rest
        tag = m[0].lower()
        if tag[0] == "/":
            tag = tag[1:]
            block = tag not in _INLINE
            if open_tags[tag] > 0:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        if block or stack[i].noise:
                            flush()
                        close(i)
                        break
            elif block:
                flush()
            continue
        block = tag not in _INLINE
        if block:
            flush()
            close_open({"p"})  # a block ends an open paragraph
        if tag in _CLOSE:
            close_open(_CLOSE[tag])
        if tag == "br":
            held.append(" ") if held else None
            continue
        parent = stack[-1]
        sign, noise, region, named = _sign(tag, attributes.strip().rstrip("/"))
        if tag in _VOID or attributes.endswith("/") and tag in ("svg", "path"):
            continue
        if tag == "header" and not parent.region:
            noise = True
        if block and (not parent.children or parent.children[-1] != tag):
            parent.children.append(tag)
        if noise and not parent.noise:
            flush()
        e = Element(tag, xxhash.xxh3_64_intdigest(parent.path.to_bytes(8, "little"), sign), parent, parent.noise or noise, max(region, parent.region), parent.suspect)
        if named and not e.noise and (not parent.region or tag in _HOLDERS):
            suspects.append(Suspect(named, parent.suspect))
            e.suspect = len(suspects) - 1
        if region > parent.region:
            x = e.suspect
            while x >= 0 and x not in safe:
                safe.add(x)
                x = suspects[x].up
        opens = region > parent.region or not parent.tag or parent.tag == "html" and tag == "body"
        if opens or not parent.tag:
            e.branch, e.depth = None, 0
        elif block and parent.depth < DEPTH:
            e.branch, e.depth = e, parent.depth + 1
        else:
            e.branch, e.depth = parent.branch, parent.depth
        if not block and not (noise and not parent.noise):
            e.owner = parent.owner
        stack.append(e)
        open_tags[tag] += 1
        if tag in _RAW:
            stop = _raw_end(tag).search(page, at)
            close(len(stack) - 1)
            at = stop.end() if stop else (end if tag in ("script", "style") else at)
    flush()
    close(1)
    return Page(blocks, styles, suspects, safe)


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def _without_suspects(page: Page, blocks: list[Block]) -> list[Block]:
    """The blocks without those in elements that go by their names."""
    n = len(page.suspects)
    if not n:
        return blocks
    size = [0] * n
    total = main = 0
    for b in blocks:
        total += len(b.text)
        main += len(b.text) if b.region and (b.suspect < 0 or b.suspect in page.safe) else 0
        if b.suspect >= 0:
            size[b.suspect] += len(b.text)
    for i in range(n - 1, -1, -1):  # those around come first
        if page.suspects[i].up >= 0:
            size[page.suspects[i].up] += size[i]
    gone, left = [False] * n, total
    for i, x in enumerate(page.suspects):
        if x.up >= 0 and gone[x.up]:
            gone[i] = True
        elif i not in page.safe and size[i] and size[i] < left:
            # beside an article it may hold any share of the text; else not nearly all of it, or half
            gone[i] = (main > 0 and x.named > BESIDE) or (5 * size[i] < 4 * total if x.named == WHOLE else 2 * size[i] < total)
            left -= size[i] if gone[i] else 0
    return [b for b in blocks if b.suspect < 0 or not gone[b.suspect]]


def main_text(page: Page, low: set[int] = frozenset()) -> str:
    """The main text of a page whose low branches are known."""
    blocks = page.blocks
    if low:
        blocks = [b for b in blocks if low.isdisjoint(b.branches)]
        if not blocks:  # if nothing else is left, the low branch with the most text
            of = [next(x for x in b.branches if x in low) for b in page.blocks]
            size: Counter[int] = Counter()
            for x, b in zip(of, page.blocks, strict=True):
                size[x] += len(b.text)
            most = max(size, key=size.__getitem__, default=None)
            blocks = [b for x, b in zip(of, page.blocks, strict=True) if x == most]
    blocks = _without_suspects(page, blocks)
    total = sum(len(b.text) for b in blocks)
    for region in (2, 1):
        own = [b for b in blocks if b.region >= region]
        if own and sum(len(b.text) for b in own) >= FAIR * total:
            blocks = own
            break
    return "\n".join(b.text for b in blocks)


def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _key(site: int, path: int) -> int:
    return xxhash.xxh3_64_intdigest(path.to_bytes(8, "little"), site) - (1 << 63)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(branch, kind, feature) once for each page that has it; kind 0 is the branch, 1 a child sequence, 2 a text."""
    for b in batches:
        rows: list[tuple[int, int, int]] = []
        for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if not page:
                continue
            site = xxhash.xxh3_64_intdigest(host(url))
            blocks, styles, *_ = parse(page)
            own = {x for k in blocks for x in k.branches}
            key = {x: _key(site, x) for x in own}
            found = {(key[x], 0, 0) for x in own}
            found |= {(key[x], 1, xxhash.xxh3_64_intdigest(styles.get(x, "")) - (1 << 63)) for x in own}
            found |= {(key[x], 2, xxhash.xxh3_64_intdigest(k.text) - (1 << 63)) for k in blocks for x in k.branches}
            rows += found
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], names=["branch", "kind", "feature"])


def style_tree(pages: DataFrame) -> DataFrame:
    """(branch, pages, importance) for the branches on more than one page of their host; pages: (url, html)."""
    counted = pages.select("url", "html").mapInArrow(_features, "branch long, kind int, feature long").groupBy("branch", "kind", "feature").agg(F.count("*").alias("n"))
    log_n = F.col("n") * F.log("n")
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x).otherwise(0))
    nodes = counted.groupBy("branch").agg(
        of(0, F.col("n")).alias("pages"), of(1, log_n).alias("shapes"), of(2, F.col("n")).alias("texts"), of(2, log_n).alias("repeated"),
    ).where("pages > 1")
    base = F.log("pages")
    presentation = (base - F.col("shapes") / F.col("pages")) / base
    content = F.when(F.col("texts") > 0, 1 - F.col("repeated") / F.col("texts") / base).otherwise(0.0)
    found = PRESENTATION * presentation + (1 - PRESENTATION) * content
    return nodes.select("branch", "pages", ((F.col("pages") * found + DOUBT) / (F.col("pages") + DOUBT)).alias("importance"))


def extract(pages: DataFrame, low: float = LOW, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """page_id, url and text (the main text) for each row of ``pages`` (page_id, url, html).

    Null html counts as empty and gives an empty text.  A null url is a host of its own.  Repeated rows repeat, and count as
    pages; other columns are ignored; an empty table gives none.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    noise = stash(style_tree(rows).where(F.col("importance") < low).select("branch"), "low-branches")
    few = noise.count() <= max_broadcast
    known = np.sort(noise.toArrow().column(0).to_numpy()) if few else None  # at most max_broadcast rows

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = set(known.tolist()) if known is not None else set()
        for b in batches:
            texts = []
            lists = b.column(3).to_pylist() if known is None else [None] * b.num_rows
            for url, page, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), lists, strict=True):
                if not page:
                    texts.append("")
                    continue
                parsed = parse(page)
                bad = listed if known is not None else set(own or ())
                site = xxhash.xxh3_64_intdigest(host(url))
                gone = {x for x in {x for k in parsed.blocks for x in k.branches} if _key(site, x) in bad} if bad else set()
                texts.append(main_text(parsed, gone))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    if known is None:  # each page's own low branches, by a join

        def branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, keys = [], []
                for i, url, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    site = xxhash.xxh3_64_intdigest(host(url))
                    for x in {x for k in (parse(page).blocks if page else []) for x in k.branches}:
                        ids.append(i), keys.append(_key(site, x))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64())], names=["own_id", "branch"])

        own = rows.mapInArrow(branches, "own_id long, branch long").join(noise, "branch").groupBy("own_id").agg(F.collect_set("branch").alias("own"))
        rows = rows.join(own, F.col("page_id").eqNullSafe(F.col("own_id")), "left").select("page_id", "url", "html", "own")
    return rows.mapInArrow(work, "page_id long, url string, text string")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
