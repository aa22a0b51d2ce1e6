"""Pages, vectors, the pipeline and the queries."""

import numpy as np
import pytest
from samples import corpus, frame
from pyspark.sql import functions as F

import corpus_pipeline
from pairlift.llm import nearest, pages, queries

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div id="cookie-notice">We use cookies</div>
%s<aside>side</aside><form>find <input></form><div class="comments"><p>first!</p></div><footer>&copy; x</footer></body></html>"""


def main(html):
    return pages.main_text(pages.parse(html))


def test_main_text():
    body = "<h2>Tit&eacute;</h2><p>One <a href=x>two</a>\n three<br>four &amp;amp; 4<p><b>Five<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>"
    text = "Tité\nOne two three four &amp; 4\nFive\na\nb\nc\nd"
    assert main(PAGE % f"<article>{body}</article>") == text
    assert main(PAGE % f"<div>{body}</div>") == text
    assert main(PAGE % f'<main>{body}<section class="related-posts"><p>more</p></section></main>') == text
    assert main(PAGE % f'<article>{body}</article><article class="comment"><p>no</p></article>') == text
    for odd in ("", "plain", "<", "<p", "<p>a</b></i>c", "<script>never closed <p>x", "<!-- open <p>x"):
        main(odd)
    assert main("a < b & c") == "a < b & c"


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_style_tree(spark, limit):
    """A block that all pages of a host repeat goes, though nothing names it; an article that a host repeats stays."""
    rows = [(i, f"http://a.example/{i}", PAGE % f"<div><p>text {i} of its own</p><p>and more {i}</p></div><table><tr><td>Call us now</table>") for i in range(8)]
    rows += [(100 + i, f"http://b.example/{i}", PAGE % "<div><p>the same article everywhere</p></div>") for i in range(8)]
    rows += [(200, "http://c.example/", None), (201, None, ""), (202, None, PAGE % "<article>x</article>"), (0, "http://a.example/0", rows[0][2])]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("branch", F.lit(1))
    got = {(r.page_id, r.url): r.text for r in pages.extract(table, max_broadcast=limit).collect()}
    assert got[1, "http://a.example/1"] == "text 1 of its own\nand more 1"
    assert got[103, "http://b.example/3"] == "the same article everywhere"
    assert got[200, "http://c.example/"] == got[201, None] == "" and got[202, None] == "x"
    assert pages.extract(table.where("false")).count() == 0


def test_long_template(spark):
    """A template longer than the text goes too; beside a repeated article, a shorter repeated block goes."""
    menu = "<table>" + "".join(f"<tr><td>Department number {i} of the shop" for i in range(40)) + "</table>"
    rows = [(i, f"http://a.example/{i}", f"<body><div><p>text {i}</p></div>{menu}</body>") for i in range(8)]
    rows += [(100 + i, f"http://b.example/{i}", "<body><div><p>the same article everywhere</p></div><table><tr><td>Call us</table></body>") for i in range(8)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"text {i}" for i in range(8)}, **{100 + i: "the same article everywhere" for i in range(8)}}


@pytest.mark.parametrize("names", ["layout has-sidebar", "content no-sidebar", "entry-content share-enabled", "post widget-content", "with-header", "widget", "post-header-image"])
def test_wrappers_keep_their_text(names):
    body = "<h2>A title</h2>" + "<p>Some words of the article that go on for a while.</p>" * 5
    text = "\n".join(["A title"] + ["Some words of the article that go on for a while."] * 5)
    assert main(f'<body><div class="{names}">{body}</div><footer>f</footer><div class="ad">Buy</div></body>') == text
    assert main(f'<body><nav>n</nav><div class="{names}"><article>{body}</article></div><div class="comments">{"<p>Me too</p>" * 200}</div></body>') == text
    assert main(f'<body><article><p class="notice">Mind the step.</p>{body}<div class="comments"><p>no</p></div></article></body>') == "Mind the step.\n" + text
    teaser = "<article><p>Read this too</p></article>"
    assert main(f"<body>{teaser}<div>{body}</div></body>") == "Read this too\n" + text


def test_odd_markup_takes_no_time():
    import time

    began = time.monotonic()
    for odd in ("<a '" * 250_000, "<a '>x" * 100_000, '<p class="x' * 100_000, "<div>" * 100_000, "<div>x" * 50_000, "<b><h1>" * 50_000, "<b>x" * 50_000, "<div>" * 50_000 + "</x>" * 50_000, "<!--" * 200_000, '<div class="ad">x' * 50_000, "<" * 500_000, "<li><b>" * 50_000):
        main(odd)
    assert time.monotonic() - began < 60


def test_importance_against_plain_loops(spark):
    import math
    from collections import Counter, defaultdict

    rng = np.random.default_rng(6)
    page = lambda i: "".join(f"<div class=c{'' if rng.random() < 0.8 else 'x'}><p>{rng.integers(0, 3)}</p>" + ("<ul><li>same</ul>" if rng.random() < 0.6 else "") + "</div>" for _ in range(2))
    rows = [(f"http://h{i % 3}.example/{i}", f"<body>{page(i)}<table><tr><td>menu</table></body>") for i in range(24)]
    got = {r.branch: (r.pages, r.importance) for r in pages.style_tree(spark.createDataFrame(rows, "url string, html string")).collect()}
    shapes, texts, seen = defaultdict(Counter), defaultdict(Counter), Counter()
    for url, html in rows:
        parsed = pages.parse(html)
        site = pages.xxhash.xxh3_64_intdigest(pages.host(url))
        inside = defaultdict(set)
        for b in parsed.blocks:
            for x in b.branches:
                inside[pages._key(site, x), parsed.styles.get(x, "")].add(b.text)
        for (x, style), own in inside.items():
            seen[x] += 1
            shapes[x][style] += 1
            texts[x].update(own)
    expected = {}
    for x, m in seen.items():
        if m > 1:
            p = [c / m for c in shapes[x].values()]
            presentation = -sum(q * math.log(q, m) for q in p)
            content = sum((1 - math.log(c, m)) * c for c in texts[x].values()) / sum(texts[x].values())
            expected[x] = m, (m * (pages.PRESENTATION * presentation + (1 - pages.PRESENTATION) * content) + pages.DOUBT) / (m + pages.DOUBT)
    assert got.keys() == expected.keys() and len(got) > 6
    for x, (m, importance) in expected.items():
        assert got[x][0] == m and math.isclose(got[x][1], importance, abs_tol=1e-9)


def test_host():
    assert pages.host("HTTP://u@A.example:8/x") == pages.host("//a.example?y") == "a.example" and pages.host(None) == pages.host("x") == ""


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 10)).astype(np.float32)
    x[100:160] = x[100]  # a vector with many copies, queries among them
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 10), (1040, [float("nan")] * 10), (1060, [float("inf")] + [0.0] * 9), (1080, [None] * 10), (1100, []), (None, x[0].tolist()), (2001, [1.0, 2.0]), (2020, [2.0, 1.0]), (7, x[7].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash"))
    got = nearest.nearest(table, lambda v: v % 20 == 0)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids = np.append(np.arange(600), 7)
    all_x = np.concatenate([x, x[7:8]]).astype(float)
    hits = 0
    for q in range(0, 600, 20):
        s = all_x @ x[q].astype(float)
        best = [i for i in np.lexsort((ids, -np.round(s, 12))) if ids[i] != q][:20]
        mine = sorted(found[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert np.allclose([s for _, _, s in mine], [all_x[list(ids).index(v)] @ x[q] for _, v, _ in mine], atol=1e-9)
        hits += len({ids[i] for i in best} & {v for _, v, _ in mine})
    assert hits >= 0.95 * 600
    copies = [v for _, v, _ in sorted(found[100]) if 100 <= v < 160]
    assert copies == list(range(101, 101 + len(copies))) and len(copies) > 10
    assert found[2020] == [(1, 2001, 4.0)] and set(found) == {*range(0, 600, 20), 2020}
    assert nearest.nearest(table.where("false"), lambda v: v % 20 == 0).count() == 0


def test_nearest_in_a_crowd(spark, monkeypatch):
    """A third of the rows are near copies, which the codes can't tell apart; cells and blocks are many."""
    monkeypatch.setattr(nearest, "CELL", 300)
    monkeypatch.setattr(nearest, "BLOCK", 256 * 16)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 16))
    x[:1000] = x[0] + rng.normal(size=(1000, 16)) * 0.002
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in nearest.nearest(table, lambda v: v % 20 == 0).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = [0, 0]
    for q in range(0, 3000, 20):
        s = x @ x[q]
        best = [i for i in np.argsort(-s) if i != q][:20]
        assert len(found[q]) == 20 and all(abs(s[i] - v) < 1e-12 for i, v in found[q].items())  # in double precision
        hits[q >= 1000] += len(set(best) & set(found[q]))
    assert hits[0] >= 0.95 * 20 * 50 and hits[1] >= 0.9 * 20 * 100


def test_nearest_of_any_size(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e300, 0.0]), (2, [1e-300, 1.0]), (3, [-1e300, 5.0]), (20, [3.0, -1.0])]
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda v: v % 20 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (0, 4, 3), (20, 1, 1), (20, 2, 0), (20, 3, 2), (20, 4, 3)]


def test_pipeline(spark, tmp_path):
    """Each stage by the operator's own tests; here that they fit and what they decide takes effect."""
    good = [(i, t) for i, t in corpus(3, 40) if t and len(t) > 200][:25]
    secret = " token=abcdefghijklmnop"
    rows = [(i, t + secret if k == 0 else t) for k, (i, t) in enumerate(good)]
    bad = [(1000 + i, " ".join(w.upper() + "!!" for w in t.split())) for i, t in good]
    frame(spark, rows + bad, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1) for i, _ in rows] + [(i, 0) for i, _ in bad]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id: r.text for r in docs.collect()})
    assert not any(i >= 1000 for i in kept[0]) and len(kept[0]) >= 0.9 * len(rows)
    assert set(kept[1]) <= set(kept[0]) and not any(secret in t for t in kept[2].values())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept[3])


def test_registered():
    numbers = [int(q[2:].split("_")[0]) for q in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)
