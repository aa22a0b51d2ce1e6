"""Operators on documents against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from samples import frame

from pairlift.llm import fingerprints, jaccard, mixing, ngram_lm, packing, quality, secrets, substrings


def split(t):
    return (t or "").encode().split()


# 9


def expected_fingerprints(rows):
    out = {}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        e = fingerprints.edited(t, nxt)
        form = fingerprints.canonical
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), float(form(e) == form(t)), float(form(nxt) == form(t)), form(t), form(e))
    return out


@pytest.mark.parametrize("bits", [128, 4])
def test_fingerprints(docs, rows, bits):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs, bits).collect()}
    expected = expected_fingerprints(rows)
    by_form, by_print = {}, {}
    for i, (n, sha, near, after, form, edited) in expected.items():
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) == (n, sha, near, after)
        for f, p in ((form, r.fingerprint), (edited, r.edited_fingerprint)):  # equal if and only if the forms are
            assert by_form.setdefault(f, p) == p and by_print.setdefault(p, f) == f
    assert fingerprints.canonical("Ｆoo  BAR\n") == fingerprints.canonical("foo bar")


def test_fingerprints_in_many_ranges(spark, monkeypatch):
    """Ids that fill several ranges, null among them, are cut by a hash; each row still meets the next."""
    keep = fingerprints.in_order
    monkeypatch.setattr(fingerprints, "in_order", lambda docs: keep(docs, 50))
    rows = [(i, f"text {i}") for i in range(40)] + [(7, f"seven {i}") for i in range(60)] + [(None, f"none {i}") for i in range(50)] + [(99, "last")]
    table = frame(spark, rows)
    ordered = keep(table, 50)
    assert ordered.where("after = 0").groupBy("part").count().agg({"count": "max"}).first()[0] < 30
    by_id = table.select("doc_id", "text", __import__("pyspark").sql.functions.xxhash64("text").alias("h")).collect()
    order = [(r.doc_id, r.text) for r in sorted(by_id, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.h))]
    sha = lambda t, following: hashlib.sha256(fingerprints.edited(t, following).encode()).hexdigest()
    want = sorted(str((i, len(t), sha(t, order[(k + 1) % len(order)][1]))) for k, (i, t) in enumerate(order))
    assert sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in fingerprints.fingerprints(table).collect()) == want


def test_fingerprints_of_odd_tables(spark, empty):
    assert fingerprints.fingerprints(empty).count() == 0
    one = fingerprints.fingerprints(frame(spark, [(7, "abcd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    odd = fingerprints.fingerprints(frame(spark, [(1, "ab"), (1, "ab"), (None, "cd"), (None, None)])).collect()
    assert len(odd) == 4


# 2


def expected_components(rows, k=5):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {rows[i][0]: (len(sets[i]), rows[find(i)][0]) for i in range(len(rows))}


@pytest.mark.parametrize(("hot", "block"), [(50, 512), (2, 3)])
def test_similar(docs, rows, hot, block, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", hot)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(docs, block=block).collect()}
    assert got == expected_components(rows)


def test_similar_in_a_crowd(spark, monkeypatch):
    """A passage that all share, in groups that have to be compared block by block."""
    from samples import words

    monkeypatch.setattr(jaccard, "HOT", 4)
    rng = __import__("random").Random(12)
    passage = words(rng, 40)
    rows = []
    for i in range(120):
        own = words(rng, rng.choice([4, 8, 12, 60])) if i % 3 or not rows else rows[rng.randrange(len(rows))][40:]
        rows.append(passage + own + ([rng.choice(own)] if i % 3 == 0 else []))
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar(frame(spark, rows), block=7).collect()}
    assert got == expected_components(rows)


def test_segments_meet():
    """Any two sets of a similarity of 0.8 share a segment, whatever their size."""
    rng = np.random.default_rng(5)
    sets = []
    for n in [*range(4, 60), 100, 333, 1000]:
        for _ in range(4):
            union = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
            cut = rng.permutation(len(union))
            off = len(union) // 5
            one = rng.integers(0, off + 1)
            sets += [np.sort(np.delete(union, cut[:one])), np.sort(np.delete(union, cut[one:off]))]
    keys, owner, _ = jaccard.segments(sets)
    own = defaultdict(set)
    for k, o in zip(keys.tolist(), owner.tolist(), strict=True):
        own[o].add(k)
    for i in range(0, len(sets), 2):
        a, b = sets[i], sets[i + 1]
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both) and not np.array_equal(a, b):
            assert own[i] & own[i + 1]
        one, other = (np.frombuffer(jaccard.sketch(x), np.uint8) for x in (a, b))
        w = min(len(one), len(other))
        assert np.bitwise_count(jaccard.fold(one, w) ^ jaccard.fold(other, w)).sum() <= len(a) + len(b) - 2 * both


def test_representatives(docs, rows, spark, empty):
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in expected_components(rows).values()})
    assert jaccard.similar(empty).count() == 0 and jaccard.representatives(empty).count() == 0
    text = " ".join(map(str, range(30)))
    again = frame(spark, [(1, text), (1, text), (2, text), (1, "other words than those"), (None, None)])
    assert sorted(r.text or "" for r in jaccard.representatives(again).collect()) == sorted(["", text, "other words than those"])


# 5


def expected_removal(rows, k=50):
    first = {}
    for i, t in rows:
        w = split(t)
        for p in range(len(w) - k + 1):
            first.setdefault(b" ".join(w[p : p + k]), i)
    out = {}
    for i, t in rows:
        w = split(t)
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - k + 1):
            if first[b" ".join(w[p : p + k])] < i:
                gone[p : p + k] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("k", "hot", "held"), [(50, 10_000, 200_000), (8, 2, 5)])
def test_substrings(docs, rows, k, hot, held, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "HELD", held)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduplicate(docs, k, min(k, 20) // 2).collect()}
    assert got == expected_removal(rows, k)


def test_substrings_of_odd_tables(spark, empty):
    assert substrings.deduplicate(empty).count() == 0
    text = " ".join(map(str, range(60)))
    again = substrings.deduplicate(frame(spark, [(1, text), (1, text), (2, text), (1, text + " x"), (None, text)]))
    assert sorted((r.doc_id or 9, r.n_removed) for r in again.collect()) == [(1, 0), (1, 0), (1, 0), (2, 60), (9, 60)]
    big = [(1 << 44, text), ((1 << 44) + 1, text), ((1 << 63) - 1, text), (None, text), (-5, text + " y")]
    for more in ([], [(3, "other"), (3, "words")]):  # unique and repeated ids
        got = substrings.deduplicate(frame(spark, big + more)).collect()
        assert {r.doc_id: r.n_removed for r in got} == {-5: 0, 1 << 44: 60, (1 << 44) + 1: 60, (1 << 63) - 1: 60, None: 60, **{i: 0 for i, _ in more}}


@pytest.mark.parametrize("repeated", [False, True])
def test_hot_substrings(spark, monkeypatch, repeated):
    """A passage of a big group, with the edges dealt out and their runs taken up in parts, and a word that goes on and on."""
    monkeypatch.setattr(substrings, "HOT", 2)
    monkeypatch.setattr(substrings, "HELD", 5)
    from samples import words

    rng = __import__("random").Random(8)
    passage = words(rng, 60)
    rows = [(i, " ".join(words(rng, i % 9) + passage[i % 4 : 60 - i % 3] + words(rng, i % 5))) for i in range(80)]
    rows += [(90 + i, "again " * (70 + 5 * i)) for i in range(4)]
    rows += [(100 + i, " ".join([*passage[i:], "x", *passage[i:], f"y{i % 2}", *passage[i:]])) for i in range(5)]
    expected = expected_removal(rows)
    more = [(200, "twice"), (200, "over")] if repeated else []
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.deduplicate(frame(spark, rows + more)).collect() if r.doc_id != 200}
    assert got == expected


# 6


def test_base_findings():
    t = 'x password = "abcdefghijkl" Token:short AKIAABCDEFGHIJKLMN AKIASHORT 0123456789abcdef 0123456789abcde'
    found = [(s.kind, t[s.start : s.end]) for s in secrets.matches(t)]
    assert found == [("assign", 'password = "abcdefghijkl'), ("access", "AKIAABCDEFGHIJKLMN"), ("hex", "0123456789abcdef")]


def test_layers():
    import base64
    import gzip
    import urllib.parse

    inner = "the api_key=ABCDEFGHIJKLMNOP is here"
    once = base64.b64encode(inner.encode()).decode()
    packed = base64.b64encode(gzip.compress(inner.encode())).decode()
    for code in (once, packed, base64.b64encode(once.encode()).decode(), urllib.parse.quote(once, safe=""), "".join(f"\\u{ord(c):04x}" for c in inner)):
        t = f"café {code} end"
        base, spans = secrets.scan(t)
        extra = [s for s in spans if s not in base and s.kind == "assign"]
        assert extra and all(5 <= s.start < s.end <= 5 + len(code) for s in extra)
    t = "secret%3Dabcdefghijklmnop"
    assert [(s.start, s.end) for s in secrets.scan(t)[1]] == [(0, len(t))]
    plain = "Nothing but words of some length: unbelievablylongwordswithoutanend and 100% sure \\ fine &amp; dandy."
    assert secrets.scan(plain) == ([], [])


def test_wrapped_and_prefixed_base64():
    import base64
    import gzip

    inner = "Some caf\u00e9 words that go before it, and more of them: api_key=ABCDEFGHIJKLMNOP, then the r\u00e9st."
    noise = "".join(chr(33 + i * i * 31 % 90) for i in range(400))
    lines = lambda b, n: "\n".join(base64.b64encode(b).decode()[i : i + n] for i in range(0, 9999, n)).strip()
    codes = [lines(inner.encode(), 64), lines(inner.encode(), 76).replace("\n", "\r\n"), lines(gzip.compress((noise + inner).encode()), 64)]
    once = base64.b64encode(inner.encode()).decode()
    packed = base64.b64encode(gzip.compress(inner.encode())).decode()
    codes += [f"{x}{c}" for x in (".com/cb/", "data_", "x-", "ab/") for c in (once, packed)]
    for code in codes:
        spans = [s for s in secrets.scan(f"see {code}\nThe end")[1] if s.kind == "assign"]
        assert spans and all(4 <= s.start < s.end <= 8 + len(code) for s in spans), code


@pytest.mark.parametrize("at", [0, 3990, 9000])
def test_long_streams(at):
    import base64
    import bz2
    import gzip

    import zstandard

    text = b"lorem ipsum " * 1000
    text = text[:at] + b" api_key=ABCDEFGHIJKLMNOP " + text[at:]
    for data in (gzip.compress(text), zlib.compress(text), bz2.compress(text), zstandard.ZstdCompressor().compress(text), gzip.compress(gzip.compress(text))):
        code = base64.b64encode(data).decode()
        assert secrets.Span("assign", 2, 2 + len(code.rstrip("="))) in secrets.scan(f"a {code} b", 4000)[1]


def test_layers_that_are_unsound_in_part():
    import base64
    import gzip

    code = "%FF" + "".join(f"%{ord(c):02x}" for c in "secret=abcdefghijklmnop") + "%C3"
    assert [(s.kind, s.start, s.end) for s in secrets.scan(code)[1]] == [("assign", 3, len(code) - 3)]
    code = "\\xff" + "".join(f"\\x{ord(c):02x}" for c in "secret=abcdefghijklmnop")
    assert [(s.start, s.end) for s in secrets.scan(code)[1]] == [(4, len(code))]
    binary = bytes(range(128, 256)) * 20 + b" api_key=ABCDEFGHIJKLMNOP " + bytes(range(32)) * 20
    code = base64.b64encode(gzip.compress(binary)).decode()
    assert [s.kind for s in secrets.scan(code)[1] if s.kind == "assign"] == ["assign"]


def test_secret_spans_of_a_table(spark, docs):
    """Every row's base findings against a plain scan, and each further span against the layer it stands for."""
    import base64

    rows = [(i, f"{t} token=abcdefghijkl{i}x {base64.b64encode(f'password: abcdefghijkl{i} and more text'.encode()).decode()}") for i, t in enumerate(["", "AKIA" + "Q" * 16, "0123456789abcdef0", "caf\u00e9 \U0001f600"])]
    for r in secrets.find_secrets(frame(spark, rows)).collect():
        t = rows[r.doc_id][1]
        base = [("assign", *m.span()) for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 12] + [("access", *m.span()) for m in __import__("re").finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        base += [("hex", *m.span()) for m in __import__("re").finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        assert [tuple(s) for s in r.base] == sorted(base, key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        more = [s for s in r.spans if tuple(s) not in base]
        at = t.rindex(" ") + 1
        assert len(more) == 1 and at <= more[0].start < more[0].end <= len(t)
        assert base64.b64decode(t[at:]).decode()[: 12] == "password: ab"


def test_secret_tables(spark, docs, empty):
    assert secrets.find_secrets(empty).count() == 0
    assert secrets.redact(docs).exceptAll(docs).count() == 0
    rows = [(1, "a token=abcdefghijklmnop b"), (1, "a token=abcdefghijklmnop b"), (2, None), (3, "")]
    got = secrets.redact(frame(spark, rows)).select("doc_id", "text", "n_chars").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "a [secret] b", 12), (1, "a [secret] b", 12), (2, None, None), (3, "", 0)]


# 1


def test_mixing(spark, docs, empty):
    import duckdb

    from pairlift.llm.mixing import OP1_SQL

    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60, 3)], "doc_id long, quality int")
    sized = mixing.with_quality(mixing.sized(docs), labels)
    got = {r.doc_id: r for r in mixing.mix(sized, bucket_rows=5).collect()}
    c = duckdb.connect()
    c.register("documents", docs.select("doc_id", "text", "source").toPandas())
    c.register("labels", labels.toPandas())
    cur = c.execute(OP1_SQL)
    names = [d[0] for d in cur.description]
    total, near = 0, defaultdict(int)
    for row in cur.fetchall():
        row = dict(zip(names, row, strict=True))
        r = got[row["doc_id"]]
        assert (r.size, r.source_size, r.taken) == (row["size"], row["source_size"], row["taken"]) and math.isclose(r.target, row["target"])
        assert r.taken <= 3 * r.size
        total += r.size
        near[r.source] += r.taken
    goals = {r.source: r.target for r in got.values()}
    assert math.isclose(sum(goals.values()), total)
    for s, goal in goals.items():  # whole documents only: no nearer than half of one
        assert abs(near[s] - goal) < 0.05 * goal + max(r.size for r in got.values() if r.source == s) / 2
    whole = mixing.mixture(docs, labels)
    assert whole.columns == docs.columns
    copies = Counter(r.doc_id for r in whole.collect())
    assert all(copies[i] * r.size == r.taken for i, r in got.items())
    assert mixing.mix(mixing.with_quality(mixing.sized(empty), labels)).count() == 0
    twice = mixing.mixture(docs.union(docs), labels)
    assert twice.count() > 0


# 8


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    tok = Tokenizer.from_file(path)
    got = packing.pack(docs, path, capacity=64).toPandas()
    expected = {}
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for p, a in enumerate(range(0, len(ids), 64)):
            part = ids[a : a + 64]
            expected[i, p] = (a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == expected
    check_places(got, 64)
    assert packing.pack(empty, path).count() == 0
    check_places(packing.pack(docs.union(docs), path, 64).toPandas(), 64)


def check_places(got, capacity):
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        ends = (g["offset"] + g["length"]).tolist()
        assert g["offset"].tolist() == [0, *ends[:-1]] and ends[-1] <= capacity
    assert got.sequence_id.nunique() <= 1.05 * math.ceil(got["length"].sum() / capacity) + 1


def test_encoder_is_the_tokenizers():
    own = packing.WordEncoder(packing.default_vocabulary())
    texts = ["It's 12.5% of <|endoftext|> été, İstanbul!!! 'll", "a'b.'s   x y 中文 \x1c odd", "THE the The, the.", "", "don't... (well)"]
    for t, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert ids == own.whole(t)


def test_plan_places_all():
    rng = np.random.default_rng(2)
    counts = Counter(rng.integers(1, 65, 500).tolist())
    patterns = packing.plan(counts, 64)
    used = Counter()
    for pattern, times in patterns:
        assert sum(pattern) <= 64
        for x in pattern:
            used[x] += times
    assert used == counts


# 4


def counted(rows):
    """Tokens of each text, counts of tokens and of pairs; None stands for the start of a text."""
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t in rows}
    one = Counter(w for t in tokens.values() for w in t)
    two = Counter(p for t in tokens.values() for p in zip([None, *t], t))  # noqa: B905
    return tokens, one, two


@pytest.mark.parametrize("most", [1 << 30, 0])
def test_lm(docs, rows, empty, most):
    """Against plain counts, with the model broadcast and in shards."""
    tokens, one, two = counted(rows)
    n, v = sum(one.values()), len(one)
    model, shards = ngram_lm.fit(docs, most)
    assert (model.total, model.kinds, model.words is None) == (n, v, most == 0) and min(two.values()) == 1
    low = lambda c: int(ngram_lm.COUNT_OF[ngram_lm.level(np.array(c))])
    unigram = lambda w: (one[w] + 0.1) / (n + 0.1 * (v + 1))

    def p(u, w):
        before = len(tokens) if u is None else one[u]
        share, j = ngram_lm.PRIOR / (before + ngram_lm.PRIOR), int(ngram_lm.level(np.array(two[u, w])))
        most_of = ngram_lm.EXCESS / 2**j / model.rate**j * unigram(w)
        return (1 - share) * min(low(two[u, w]) / before, most_of) / (1 + ngram_lm.EXCESS + 2 * model.rate) + share * unigram(w)

    exact = []
    for r in ngram_lm.score(docs, model, shards).collect():
        own = tokens[r.doc_id]
        assert r.n_tokens == r.n_known == len(own) and math.isclose(r.base_score, sum(math.log10(unigram(w)) for w in own), rel_tol=1e-9)
        expected = sum(math.log10(p(u, w)) for u, w in zip([None, *own], own))  # noqa: B905
        exact.append(math.isclose(r.score, expected, rel_tol=1e-9))
        assert math.isclose(r.score, expected, rel_tol=0.02)  # a level too high, by a false positive
    assert np.mean(exact) > 0.8
    none, shards = ngram_lm.fit(empty, most)
    assert ngram_lm.score(empty, none, shards).count() == 0
    unseen = ngram_lm.score(docs, none, shards).where("doc_id = 0").first()
    assert unseen.n_known == 0 and unseen.base_score == 0.0 and unseen.score == 0.0


def test_lm_sums_to_one_at_most():
    """Over the vocabulary and the unseen token, after frequent, middling and rare words and after the start."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{x}" for x in np.minimum(rng.zipf(1.2, 60), 5000)).encode() for _ in range(3000)]
    h, base = ngram_lm.tokens(texts)
    words = ngram_lm.Words(*np.unique(np.append(h, np.full(len(texts), ngram_lm.START)), return_counts=True))
    bits = ngram_lm.build(*np.unique(ngram_lm.pairs(h, base), return_counts=True))
    f = ngram_lm.Filter(np.array([len(bits)]), np.array([0]), np.packbits(bits, bitorder="little"))
    m = ngram_lm.Model(len(h), len(words.h) - 1, bits.mean() ** ngram_lm.PROBES, words, f)
    own = words.h != ngram_lm.START
    kinds, c = words.h[own], words.n[own]
    by_count = np.argsort(-words.n)
    for u in [u for u in [*by_count[:20], *by_count[200:220], *by_count[-20:]] if words.h[u] != ngram_lm.END]:  # nothing follows the end
        two = np.stack([np.full(len(kinds), words.h[u]), kinds], 1).ravel()
        lev = f.levels(ngram_lm.pairs(two, np.array([0, len(two)]))[1::2])
        total = m.probability(lev, c, np.full(len(c), words.n[u])).sum() + m.unigram(np.zeros(1))[0]
        assert 0.5 < total < 1.02


def test_filter_counts():
    h = np.arange(1, 20_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    n = np.arange(20_000) % 50 + 1
    bits = ngram_lm.build(h, n)
    f = ngram_lm.Filter(np.array([len(bits)]), np.array([0]), np.packbits(bits, bitorder="little"))
    lev = f.levels(h)
    assert (lev >= ngram_lm.level(n)).all() and (lev == ngram_lm.level(n)).mean() > 0.98  # never less than was put in
    assert (f.levels(h + np.uint64(1)) > 0).mean() < 0.02
    assert (ngram_lm.COUNT_OF[ngram_lm.level(n)] <= n).all()


# 7


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["the", "cat", "sat", "on", "a", "mat."], 150)) for _ in range(60)]
    bad = [t[:300] + " ".join(w.upper() + "!!" for w in t[300:].split()) for t in good]
    data = [(i, t) for i, t in enumerate(good + bad)]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(None, 1), (5, None)], "doc_id long, quality int")
    table = frame(spark, [*data, (500, None), (501, ""), (502, " \n "), (503, "word " * 50_000)])
    model = quality.fit(table, labels)
    got = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    held = [i for i in range(120) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i] >= 0.7) == (i < 60) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[500] == got[501]
    kept = quality.keep_good(table, model)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.7}
    assert quality.score(empty, model).count() == 0
    assert quality.fit(table, labels.where("quality = 1")) == 1.0 and quality.fit(empty, labels) == 0.5
    texts = [t.encode() for t in (good[0], "", bad[0])]
    for beside in ([], texts, [b"other words"] * 7, [b"a" * 70_000, *texts, b"b c " * 400_000], texts * 50):  # a text's score does not depend on its neighbours
        found = quality.score_texts([*beside, *texts, *beside], model)[len(beside) :]
        assert found[: len(texts)].tolist() == [got[0], got[500], got[60]]


def test_long_texts_in_pieces(docs, rows):
    """A long text that is taken up in pieces has the features it has as a whole."""
    rng = np.random.default_rng(3)
    parts = ["the ", "a", "B", " ", "\n", "\u00e9", "1", " x, ", "***", "\t"]
    texts = [(t or "").encode() for _, t in rows] + ["".join(rng.choice(parts, n)).encode() for n in (1, 2, 5, 100, 5000, 9000)] + [b"x" * 5000]
    for t in texts:
        whole, base = quality.encode([t])
        for step in (7, 1000, 1 << 20):
            assert np.array_equal(quality.encode_long(t, step), whole)
    assert np.array_equal(quality.features([texts[-2] * 200])[0], quality.encode([texts[-2] * 200])[0])


def test_quality_forward_and_gradient():
    """The pooled score against plain loops; training lowers the loss."""
    rng = np.random.default_rng(1)
    x, base = rng.normal(size=(40, quality.FEATURES)), np.array([0, 3, 4, 20, 40])
    y = np.array([0, 1, 0, 1])
    m = quality.train(x + 0.5 * np.repeat(y, np.diff(base))[:, None], base, y, epochs=30)
    got = m.score(x, base)
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    p = [np.asarray(a, float) for a in m]
    for i in range(4):
        h = np.tanh((x[base[i] : base[i + 1]] - p[0]) / p[1] @ p[2] + p[3])
        e = np.array([(np.tanh(v @ p[4]) * sigmoid(v @ p[5])) @ p[6] for v in h])
        w = np.exp(e) / np.exp(e).sum()
        assert math.isclose(got[i], sigmoid((w[:, None] * h).sum(0) @ p[7] + p[8][0]), rel_tol=1e-5)
    assert (m.score(x + 0.5 * np.repeat(y, np.diff(base))[:, None], base) > 0.5).astype(int).tolist() == y.tolist()


def test_an_encoder_holds_the_words_of_little_text_at_a_time():
    import tracemalloc

    own = packing.WordEncoder(packing.default_vocabulary())
    text = b"one of the few " * 10_000
    tracemalloc.start()
    try:
        n = sum(len(ids) for ids in own.encode([text] * 40))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 40 * 4 * 40_000
    assert peak < 60 << 20


def test_packing_reads_few_texts_at_a_time(spark, tmp_path, monkeypatch):
    spark.range(2000).selectExpr("id AS doc_id", "repeat('a few words ', 20) AS text").coalesce(1).write.parquet(str(tmp_path / "docs"))
    name, batches, write = "spark.sql.parquet.columnarReaderBatchSize", [], packing.stash
    before = spark.conf.get(name)

    def counted(df, label):
        run = df._jdf.queryExecution()
        assert run.toRdd().count() == 2000
        node = run.executedPlan()
        while node.nodeName() != "ColumnarToRow":
            node = node.children().apply(0)
        batches.append(node.metrics().apply("numInputBatches").value())
        return write(df, label)

    monkeypatch.setattr(packing, "stash", counted)
    got = packing.pack(spark.read.parquet(str(tmp_path / "docs")), packing.default_vocabulary())
    assert spark.conf.get(name) == before
    assert got.count() == 2000
    assert batches[0] >= 2000 / 64


def test_a_shard_answers_groups_together(monkeypatch):
    """What a shard is asked by many groups takes a look-up, not one for each group."""
    rng = np.random.default_rng(5)
    kinds = np.sort(rng.integers(1, 1 << 40, 200).astype(np.uint64))
    filters = [ngram_lm.build(kinds[k::2], np.arange(1, 101)) for k in (0, 1)]
    own = [ngram_lm.Filter(np.array([len(f)]), np.array([0]), np.packbits(f, bitorder="little")) for f in filters]
    words = [ngram_lm.Words(kinds[k::2], np.arange(1, 101)) for k in (0, 1)]
    rows = []
    for k in (0, 1):
        rows.append((k, None, len(filters[k]), words[k].h.tobytes() + words[k].n.tobytes(), own[k].data.tobytes()))
        rows += [(k, g, None, rng.choice(kinds, g % 7).tobytes(), rng.choice(kinds, g % 5).tobytes()) for g in range(150)]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    # the second batch begins in the middle of the first shard's groups
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=list("abcde")) for part in (rows[:80], rows[80:])]
    expected = [(g, k, words[k].count(np.frombuffer(x, np.uint64)).tobytes(), own[k].levels(np.frombuffer(y, np.uint64)).tobytes()) for k, g, _, x, y in rows if g is not None]
    calls, levels = [], ngram_lm.Filter.levels
    monkeypatch.setattr(ngram_lm.Filter, "levels", lambda self, h: calls.append(len(h)) or levels(self, h))
    got = [tuple(r.values()) for b in ngram_lm._look(iter(batches)) for r in b.to_pylist()]
    assert got == expected
    assert len(calls) == 3
