"""Small corpora for the tests."""

import random

WORDS = [a + b for a in "ba de fi go hu ka lo mi nu po ra se ti vu wa".split() for b in "la ne ri so tu xe".split()]


def words(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def corpus(seed=1, n=60):
    """Texts with exact and near copies, shared passages, and the odd ones: null, empty, blank, one word, very long."""
    rng = random.Random(seed)
    passage = words(rng, 70)
    rows = []
    for i in range(n):
        w = words(rng, rng.choice([3, 5, 20, 80, 150]))
        if i % 7 == 3 and rows:
            w = rng.choice(rows)[:]
        elif i % 7 == 5 and rows:
            w = rng.choice(rows)[:]
            for _ in range(1 + len(w) // 40):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
        elif i % 7 == 6:
            w = words(rng, 20) + passage + words(rng, 10)
        rows.append(w or ["x"])
    texts = [rng.choice([" ", "  ", "\n"]).join(w) for w in rows]
    texts += [None, "", " \n\t ", "word", "WORD", "café   naïve", " ".join(words(rng, 3000)), texts[0], texts[0].upper()]
    return list(enumerate(texts))


#: Columns that operators might use themselves.
EXTRA = ["key", "part", "size", "row", "id", "class", "h", "block", "copies", "nth", "bucket", "quality", "score"]


def frame(spark, rows, extra=True):
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(i, t, None, None if i is not None and i % 5 == 4 else f"s{(i or 0) % 5}", len(t) if t is not None else None) for i, t in rows]
    df = spark.createDataFrame(data, schema)
    return df.withColumns({c: F.lit("clash") for c in EXTRA}) if extra else df
