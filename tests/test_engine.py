import math
import random

import pytest
from golden import run, top
from pyspark.sql import functions as F

from pairlift.config import Config, from_args, parse_seed, unit_ms
from pairlift.functions.scores import contingency, llr, register
from pairlift.operators import pairs, ranking, sampling, timing
from pairlift.sources import interactions as src
from pairlift.streaming.engine import Engine
from pairlift.streaming.native import windowed_counts

HAND = [(1, 10, 1000), (1, 11, 2000), (2, 10, 3000), (2, 12, 4000), (1, 12, 11000), (2, 10, 12000), (1, 13, 5000), (3, 11, 13000)]


def score(k11, k12, k21, k22):
    x = lambda *v: sum(v) * math.log(sum(v)) if sum(v) else 0.0
    e = x(k11, k12, k21, k22)
    r, c = e - x(k11, k12) - x(k21, k22), e - x(k11, k21) - x(k12, k22)
    m = e - x(k11) - x(k12) - x(k21) - x(k22)
    return 0.0 if r + c < m else 2 * (r + c - m)


def trace(seed, n=120, users=4, items=6, late=0.1):
    rng = random.Random(seed)
    t, out = 0, []
    for _ in range(n):
        t += rng.choice([0, 100, 400, 900])
        out.append((rng.randrange(users), rng.randrange(items), t - (rng.randrange(1, 3000) if rng.random() < late and t > 3000 else 0)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "user long, item long, ts_ms long, pos long")


def prepared(spark, rows, window):
    return timing.assign_windows(timing.on_time(frame(spark, rows)), window)


def ranked(df):
    return sorted((r.item, r["rank"], r.other, r.k11, r.score) for r in df.collect())


def test_llr_cases(spark):
    cases = [(110, 2442, 111, 29114, 270.72), (29, 13, 123, 31612, 263.90), (9, 12, 429, 31327, 48.94), (0, 0, 0, 0, 0.0), (1, 0, 0, 3, 4.4987), (1, 1, 1, 1, 0.0)]
    df = spark.createDataFrame(cases, "k11 long, k12 long, k21 long, k22 long, e double")
    register(spark)
    for r in df.select("e", llr(*[F.col(c) for c in df.columns[:4]]).alias("s"), F.expr("llr(k11, k12, k21, k22)").alias("q")).collect():
        assert abs(r.s - r.e) < 0.1 and abs(r.s - r.q) < 1e-6
    one = spark.range(1).select(*contingency(F.lit(1), F.lit(1), F.lit(1), F.lit(2)), *contingency(F.lit(1), F.lit(1), F.lit(1), F.lit(2), "textbook")).first()
    assert tuple(one) == (1, 0, 0, 3, 1, 0, 0, 1)


def test_hand_trace(spark):
    rows = prepared(spark, HAND, 10_000)
    deltas = pairs.pair_deltas(rows)
    got = {(r.w, r.item, r.other): r.delta for r in deltas.collect()}
    assert got == {
        (0, 10, 11): 1, (0, 11, 10): 1, (0, 10, 12): 1, (0, 12, 10): 1, (10_000, 10, 10): 2, (10_000, 10, 12): 2, (10_000, 12, 10): 2, (10_000, 11, 12): 1, (10_000, 12, 11): 1,
    }
    cells = ranking.window_cells(deltas, pairs.touched_rows(deltas))
    best = ranking.top_k(ranking.score_cells(cells, decimals=4), 10, ("w", "item")).where("w = 10000 and item = 10").orderBy("rank").collect()
    assert [(r.other, r.k11, r.k12, r.k21, r.k22, r.score) for r in best] == [(12, 3, 3, 1, 11, 3.8676), (10, 2, 4, 4, 6, 0.0716), (11, 1, 5, 1, 7, 0.0482)]
    assert ranking.latest(ranking.top_k(ranking.score_cells(cells), 10, ("w", "item"))).where("w = 0").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_plan_against_golden(spark, seed):
    rows = trace(seed)
    steps, _ = run(rows, 10_000, True)
    deltas = pairs.pair_deltas(prepared(spark, rows, 10_000)).cache()
    got = {}
    for r in deltas.collect():
        got.setdefault(r.w, {})[r.item, r.other] = r.delta
    assert got == {s["w"]: s["deltas"] for s in steps if s["deltas"]}
    cells = ranking.score_cells(ranking.window_cells(deltas, pairs.touched_rows(deltas)), decimals=4)
    best = ranking.top_k(cells, 3, ("w", "item")).cache()
    for s in steps:
        assert ranked(best.where(F.col("w") == s["w"])) == top(s, 3, score)
    deltas.unpersist()


@pytest.mark.parametrize(("cut", "most"), [(8, 2), (1000, 1), (20, 3)])
def test_sampled_plan_against_golden(spark, cut, most):
    rows = trace(cut)
    steps, _ = run(rows, 10_000, False, cut, most, 9, feedback=False)
    own = sampling.user_totals(sampling.item_cut(prepared(spark, rows, 10_000), cut))
    drawn = sampling.reservoir(own, most, 9).cache()
    stays = sampling.occupancy(drawn).cache()
    got = {}
    for r in sampling.sampled_deltas(stays).collect():
        got.setdefault(r.w, {})[r.item, r.other] = r.delta
    assert got == {s["w"]: s["deltas"] for s in steps if s["deltas"]}
    touched = {}
    for r in sampling.sampled_touched(drawn, stays).collect():
        touched.setdefault(r.w, set()).add(r.item)
    assert touched == {s["w"]: s["touched"] for s in steps if s["touched"]}


@pytest.mark.parametrize(("exact", "files"), [(True, 3), (False, 1)])
def test_stream_against_golden(spark, tmp_path, exact, files):
    rows = trace(5, n=60)
    steps, late = run(rows, 20_000, exact, 10, 2, 7)
    (tmp_path / "in").mkdir()
    for i in range(files):  # names oppose the order of times
        part = rows[len(rows) * i // files : len(rows) * (i + 1) // files]
        path = tmp_path / "in" / f"{9 - i}.txt"
        path.write_text("".join(f"{u},{x},{t},more\n" for u, x, t in part))
        import os

        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    engine = Engine(spark, Config("", 20_000, skip_cuts=exact, item_cut=10, user_cut=2, top_k=3, seed=7, score_decimals=4), f"file://{tmp_path}/engine")
    engine.stream(f"file://{tmp_path}/in").awaitTermination()
    engine.stream(f"file://{tmp_path}/in").awaitTermination()  # a restart finds nothing new
    engine.flush()
    best = engine.topk()
    for s in steps:
        assert ranked(best.where(F.col("w") == s["w"])) == top(s, 3, score)
    meta = engine.meta()
    assert meta["late"] == late and meta["n"] == steps[-1]["n"]


def test_replayed_batch_changes_nothing(spark, tmp_path):
    engine = Engine(spark, Config("", 10_000, skip_cuts=True), f"file://{tmp_path}/e")
    engine.add(frame(spark, HAND), 0)
    before = engine.meta()
    engine.add(frame(spark, HAND), 0)
    assert engine.meta() == before


def test_crash_before_publishing(spark, tmp_path, monkeypatch):
    """A batch that dies with its files written but not published is as if it had not begun, and can be run again."""
    config, rows = Config("", 10_000, skip_cuts=True, score_decimals=4), trace(4)
    whole, broken = (Engine(spark, config, f"file://{tmp_path}/{x}") for x in "ab")
    for e in (whole, broken):
        e.add(frame(spark, rows[:60]), 0)
    before, results = broken.meta(), ranked(broken.topk())

    class Dies:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == "rename":
                raise OSError("killed")
            return getattr(self.fs, name)

    keep = Engine._fs
    with monkeypatch.context() as m:
        m.setattr(Engine, "_fs", lambda self, name: (keep(self, name)[0], Dies(keep(self, name)[1])))
        with pytest.raises(OSError, match="killed"):
            broken.add(frame(spark, rows[60:]), 1)
    assert broken.meta() == before and ranked(broken.topk()) == results
    for e in (whole, broken):
        e.add(frame(spark, rows[60:]), 1)
        e.flush()
    assert broken.meta() == whole.meta() and ranked(broken.topk()) == ranked(whole.topk()) and broken.counters() == whole.counters()
    assert broken._names("work") == [] and len(broken._names("state")) == len(broken._names("meta")) == 1


def test_scores_rank_at_full_precision(spark):
    cells = spark.createDataFrame([(1, 2, 1, 3, 1, 100_000_000), (1, 3, 1, 3, 1, 100_000_001)], "item long, other long, k11 long, row_sum long, other_sum long, n long")
    best = ranking.top_k(ranking.score_cells(cells), 2).orderBy("rank").collect()
    assert [r.other for r in best] == [3, 2] and round(best[0].score, 4) == round(best[1].score, 4)


def test_users_in_blocks(spark):
    """A user with most of the rows is paired block by block."""
    rng = random.Random(6)
    rows = [(7 if rng.random() < 0.5 else rng.randrange(5), rng.randrange(90), 100 * i) for i in range(400)]
    own = prepared(spark, rows, 10_000)
    plain = pairs.pair_deltas(own)
    for block in (1, 13, 60):
        dealt = pairs.pair_deltas(own, block)
        assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))


def test_cells_as_they_stood(spark):
    """Touched windows without deltas, and deltas in windows that are not touched."""
    deltas = spark.createDataFrame([(0, 1, 2, 2), (0, 2, 1, 2), (20, 1, 2, 3), (20, 2, 1, 3), (20, 1, 3, 1), (20, 3, 1, 1), (30, 2, 3, 4), (30, 3, 2, 4)], "w long, item long, other long, delta long")
    touched = spark.createDataFrame([(0, 1), (10, 1), (30, 1), (40, 2), (40, 9)], "w long, item long")
    got = {(r.w, r.item, r.other): (r.k11, r.row_sum, r.other_sum, r.n) for r in ranking.window_cells(deltas, touched).collect()}
    assert got == {
        (0, 1, 2): (2, 2, 2, 4), (10, 1, 2): (2, 2, 2, 4), (30, 1, 2): (5, 6, 9, 20), (30, 1, 3): (1, 6, 5, 20), (40, 2, 1): (5, 9, 6, 20), (40, 2, 3): (4, 9, 5, 20),
    }


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    """Without a checkpoint folder on a local master; files in folders; no input at all."""
    from pyspark.sql import SparkSession

    from pairlift.__main__ import main

    monkeypatch.setattr(SparkSession.Builder, "getOrCreate", lambda self: spark)
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.txt").write_text("".join(f"{u},{x},{t}\n" for u, x, t in HAND))
    found = {}
    for name, args in (("all", ["--recursive"]), ("later", ["--recursive", "--modified-after", "2100-01-01T00:00:00"])):
        assert main(["-i", f"file://{tmp_path}/in", "-ws", "10", "-wu", "seconds", "-sc", *args]) == 0
        found[name] = dict(line.split("\t") for line in capsys.readouterr().out.splitlines())
    assert {k: found["all"][k] for k in ("SplitReaderNumSplits", "UserInteractionCounterLateElements", "RowSumProcessWindowRowSum", "ItemRowRescorerRescoredItems")} == {
        "SplitReaderNumSplits": "1", "UserInteractionCounterLateElements": "1", "RowSumProcessWindowRowSum": "12", "ItemRowRescorerRescoredItems": "6",
    }
    assert found["later"]["RowSumProcessWindowRowSum"] == "0"
    with pytest.warns(UserWarning, match="no input"):
        main(["-i", f"file://{tmp_path}/none", "-ws", "10"])
    with pytest.raises(ValueError, match="interval"):
        main(["-i", "x", "-ws", "10", "--interval", "0"])


def test_watermark_in_chunks_and_order(spark):
    rows = frame(spark, trace(3))
    plain = sorted(map(tuple, timing.running_watermark(rows).select("pos", "watermark").collect()))
    for levels in (0, 1, 3):
        assert plain == sorted(map(tuple, timing.running_watermark(rows, chunk=7, levels=levels).select("pos", "watermark").collect()))
    sparse = rows.withColumn("pos", F.col("pos") * 1_000_003 + 5)
    assert [w for _, w in plain] == [r.watermark for r in timing.running_watermark(sparse, chunk=100, levels=3).orderBy("pos").collect()]
    again = src.with_order(rows.withColumn("piece", F.floor(-F.col("pos") / 16)).withColumn("line", -F.col("pos")), ("piece",)).collect()
    back = {r.pos: (r.user, r.item, r.ts_ms) for r in again}
    assert [back[i] for i in range(120)] == trace(3)[::-1]


def test_lines(spark, tmp_path):
    lines = spark.createDataFrame([("1,2,3,x",), ("4,5,6",)], "value string")
    assert sorted(map(tuple, src.parse_lines(lines).collect())) == [(1, 2, 3), (4, 5, 6)]
    for bad in ("1,2", "1,b,3"):
        with pytest.raises(Exception, match="INVALID_ARRAY_INDEX|CAST_INVALID_INPUT"):
            src.parse_lines(spark.createDataFrame([(bad,)], "value string")).collect()
    with pytest.warns(UserWarning, match="no input"):
        assert src.from_files(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "a.txt").write_text("1,2,3\n4,5,6\n")
    assert [tuple(r) for r in src.from_files(spark, f"file://{tmp_path}/a.txt").orderBy("pos").collect()] == [(1, 2, 3, 0), (4, 5, 6, 1)]


def test_top_k_ties_and_native_counts(spark):
    cells = spark.createDataFrame([(1, o, float(s)) for o, s in [(5, 1), (4, 1), (3, 2), (2, 0)]], "item long, other long, score double")
    assert [r.other for r in ranking.top_k(cells, 3).orderBy("rank").collect()] == [3, 4, 5]
    with pytest.raises(ValueError):
        ranking.top_k(cells, 0)
    counts = windowed_counts(frame(spark, HAND).select("item", "ts_ms"), "10 seconds")
    assert {(r.w, r.item): r.n for r in counts.collect()}[0, 10] == 2


def test_config():
    c = from_args("-i in -ws 7 -wu days -s 0xff -k 3 -sc".split())
    assert (c.window_ms, c.seed, c.top_k, c.skip_cuts, c.item_cut) == (7 * 86_400_000, 255, 3, True, 500)
    assert "0xff" in c.describe() and parse_seed("-5") == -5
    for bad in (lambda: unit_ms("weeks"), lambda: Config("", 1, top_k=0), lambda: parse_seed("0x1ffffffffffffffff")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(SystemExit) as e:
        from_args(["-h"])
    assert e.value.code == 0
