"""The queries, each with DuckDB SQL of the same columns where SQL can express it.

Sources: E events (user, item in props.k), B baskets (order, part), P customer and part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlift.config import Config
from pairlift.functions.scores import llr
from pairlift.operators import metrics, pairs, partners, ranking, sampling, timing
from pairlift.plans.scratch import new_folder
from pairlift.sources import interactions as src
from pairlift.streaming.engine import Engine

DAY = 86_400_000
W = 7 * DAY
K = 10
FMAX, KMAX, SEED = 300, 20, 42
#: The queries rank by scores with so many decimals, as their SQL does: two engines' logarithms differ in the last bits.
DECIMALS = 4

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# inputs


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.assign_windows(src.from_events(spark, sf_dir), W)


def shuffled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with every ten arrivals reversed, so that some are late."""
    e = src.from_events(spark, sf_dir)
    return e.withColumn("pos", F.col("pos") - F.pmod("pos", F.lit(10)) + 9 - F.pmod("pos", F.lit(10)))


def drawn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.reservoir(sampling.user_totals(sampling.item_cut(events(spark, sf_dir), FMAX)), KMAX, SEED)


E = f"""WITH e AS (
  SELECT user_id AS usr, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, epoch_us(ts) // 1000 AS ts_ms, event_id AS pos,
    epoch_us(ts) // 1000 - epoch_us(ts) // 1000 % {W} AS w FROM events)"""
LATE = """WITH e AS (
  SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, event_id - event_id % 10 + 9 - event_id % 10 AS pos FROM events),
m AS (SELECT *, max(ts_ms) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS watermark FROM e)"""
#: Ordered pairs of a user's slots; the window is the later one's.
PAIRS = """, d AS (
  SELECT greatest(a.w, b.w) AS w, a.item AS item, b.item AS other, CAST(count(*) AS BIGINT) AS delta
  FROM e a JOIN e b ON a.usr = b.usr AND a.pos <> b.pos GROUP BY ALL)"""
B = "WITH e AS (SELECT l_orderkey AS usr, l_partkey AS item, row_number() OVER () AS pos, 0 AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
P = "WITH e AS (SELECT o_custkey AS usr, l_partkey AS item, row_number() OVER () AS pos, 0 AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _llr_sql(k11: str, k12: str, k21: str, k22: str) -> str:
    x = lambda *k: f"(CASE WHEN ({' + '.join(k)}) = 0 THEN 0.0::DOUBLE ELSE ({' + '.join(k)})::DOUBLE * ln(({' + '.join(k)})::DOUBLE) END)"
    every = x(k11, k12, k21, k22)
    rows, cols = f"({every} - {x(k11, k12)} - {x(k21, k22)})", f"({every} - {x(k11, k21)} - {x(k12, k22)})"
    matrix = f"({every} - {x(k11)} - {x(k12)} - {x(k21)} - {x(k22)})"
    return f"CASE WHEN {rows} + {cols} < {matrix} THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * ({rows} + {cols} - {matrix}) END"


CELLS = """, c AS (SELECT item, other, CAST(sum(delta) AS BIGINT) AS k11 FROM d GROUP BY ALL),
r AS (SELECT item, CAST(sum(k11) AS BIGINT) AS row_sum FROM c GROUP BY ALL),
t AS (SELECT CAST(sum(row_sum) AS BIGINT) AS n FROM r),
k AS (SELECT c.item, c.other, c.k11, r.row_sum - c.k11 AS k12, o.row_sum - c.k11 AS k21,
  t.n + c.k11 - (r.row_sum - c.k11) - (o.row_sum - c.k11) AS k22
  FROM c JOIN r ON c.item = r.item JOIN r o ON c.other = o.item, t)"""
SCORES = f""", s AS (SELECT *, round({_llr_sql('k11', 'k12', 'k21', 'k22')}, 4) AS score FROM k)"""
RANKED = f""", g AS (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, other) AS INTEGER) AS rank FROM s QUALIFY rank <= {K})"""
#: Per window: touched rows, their cells and sums as of the window.
TOUCHED = ", tw AS (SELECT DISTINCT w, item FROM d)"
STATE = f""", c AS (SELECT tw.w, d.item, d.other, CAST(sum(d.delta) AS BIGINT) AS k11 FROM tw JOIN d ON d.item = tw.item AND d.w <= tw.w GROUP BY ALL),
ws AS (SELECT DISTINCT w FROM d),
r AS (SELECT ws.w, d.item, CAST(sum(d.delta) AS BIGINT) AS row_sum FROM ws JOIN d ON d.w <= ws.w GROUP BY ALL),
t AS (SELECT ws.w, CAST(sum(d.delta) AS BIGINT) AS n FROM ws JOIN d ON d.w <= ws.w GROUP BY ALL),
k AS (SELECT c.w, c.item, c.other, c.k11, r.row_sum - c.k11 AS k12, o.row_sum - c.k11 AS k21,
  t.n + c.k11 - (r.row_sum - c.k11) - (o.row_sum - c.k11) AS k22
  FROM c JOIN r ON c.item = r.item AND c.w = r.w JOIN r o ON c.other = o.item AND c.w = o.w JOIN t ON t.w = c.w),
s AS (SELECT *, round({_llr_sql('k11', 'k12', 'k21', 'k22')}, 4) AS score FROM k),
g AS (SELECT *, CAST(row_number() OVER (PARTITION BY w, item ORDER BY score DESC, other) AS INTEGER) AS rank FROM s QUALIFY rank <= {K})"""
CUT = f""", f AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY w, pos) <= {FMAX} AS sampled,
  row_number() OVER (PARTITION BY usr ORDER BY w, pos) AS total FROM e)"""
DRAWN = f""", h AS (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY w, pos) AS nth FROM f WHERE sampled),
dr AS (SELECT *, CASE WHEN nth <= {KMAX} THEN nth - 1
  ELSE CAST(('0x' || substr(md5('{SEED}:' || usr || ':' || total), 1, 8)) AS BIGINT) % total END AS slot FROM h),
ac AS (SELECT * FROM dr WHERE slot < {KMAX}),
st AS (SELECT usr, slot, item, total AS t_in, w AS w_in, lead(total) OVER o AS t_out, lead(w) OVER o AS w_out FROM ac WINDOW o AS (PARTITION BY usr, slot ORDER BY total)),
pr AS (SELECT a.item AS item, b.item AS other, greatest(a.w_in, b.w_in) AS w_in,
    CASE WHEN a.t_out IS NULL THEN b.w_out WHEN b.t_out IS NULL OR a.t_out < b.t_out THEN a.w_out ELSE b.w_out END AS w_out
  FROM st a JOIN st b ON a.usr = b.usr AND a.slot <> b.slot AND a.t_in < coalesce(b.t_out, 9e18) AND b.t_in < coalesce(a.t_out, 9e18)),
d AS (SELECT w, item, other, CAST(sum(x) AS BIGINT) AS delta FROM (
  SELECT w_in AS w, item, other, 1 AS x FROM pr UNION ALL SELECT w_out, item, other, -1 FROM pr WHERE w_out IS NOT NULL) GROUP BY ALL)"""
SAMPLED_TOUCHED = """, av AS (SELECT usr, w FROM ac GROUP BY ALL HAVING count(*) > 1 OR min(nth) > 1),
tw AS (SELECT DISTINCT w, item FROM (
  SELECT ac.w, ac.item FROM ac JOIN av ON ac.usr = av.usr AND ac.w = av.w
  UNION ALL SELECT av.w, st.item FROM av JOIN st ON st.usr = av.usr AND st.w_in < av.w AND coalesce(st.w_out, 9e18) >= av.w))"""


# sources, parsing and windows


@query("SELECT user_id AS \"user\", CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, epoch_us(ts) // 1000 AS ts_ms FROM events")
def parse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(",", "user", "item", "ts_ms", F.lit("ignored")).alias("value")
    return src.parse_lines(src.from_events(spark, sf_dir).select(line))


@query('SELECT o_custkey AS "user", l_partkey AS item, epoch_us(o_orderdate) // 1000 AS ts_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey')
def scan_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.from_customers(spark, sf_dir)


@query(E + ' SELECT usr AS "user", item, ts_ms, pos, w FROM e')
def window_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("user", "item", "ts_ms", "pos", "w")


@query(LATE + " SELECT pos, ts_ms, coalesce(watermark, -1) AS watermark FROM m")
def running_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = timing.running_watermark(shuffled_events(spark, sf_dir))
    return found.select("pos", "ts_ms", F.coalesce("watermark", F.lit(-1)).alias("watermark"))


@query(LATE + " SELECT pos, ts_ms FROM m WHERE watermark IS NULL OR ts_ms > watermark")
def late_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.on_time(shuffled_events(spark, sf_dir)).select("pos", "ts_ms")


@query(LATE + " SELECT CAST(count(*) FILTER (ts_ms <= watermark) AS BIGINT) AS late, CAST(count(*) AS BIGINT) AS arrived FROM m")
def late_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timing.mark_late(timing.running_watermark(shuffled_events(spark, sf_dir)))
    return rows.agg(F.count_if("late").alias("late"), F.count("*").alias("arrived"))


# counters and histories


@query(E + " SELECT usr AS \"user\", w, CAST(sum(count(*)) OVER (PARTITION BY usr ORDER BY w) AS BIGINT) AS total FROM e GROUP BY usr, w")
def user_totals_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.user_totals(events(spark, sf_dir)).groupBy("user", "w").agg(F.max("total").alias("total"))


@query(E + " SELECT item, w, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY ALL")
def item_counts_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy("item", "w").agg(F.count("*").alias("n"))


@query(E + CUT + " SELECT pos, item, sampled FROM f")
def item_cut_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.item_cut(events(spark, sf_dir), FMAX).select("pos", "item", "sampled")


@query(E + f" SELECT w, item, CAST(least({FMAX}, sum(count(*)) OVER (PARTITION BY item ORDER BY w)) AS BIGINT) AS n FROM e GROUP BY item, w")
def item_counter_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.item_counters(events(spark, sf_dir), FMAX).select("w", "item", F.col("n").cast("long").alias("n"))


@query(E + " SELECT usr AS \"user\", string_agg(CAST(item AS VARCHAR), ',' ORDER BY w, pos) AS history FROM e GROUP BY usr")
def user_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("w", "pos", "item")))
    return events(spark, sf_dir).groupBy("user").agg(F.array_join(F.transform(listed, lambda x: x.item.cast("string")), ",").alias("history"))


# exact mode


@query(E + PAIRS + " SELECT w, item, other, delta FROM d")
def pair_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_deltas(events(spark, sf_dir))


@query(B + PAIRS + " SELECT item, other, delta AS k11 FROM d")
def basket_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_totals(src.from_baskets(spark, sf_dir))


@query(E + PAIRS + " SELECT w, item, CAST(sum(delta) AS BIGINT) AS delta FROM d GROUP BY ALL HAVING sum(delta) <> 0")
def row_sum_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.row_sum_deltas(pairs.pair_deltas(events(spark, sf_dir)))


@query(E + PAIRS + " SELECT w, item, CAST(sum(sum(delta)) OVER (PARTITION BY item ORDER BY w) AS BIGINT) AS row_sum FROM d GROUP BY w, item")
def row_sum_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.row_sum_state(pairs.pair_deltas(events(spark, sf_dir)))


@query(E + PAIRS + " SELECT w, CAST(sum(sum(delta)) OVER (ORDER BY w) AS BIGINT) AS n FROM d GROUP BY w")
def total_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.total_state(pairs.pair_deltas(events(spark, sf_dir)))


@query(E + PAIRS + " SELECT w, item, other, CAST(sum(delta) OVER (PARTITION BY item, other ORDER BY w) AS BIGINT) AS cnt FROM d")
def matrix_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.matrix_state(pairs.pair_deltas(events(spark, sf_dir)))


@query(E + PAIRS + TOUCHED + " SELECT w, item FROM tw")
def touched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.touched_rows(pairs.pair_deltas(events(spark, sf_dir)))


@query(B + PAIRS + CELLS + " SELECT item, other, k11, k12, k21, k22 FROM k")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(src.from_baskets(spark, sf_dir)).select("item", "other", "k11", "k12", "k21", "k22")


def _scored(rows: DataFrame) -> DataFrame:
    return ranking.score_cells(ranking.with_sums(pairs.pair_totals(rows)), decimals=DECIMALS)


@query(E + PAIRS + CELLS + SCORES + " SELECT item, other, score FROM s")
def llr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(src.from_events(spark, sf_dir)).select("item", "other", "score")


#: Published 2 x 2 tables and small ones.
CASES = [(110, 2442, 111, 29114), (29, 13, 123, 31612), (9, 12, 429, 31327), (0, 0, 0, 0), (1, 0, 0, 3), (1, 1, 1, 1)]
_CASES = ", ".join(f"({', '.join(f'{x}::BIGINT' for x in c)})" for c in CASES)


@query(f"SELECT k11, k12, k21, k22, round({_llr_sql('k11', 'k12', 'k21', 'k22')}, 4) AS score FROM (VALUES {_CASES}) c(k11, k12, k21, k22)")
def llr_published_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(CASES, "k11 long, k12 long, k21 long, k22 long")
    return rows.withColumn("score", F.round(llr(*[F.col(c) for c in rows.columns]), 4))


@query(P + PAIRS + CELLS + SCORES + RANKED + " SELECT item, rank, other, k11, score FROM g")
def topk_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partners.top_k(src.from_customers(spark, sf_dir), K, DECIMALS).select("item", "rank", "other", "k11", "score")


@query(B + PAIRS + CELLS + SCORES + RANKED + " SELECT item, rank, other, k11, score FROM g")
def topk_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(_scored(src.from_baskets(spark, sf_dir)), K).select("item", "rank", "other", "k11", "score")


def _per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = pairs.pair_deltas(events(spark, sf_dir))
    cells = ranking.window_cells(deltas)
    return ranking.top_k(ranking.score_cells(cells, decimals=DECIMALS), K, ("w", "item")).select("w", "item", "rank", "other", "k11", "score")


@query(E + PAIRS + TOUCHED + STATE + " SELECT w, item, rank, other, k11, score FROM g")
def topk_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_window(spark, sf_dir)


@query(E + PAIRS + TOUCHED + STATE + " SELECT w, item, rank, other, k11, score FROM g QUALIFY w = max(w) OVER (PARTITION BY item)")
def topk_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.latest(_per_window(spark, sf_dir))


@query(E + PAIRS + CELLS + SCORES + RANKED + " SELECT item, CAST(count(*) AS BIGINT) AS size, min(score) AS least_score, arg_max(other, rank) AS least_value FROM g GROUP BY item")
def topk_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranking.top_k(_scored(src.from_events(spark, sf_dir)), K)
    return best.groupBy("item").agg(F.count("*").alias("size"), F.min("score").alias("least_score"), F.max_by("other", "rank").alias("least_value"))


@query(E + PAIRS + CELLS + SCORES + RANKED + " SELECT item, string_agg(CAST(other AS VARCHAR), ',' ORDER BY rank) AS others FROM g GROUP BY item")
def topk_sorted_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranking.top_k(_scored(src.from_events(spark, sf_dir)), K)
    listed = F.array_sort(F.collect_list(F.struct("rank", "other")))  # at most K
    return best.groupBy("item").agg(F.array_join(F.transform(listed, lambda x: x.other.cast("string")), ",").alias("others"))


# sampled mode, no feedback between windows


@query(E + CUT + DRAWN + ' SELECT usr AS "user", total, nth, slot FROM dr')
def reservoir_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn_events(spark, sf_dir).select("user", "total", "nth", "slot")


@query(E + CUT + DRAWN + ' SELECT usr AS "user", slot, arg_max(item, total) AS item, max(total) AS total FROM ac GROUP BY ALL')
def reservoir_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.slots(drawn_events(spark, sf_dir))


@query(E + CUT + DRAWN + f" SELECT w, item, CAST(count(*) AS BIGINT) AS n FROM dr WHERE slot >= {KMAX} GROUP BY ALL")
def reservoir_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.rejected(drawn_events(spark, sf_dir))


def _sampled_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sampled_deltas(sampling.occupancy(drawn_events(spark, sf_dir)))


@query(E + CUT + DRAWN + " SELECT w, item, other, delta FROM d")
def sampled_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled_deltas(spark, sf_dir)


@query(E + CUT + DRAWN + " SELECT w, item, CAST(sum(delta) AS BIGINT) AS delta FROM d GROUP BY ALL HAVING sum(delta) <> 0")
def sampled_row_sum_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.row_sum_deltas(_sampled_deltas(spark, sf_dir))


@query(
    E + CUT + DRAWN + """, sl AS (SELECT usr, slot, arg_max(item, total) AS item FROM ac GROUP BY ALL)
  SELECT a.item, b.item AS other, CAST(count(*) AS BIGINT) AS k11 FROM sl a JOIN sl b ON a.usr = b.usr AND a.slot <> b.slot GROUP BY ALL"""
)
def sampled_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled_deltas(spark, sf_dir).groupBy("item", "other").agg(F.sum("delta").alias("k11")).where("k11 <> 0")


@query(E + CUT + DRAWN + " SELECT item, other, CAST(sum(delta) AS BIGINT) AS k11 FROM d GROUP BY ALL")
def sampled_cells_with_ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled_deltas(spark, sf_dir).groupBy("item", "other").agg(F.sum("delta").alias("k11"))


@query(E + CUT + DRAWN + SAMPLED_TOUCHED + STATE + " SELECT w, item, rank, other, k11, score FROM g")
def sampled_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = drawn_events(spark, sf_dir)
    stays = sampling.occupancy(drawn)
    cells = ranking.window_cells(sampling.sampled_deltas(stays), sampling.sampled_touched(drawn, stays))
    return ranking.top_k(ranking.score_cells(cells, decimals=DECIMALS), K, ("w", "item")).select("w", "item", "rank", "other", "k11", "score")


# window by window


def _config(source: str = "", exact: bool = False) -> Config:
    return Config(input=source, window_size=7, window_unit="DAYS", skip_cuts=exact, item_cut=FMAX, user_cut=KMAX, top_k=K, seed=SEED, score_decimals=DECIMALS)


@query()
def sampled_feedback_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full sampler; rejections free their items' counters for the next window."""
    engine = Engine(spark, _config(), new_folder(spark, "feedback"))
    engine.add(src.from_events(spark, sf_dir), flush=True)
    return engine.topk()


def _streamed(spark: SparkSession, sf_dir: str) -> Engine:
    """The events as three files of lines, streamed file by file."""
    folder = new_folder(spark, "stream")
    rows = src.from_events(spark, sf_dir)
    n = rows.agg(F.count("*")).first()[0]
    for i in range(3):
        part = rows.where(F.floor(F.col("pos") * 3 / max(n, 1)) == i).orderBy("pos").coalesce(1)
        part.select(F.concat_ws(",", "user", "item", "ts_ms").alias("value")).write.mode("append").text(f"{folder}/lines")
    engine = Engine(spark, _config(exact=True), f"{folder}/engine")
    engine.run(f"{folder}/lines")
    return engine


@query(ORACLE_SQL["topk_per_window"])
def stream_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir).topk()


@query(ORACLE_SQL["row_sum_deltas"])
def stream_row_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, sf_dir).row_sums()


# metrics and invariants


@query(
    E + PAIRS + TOUCHED + """, v AS (SELECT *, max(ts_ms) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS watermark FROM e)
SELECT 'UserInteractionCounterLateElements' AS metric, CAST(count(*) FILTER (ts_ms <= watermark) AS BIGINT) AS value FROM v
UNION ALL SELECT 'UserInteractionCounterObservedCooccurrences', CAST(sum(delta) AS BIGINT) FROM d
UNION ALL SELECT 'RowSumProcessWindowRowSum', CAST(sum(delta) AS BIGINT) FROM d
UNION ALL SELECT 'ItemRowRescorerRescoredItems', CAST(count(*) AS BIGINT) FROM tw"""
)
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timing.mark_late(timing.running_watermark(events(spark, sf_dir)))
    deltas = pairs.pair_deltas(rows.where("not late"))
    return metrics.run_metrics(rows, deltas)


@query(
    E + CUT + DRAWN + SAMPLED_TOUCHED + f""", v AS (SELECT *, max(ts_ms) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1 AS watermark FROM e)
SELECT 'ItemInteractionCounterLateElements' AS metric, CAST(count(*) FILTER (ts_ms <= watermark) AS BIGINT) AS value FROM v
UNION ALL SELECT 'UserInteractionCounterObservedCooccurrences', CAST(coalesce(sum(2 * (nth - 1)), 0) AS BIGINT) FROM dr WHERE nth <= {KMAX}
UNION ALL SELECT 'RowSumProcessWindowRowSum', CAST(sum(delta) AS BIGINT) FROM d
UNION ALL SELECT 'ItemRowRescorerRescoredItems', CAST(count(*) AS BIGINT) FROM tw"""
)
def sampled_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = timing.mark_late(timing.running_watermark(events(spark, sf_dir)))
    drawn = sampling.reservoir(sampling.user_totals(sampling.item_cut(rows.where("not late"), FMAX)), KMAX, SEED)
    stays = sampling.occupancy(drawn)
    touched = sampling.sampled_touched(drawn, stays)
    return metrics.run_metrics(rows, sampling.sampled_deltas(stays), touched, metrics.observed_pairs(drawn, KMAX), "ItemInteractionCounterLateElements")


@query("SELECT * FROM (VALUES ('symmetry', 0::BIGINT), ('row_sums', 0::BIGINT), ('total', 0::BIGINT), ('k22', 0::BIGINT)) v(invariant, violations)")
def matrix_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = pairs.pair_deltas(events(spark, sf_dir))
    cells = ranking.with_sums(deltas.groupBy("item", "other").agg(F.sum("delta").alias("k11")))
    return metrics.violations(deltas, cells)
