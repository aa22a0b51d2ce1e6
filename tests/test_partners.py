import numpy as np
import pytest

from pairlift.operators import pairs, partners, ranking
from pairlift.plans import catalogue


@pytest.mark.parametrize("items", [40, 1 << 45])
def test_partners_are_those_of_the_written_out_pairs(spark, items):
    """In several rounds, with chunks of 4 records and few entries at a time; ties, null users, a user with one item, wide ids."""
    rng = np.random.default_rng(3)
    kinds = [int(x) - 7 for x in rng.integers(0, items, 40)]
    rows = [(int(u), kinds[i]) for u, i in zip(rng.integers(0, 30, 500), rng.integers(0, 40, 500), strict=True)]
    rows += [(None, kinds[0]), (None, kinds[1]), (99, kinds[2])] + [(u, kinds[5]) for u in range(100, 130)]
    df = spark.createDataFrame(rows, "user long, item long")
    names = ["item", "rank", "other", "k11", "row_sum", "other_sum", "n", "score"]
    known = df.where("user is not null")
    plain = ranking.top_k(ranking.score_cells(ranking.with_sums(pairs.pair_totals(known)), decimals=4), 3).select(names)
    got = partners.top_k(df, 3, 4, round_bytes=60, block=4, held=50).select(names)
    assert sorted(got.collect()) == sorted(plain.collect())


def test_no_interactions(spark):
    assert partners.top_k(spark.createDataFrame([], "user long, item long"), 3, 4).count() == 0


def test_few_cells_are_left_to_rank():
    rng = np.random.default_rng(4)
    item = np.repeat(np.arange(20), 1000)
    k11, other_sum = rng.integers(1, 4, 20_000), rng.integers(900, 1100, 20_000)
    at = partners._may_be_best(item, np.full(20_000, 1500), np.tile(np.arange(1000), 20), other_sum, k11, 20_000_000, 10, 4)
    assert 200 <= len(at) <= 2000


def test_topk_final_writes_out_no_pairs(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("pairs written out")

    monkeypatch.setattr(pairs, "pair_totals", refuse)
    assert catalogue.topk_final(spark, "/root/testdata/sf0.001").where("rank = 1").count() > 0
