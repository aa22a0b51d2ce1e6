import math

import duckdb
import pytest

from pairlift.plans.catalogue import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
#: The stream twins run in test_engine; they take long.
NAMES = [q for q in ORACLE_SQL if not q.startswith("stream_")]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("null" if r[i] is None or (isinstance(r[i], float) and math.isnan(r[i])) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, db, name):
    df = QUERIES[name](spark, DIR)
    cur = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.collect(), df.columns) == plain(cur.fetchall(), names)
