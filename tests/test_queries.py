"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tilth.plans.registry import FLAGSHIP, QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(row):
    return tuple(f"{v:.9g}" if isinstance(v, float) and math.isfinite(v) else str(v) for v in row)


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    got = sorted(shown(r[c] for c in columns) for r in df.collect())
    assert got == sorted(shown(r[k] for k in place) for r in want.fetchall())


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES
