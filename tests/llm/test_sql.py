"""Training-data queries that SQL can express give the SQL's rows."""

from pathlib import Path

import duckdb
import pytest

from tilth.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(SQL[name])
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(map(tuple, df.select(want.columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
