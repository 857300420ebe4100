import duckdb
import numpy as np
import pandas as pd
import pytest

from tilewright.llm import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or pd.isna(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    return round(float(v), 9) if isinstance(v, (int, float, np.integer, np.floating)) else str(v)


def rows(frame):
    return sorted(repr(tuple(map(plain, r))) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == 200
    assert rows(got) == rows(want)
