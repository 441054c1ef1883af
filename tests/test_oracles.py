"""Every query with an oracle against DuckDB, on the smallest data."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from quarry.plans import more, oracle, queries

SQL = oracle.ORACLE_SQL | more.SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if pd.isna(x):
        return None
    if isinstance(x, bool) or not hasattr(x, "real"):
        return str(x)
    return round(float(x), 5)


def rows(df, columns):
    return sorted((tuple(plain(x) for x in r) for r in df[columns].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, con, name):
    got = queries.QUERIES[name](spark, sf)
    assert {k for _, k in got.dtypes} <= {"bigint", "double", "string", "boolean", "array<struct<id:string,page:bigint>>"}, got.dtypes
    frame = got.toPandas()
    if name in SQL:
        want = con.sql(SQL[name]).df()
        columns = sorted(frame.columns)
        assert columns == sorted(want.columns)
        assert rows(frame, columns) == rows(want, columns)
    else:
        assert len(frame)
