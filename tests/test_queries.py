"""Every query of the engine against its SQL on the smallest tables."""

from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from parchment.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if not isinstance(v, (list, dict)) and pd.isna(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (float, Decimal)):
        v = round(float(v), 6)
        return int(v) if v == int(v) else v
    return v


def rows(df, columns):
    return sorted(repr(tuple(plain(v) for v in r)) for r in df[columns].itertuples(index=False))


def same(spark, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = query(spark, SF).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_and_sql_agree(spark, name):
    same(spark, queries.queries()[name], queries.oracle_sql()[name])


def test_every_query_has_sql():
    assert queries.queries().keys() == queries.oracle_sql().keys()
