"""Hold a query's rows against DuckDB's over the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(frame):
    names = sorted(frame.columns)
    return sorted(str(tuple(None if x is None or x != x else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in r)) for r in frame[names].astype(object).itertuples(index=False))


def expected(sql):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con.sql(sql).df()


def check(spark, query, sql):
    got, want = query(spark, DATA).toPandas(), expected(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
