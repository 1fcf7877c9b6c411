"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("LOAMWORK_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [k for k in entry.queries() if k != "pipeline" and not (k.startswith("op") and k[2].isdigit())]


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return None if v != v else int(v) if v.is_integer() else round(v, 9)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got and len(set(df.columns)) == len(df.columns)
        return
    done = duck.execute(sql)
    columns = [c[0] for c in done.description]
    want = done.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, want)


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
