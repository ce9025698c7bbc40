import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from compare import TABLES, norm  # noqa: E402

DATA = "/root/testdata/sf0.001"
CORE = [k for k in sorted(entry.oracle_sql()) if k in __import__("lectern.plans", fromlist=["x"]).queries()]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(names, values):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(norm(v[i]) for i in at) for v in values)


@pytest.mark.parametrize("name", CORE)
def test_query_against_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() >= 0
