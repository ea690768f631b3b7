"""Every registered core query runs on the smallest tables; those with SQL agree with DuckDB."""

import glob
import os

import duckdb
import pytest

from quillmark.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.5f}"
    return str(v)


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = df.collect()
    if name in SQL:
        want = duck.execute(SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, want.fetchall())


def test_unlike_llm_package_is_not_imported():
    import subprocess
    import sys

    code = "import sys; from quillmark.plans import registry; assert not [m for m in sys.modules if m.startswith('quillmark.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True)
