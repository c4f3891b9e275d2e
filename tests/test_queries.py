"""Every query with SQL gives the same rows as DuckDB; the entry module works without the subpackage for training data."""

import datetime
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.queries import ORACLES, QUERIES


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def plain(x):
    return round(x, 6) if isinstance(x, float) else x.isoformat() if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([plain(x) for x in r]) for r in df.select(*cols).collect())
    if name in ORACLES:
        want = duck.execute(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall()
        assert got == sorted(repr([plain(x) for x in r]) for r in want)
        assert cols == sorted(c[0] for c in duck.execute(f"select * from ({ORACLES[name]}) limit 0").description)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import sys; sys.modules['millrace.llm'] = None; import __spark_entry__ as e; assert 'flagship' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
