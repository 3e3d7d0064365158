"""Every registered query runs over whole tables and agrees with its SQL where there is one."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from verify import rows_of

LLM = {k for k in entry.queries() if k.startswith(("p1_", "p3_", "p5_", "p6_", "p8_", "p9_", "p10_"))}
NAMES = sorted(set(entry.queries()) - LLM)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, con, name):
    df = entry.queries()[name](spark, data)
    got = rows_of(df.columns, df.collect())
    assert len(set(df.columns)) == len(df.columns)
    if sql := entry.oracle_sql().get(name):
        r = con.execute(sql)
        cols = [c[0] for c in r.description]
        assert sorted(cols) == sorted(df.columns)
        assert got == rows_of(cols, r.fetchall())


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
