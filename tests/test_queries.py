"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import SF

NAMES = [n for n in entry.queries() if n in entry.oracle_sql()]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    places = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in places) for r in rel.fetchall()), key=repr)
    assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
