import duckdb
import pytest

import __spark_entry__ as entry
from tallyloom import queries as core

SF = "/root/testdata/sf0.001"


def check(spark, name, query, sql):
    con = duckdb.connect()
    for t in core.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = query(spark, SF)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=key) == sorted(map(tuple, want.fetchall()), key=key), name


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_core_query(spark, name):
    check(spark, name, core.queries()[name], core.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(core.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
