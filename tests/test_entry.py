import pytest

import __spark_entry__ as entry
from tallyloom.plans import queries

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    got = sorted(str([r[c] for c in names]) for r in df.collect())
    out = duck.execute(queries.ORACLES[name])
    cols = [d[0] for d in out.description]
    assert sorted(cols) == names
    assert got == sorted(str([r[cols.index(c)] for c in names]) for r in out.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
