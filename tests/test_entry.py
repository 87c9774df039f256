"""Every registered query against its SQL, or at least run, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexspark.jobs import queries as legal

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def plain(rows):
    rounded = [tuple(round(x, 6) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in r) for r in rows]
    return sorted(rounded, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", list(legal.QUERIES))
def test_query(spark, name):
    df = legal.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*columns).collect())
    if name not in legal.ORACLE_SQL:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    result = con.execute(legal.ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == plain(tuple(r[i] for i in order) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
