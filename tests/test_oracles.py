"""Every query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from docloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(float(v)) else f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert rows or name in ("d12_near_duplicates",)
        return
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in places) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
