"""Every registered query with SQL gives the SQL's rows at the smallest scale; the others run."""

import duckdb
import pytest

from faultline import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def _norm(v):
    return round(v, 5) + 0.0 if isinstance(v, float) else tuple(v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    out = catalog.queries()[name](spark, SF)
    columns = sorted(out.columns)
    got = sorted((tuple(_norm(r[c]) for c in columns) for r in out.collect()), key=str)
    if (sql := catalog.oracle_sql().get(name)) is None:
        return
    want = duck.sql(sql)
    names = want.columns
    assert sorted(names) == columns
    assert got == sorted((tuple(_norm(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=str)
