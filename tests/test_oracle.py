"""Every query that SQL can express gives what DuckDB gives; the others give rows."""

import duckdb
import pytest

from lumenrec.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, con, name):
    got = catalog.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in got.collect()]
    if name not in catalog.oracle_sql():
        assert rows
        return
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(rows, got.columns) == plain(want.fetchall(), want.columns)
