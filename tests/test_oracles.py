"""Every core query against the same query in SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from docweave.plans import catalog

SQL = catalog.oracle_sql()


def canon(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(canon(y) for y in x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    res = con.execute(SQL[name])
    columns = [c[0] for c in res.description]
    expected = res.fetchall()
    got = __spark_entry__.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, expected)


def test_every_query_runs(spark, sf_dir):
    for name, query in catalog.queries().items():
        if name not in SQL:
            assert query(spark, sf_dir).count() >= 0, name


def test_entry_has_rows(spark):
    if Path("/root/testdata/sf0.001").exists():
        assert __spark_entry__.entry(spark).count() > 0
