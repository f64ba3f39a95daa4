"""The registered queries: each runs on the smallest tables, SQL is text, and problem 3 agrees with it."""

from pathlib import Path

import duckdb

from docweave.llm import queries

COLUMNS = {
    "p2_found": ["doc_id", "seg_no", "lang_found"],
    "p3_found": ["doc_id", "line_no"],
    "p4_found": ["table_name", "doc_id", "start_pos", "end_pos", "pii_kind"],
    "p5_found": ["doc_id", "line_no"],
    "p7_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id"],
}


def test_columns(spark, sf_dir):
    every = queries.queries()
    for name, columns in COLUMNS.items():
        assert every[name](spark, sf_dir).columns == columns


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    for name, sql in queries.oracle_sql().items():
        assert isinstance(sql, str)
        expected = con.execute(sql)
        columns = [c[0] for c in expected.description]
        got = queries.queries()[name](spark, sf_dir).select(*columns)
        assert sorted(map(tuple, got.collect())) == sorted(expected.fetchall())
