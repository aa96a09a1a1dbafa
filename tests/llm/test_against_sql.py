"""Queries with an SQL form, on the smallest data folder."""

import duckdb
import pytest

from realcurve.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_rows_equal_sql(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = con.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    want = sorted(map(repr, found.fetchall()))
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want
