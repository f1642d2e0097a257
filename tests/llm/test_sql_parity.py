"""Queries of the training-data part that have SQL, against it on the smallest tables."""

import os

import duckdb
import pytest

from conftest import SF0001
from scripts.check_oracle import TABLES, digest
from tidemark.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{SF0001}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_sql(spark, duck, key):
    df = QUERIES[key](spark, SF0001)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(ORACLE[key])
    names = [d[0] for d in res.description]
    expected = res.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert len(rows) == len(expected)
    assert digest(df.columns, rows)[0] == digest(names, expected)[0]
