"""The registered queries against their DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from govlake.llm.queries import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("GOVLAKE_TEST_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(names) == sorted(df.columns)
    expected, got = sorted(result.fetchall(), key=repr), sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert got == expected and got
