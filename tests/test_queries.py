"""Every named query against its DuckDB SQL on the smallest fixture tables."""

import os

import duckdb
import pytest

from govlake.queries import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("GOVLAKE_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def shown(v):
    if v is None or v != v:
        return "NULL"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(tuple(shown(r[i]) for i in order) for r in result.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["filter_range"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_totalprice" in plan and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_no_python_in_any_plan(spark):
    for name, query in QUERIES.items():
        plan = query(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name


def test_nothing_else_imports_the_text_operators():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "govlake")
    for folder, _, files in os.walk(root):
        if f"{os.sep}llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "govlake.llm" not in open(os.path.join(folder, f), encoding="utf-8").read(), f
