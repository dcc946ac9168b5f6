"""Every query with SQL against DuckDB on the smallest tables, and no query without rows."""

import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Empty at this size by the tables' making.
MAY_BE_EMPTY = {"evicted_turns"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    cell = lambda v: None if v is None or pd.isna(v) else round(v, 6) if isinstance(v, float) else v if isinstance(v, (str, bool)) else str(v)
    return sorted((tuple(cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
    assert len(got) or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = QUERIES["clean_text"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = QUERIES["language_streak"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "props" not in plan.split("== Physical Plan ==")[1]
