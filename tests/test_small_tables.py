"""Cases that the input tables don't have, over small invented tables, against rows worked out by hand."""

import duckdb
import pytest
from pyspark import cloudpickle
from test_queries import plain

import small_cases
import small_tables

for module in (small_cases, small_tables):  # workers don't have the tests' modules
    cloudpickle.register_pickle_by_value(module)
CASES = {f.__name__: (f, sql) for f, sql in [*small_tables.QUERIES, *small_cases.QUERIES]}


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, sf_dir, name):
    query, sql = CASES[name]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want) and len(got)
