"""Callers' columns in the pipeline's stages, whatever their names."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tessera.session import table

NAMES = ["__index_level_0__", "__th", "__score", "__text", "__size", "__n", "___th", "c0", "__lang", "__key"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=lambda f: f.__name__)
def test_columns_stay_and_rows_are_the_same(spark, sf_dir, stage):
    docs = table(spark, sf_dir, "documents").where("doc_id < 120")
    docs = docs.unionByName(docs.where("doc_id < 9"))  # repeated rows
    more = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES})
    plain, wide = stage(spark, docs, sf_dir), stage(spark, more, sf_dir)
    assert set(NAMES) <= set(wide.columns)
    rows = lambda df: sorted(map(str, df.select(*plain.columns).collect()))
    assert rows(wide) == rows(plain) != []
    assert all(r[n] == f"{n}{r.doc_id}" for r in wide.collect() for n in NAMES)


def test_a_hub_and_a_long_posting_list_are_split(spark):
    """The edges meet stored minima, so the join is of two plain exchanges, which adaptive execution splits where they are skewed."""
    from tessera.llm import components as C
    from tessera.session import checkpoint

    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(was, ("64k", "32k", "-1", "8")):
            spark.conf.set(k, v)
        edges = checkpoint(spark.range(1, 400_000).select(F.when(F.col("id") % 4 > 0, F.lit(1_000_000)).otherwise(F.col("id") + 2_000_000).alias("u"), F.col("id").alias("v")))
        out = C._star(edges, False)
        out.count()
        df = out.select("u")
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
