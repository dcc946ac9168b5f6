"""An index by batches against one built anew, and bucketed tables that joins don't move."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import search, store
from tessera.operators.live_index import KEY, LiveIndex

SCHEMA = "source_key string, chunk_no long, text string"


def chunks(spark, rnd, numbers):
    words = [f"w{i}" for i in range(60)]
    rows = [("hot" if i % 3 else f"s{i % 7}", i, " ".join(rnd.choices(words, k=rnd.randrange(0, 30)))) for i in numbers]
    return spark.createDataFrame([*rows], SCHEMA)


def plain(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def same(spark, index, left):
    posts = search.postings(left)
    assert plain(index.chunks(spark).select(*left.columns)) == plain(left)
    assert plain(index.postings(spark).select(*posts.columns)) == plain(posts)
    assert plain(index.stats(spark)) == plain(search.term_stats(left, posts))


def test_batches_equal_one_build(spark, tmp_path):
    rnd = random.Random(4)
    index = LiveIndex(f"{tmp_path}/i", SCHEMA)
    assert index.stats(spark).count() == 0 and index.chunks(spark).count() == 0
    index.compact(spark)
    first, second, again = chunks(spark, rnd, range(0, 90)), chunks(spark, rnd, range(90, 150)), chunks(spark, rnd, range(20, 40))
    index.apply(spark, 0, first)
    same(spark, index, first)
    gone = spark.createDataFrame([("hot", 1), ("s0", 0), ("hot", 1), ("s9", 999), (None, 5)], "source_key string, chunk_no long")
    second = second.unionByName(spark.createDataFrame([("s1", 500, None), ("s1", 501, "")], SCHEMA))
    index.apply(spark, 1, second, gone)
    left = first.unionByName(second).join(gone, KEY, "left_anti")
    same(spark, index, left)
    index.apply(spark, 3, again)  # replaces chunks that are there; the last batch, applied again, counts once
    index.apply(spark, 3, again)
    left = left.join(again, KEY, "left_anti").select(*first.columns).unionByName(again)
    same(spark, index, left)
    with pytest.raises(ValueError):
        index.apply(spark, 2, first)
    index.compact(spark)
    index.compact(spark)
    same(spark, index, left)
    with pytest.raises(ValueError):
        index.apply(spark, 3, again)
    index.apply(spark, 4, removed=left.where("source_key = 'hot'").select(*KEY))  # a source that goes as a whole
    left = left.where("source_key <> 'hot'")
    same(spark, index, left)
    asked = spark.createDataFrame([(1, "w1 w2 w2 w59")], "query_id long, text string")
    found = search.bm25_best(asked, index.chunks(spark), 4, index.postings(spark), index.stats(spark))
    assert plain(found) == plain(search.bm25_best(asked, left, 4)) and found.count()


def test_broken_batch_does_not_count(spark, tmp_path):
    rnd = random.Random(5)
    index = LiveIndex(f"{tmp_path}/i", SCHEMA)
    first, second = chunks(spark, rnd, range(40)), chunks(spark, rnd, range(40, 60))
    index.apply(spark, 0, first)
    index.apply(spark, 1, second)
    store.remove(spark, f"{tmp_path}/i/sizes/delta/batch=1")  # as if the run had ended before its last table
    same(spark, index, first)
    index.apply(spark, 1, second)
    same(spark, index, first.unionByName(second))


def test_statistics_read_no_texts_or_postings(spark, tmp_path):
    index = LiveIndex(f"{tmp_path}/i", SCHEMA)
    index.apply(spark, 0, chunks(spark, random.Random(6), range(30)))
    files = " ".join(index.stats(spark).inputFiles())
    assert "/terms/" in files and "/sizes/" in files and "/postings/" not in files and "/chunks/" not in files


def test_bucketed_side_stays_where_it_is(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        digest = F.md5(F.col("id").cast("string").cast("binary"))
        cache = store.save_bucketed(spark.range(0, 3000, 2).select(digest.alias("digest")), "bucketed_cache", f"{tmp_path}/cache", ["digest"], 4)
        asked = spark.range(1000).select("id", digest.alias("digest"))
        for found, n in ((search.cache_hits(asked, cache), 500), (search.cache_misses(asked, cache), 500)):
            assert found.count() == n
            assert found._jdf.queryExecution().executedPlan().toString().split("== Final Plan ==")[-1].split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
        spark.sql("DROP TABLE bucketed_cache")
        named = store.open_bucketed(spark, "bucketed_cache", f"{tmp_path}/cache", "digest string", ["digest"], 4)
        found = search.cache_hits(asked, named)
        assert found.count() == 500 and found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        messages = spark.range(400).select(F.col("id").cast("string").alias("qa_id"), (F.col("id") % 9).cast("string").alias("session_id"), F.lit("q").alias("query"), F.col("id").alias("created_at"))
        held = store.save_bucketed(messages.where("created_at < 300"), "bucketed_messages", f"{tmp_path}/messages", ["qa_id", "session_id"], 4)
        out = store.append_messages(held, messages.where("created_at >= 200"))
        assert out.count() == 400
        assert "SelectedBucketsCount: 4 out of 4" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("bucketed_cache", "bucketed_messages"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
