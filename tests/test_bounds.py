"""Searches that skip by bounds, against plain ones; what they compare is counted. Memories against a plain walk."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import memory, search
from tessera.plans import tables


def clustered(n, groups, seed, size=24):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(groups, size))
    x = centres[rnd.integers(groups, size=n)] + rnd.normal(size=(n, size)) * 0.15
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()


def test_nearest_vectors_and_skipped_pairs(spark):
    x = clustered(3_000, 30, 1)
    x[7], x[8] = x[6], x[6]  # ties
    rows = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(x)], "row_id long, label int, embedding array<float>")
    asked = rows.where("row_id % 50 = 6").select(F.col("row_id").alias("query_id"), "embedding")
    m = np.array([r.embedding for r in rows.orderBy("row_id").collect()], np.float64)
    for group, shard in ((None, 700), ("label", 10_000)):
        found = {}
        for r in V.nearest(asked, rows, 5, group, shard=shard).collect():
            found.setdefault((r.query_id, r[group] if group else 0), []).append((-round(r.cosine, 6), r.row_id))
        for (q, g), got in found.items():
            every = [(-round(float(m[q] @ m[i]), 6), i) for i in range(len(x)) if not group or i % 3 == g]
            assert sorted(got)[:5] == sorted(every)[:5]
        assert len(found) == 60 * (3 if group else 1)
        done = V.nearest(asked, rows, 5, group, shard=shard, counted=True).agg(F.sum("compared"), F.sum("pairs")).first()
        assert done[1] == 60 * 3_000 and done[0] < done[1] / 2
    assert V.nearest(asked, rows.limit(0), 5).count() == 0 and V.nearest(asked.limit(0), rows, 5).count() == 0


def test_best_chunks_by_block_bounds(spark, monkeypatch):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(words[min(399, int(rnd.paretovariate(0.7)) - 1)] for _ in range(n))
    chunks = spark.createDataFrame([(f"s{i % 2}", i, text(rnd.randrange(5, 120))) for i in range(3_000)], "source_key string, chunk_no long, text string")
    asked = spark.createDataFrame([(i, text(12)) for i in range(25)], "query_id long, text string")
    for cell in (search.CELL, 400):
        monkeypatch.setattr(search, "CELL", cell)
        rank = lambda df: sorted((r.query_id, r.source_key, r.rank, r.chunk_no, r.bm25) for r in search._top(df.withColumn("bm25", F.round("bm25", 6)), ["query_id", "source_key"], [F.desc("bm25"), "chunk_no"], 4).collect())
        assert rank(search.bm25_best(asked, chunks, 4)) == rank(search.bm25(asked, chunks))
    done = search.bm25_best(asked, chunks, 4, counted=True).agg(F.sum("scored"), F.sum("matched")).first()
    assert 0 < done[0] < 0.8 * done[1]
    assert search.bm25_best(asked, chunks.limit(0), 4).count() == 0


def test_copies_of_one_text_are_dealt_out(spark):
    """The rows meet the stored minima on the digest and the order, so one text's copies have many keys."""
    docs = spark.createDataFrame([(i, "same" if i % 3 else str(i)) for i in range(300)], "doc_id long, text string")
    out = search.dedupe_exact(docs, ["doc_id"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" in plan.split("Join Inner")[1].split("\n")[0]
    assert {r.doc_id: r.copies for r in out.collect()} == {1: 200, **{i: 1 for i in range(0, 300, 3)}}


def plain_walk(rows):
    held, kept = {"longterm": [], "midterm": []}, []
    for ts, content, tier, ends in rows:
        for t in held:
            held[t] = [h for h in held[t] if h[1] is None or h[1] >= ts]
        w = set(content.split())
        if any(len(w & h) > 0.8 * len(w | h) for t in held for h, _ in held[t]):
            continue
        kept.append((ts, content))
        held[tier] = [*held[tier], (w, ends)][-{"longterm": 50, "midterm": 20}[tier] :]
    return kept


def test_memories_with_caps_and_ends(spark):
    rnd, at = random.Random(3), datetime(2024, 1, 1)
    rows = []
    for user in "ab":
        mine = []
        for i in range(700):
            content, tier = f"the fact number {rnd.randrange(90)} is so", rnd.choice(["longterm", "midterm"])
            ts = at + timedelta(hours=2 * i)
            mine.append((ts, content, tier, ts + timedelta(days=7) if tier == "midterm" else None))
        rows += [(user, ts, 0, c, t, e) for ts, c, t, e in mine]
    df = spark.createDataFrame(rows, "user string, ts timestamp, pos int, content string, tier string, expires_at timestamp").repartition(4)
    got = memory.suppress_repeats(df).collect()
    for user in "ab":
        want = plain_walk([r[1:2] + r[3:] for r in rows if r[0] == user])
        assert sorted((r.ts, r.content) for r in got if r.user == user) == sorted(want) and 60 < len(want) < 700
    first = [("a", at + timedelta(hours=i), 0, f"quite another fact {i} {i * 7} {i * 13}", "longterm", None) for i in range(60)]
    again = [("a", at + timedelta(hours=99), 0, first[0][3], "longterm", None), ("a", at + timedelta(hours=100), 0, first[59][3], "longterm", None)]
    kept = memory.suppress_repeats(spark.createDataFrame(first + again, df.schema)).collect()
    assert len(kept) == 61  # the first is held no more, the last one is


def test_tables_prune_by_bounds(spark, sf_dir):
    done = search.bm25_best(tables._questions(spark, sf_dir), tables._chunks(spark, sf_dir), 4, counted=True).agg(F.sum("scored"), F.sum("matched")).first()
    assert done[0] <= done[1]
