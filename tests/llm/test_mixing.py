"""Operator 1: targets against the iterative reading of the contract; takes near targets."""

import math
import random
import re
from collections import defaultdict

import pytest

from tessera.llm.mixing import mix
from tessera.llm.queries import op1_mixing


def plain_targets(size, weights=(5, 2, 1), share=1.5):
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), share * sum(size.values())
    while free:
        at = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if at[s] > 2 * size[s]]
        if not over:
            target.update(at)
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.discard(s)
    return target


def check(rows, got):
    """rows: (doc_id, text, source)."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, source = defaultdict(int), {}
    for i, t, s in rows:
        size[s] += words(t)
        source[i] = s
    target, took = plain_targets(size), defaultdict(int)
    assert len(got) == len(rows)
    assert sorted(r.size for r in got) == sorted(words(t) for _, t, _ in rows)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(target[s], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size and 0 <= r.rate <= 2
        took[s] += r.taken
    return target, took, size


def test_whole_table(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = op1_mixing(spark, sf_dir).collect()
    target, took, _ = check(rows, got)
    for s in target:
        assert abs(took[s] - target[s]) <= 0.02 * target[s]
    assert sorted(got) == sorted(op1_mixing(spark, sf_dir).collect())


def test_edge_rows(spark):
    long = "w " * 50_000
    rows = [(1, None, "a"), (2, "", "b"), (3, long, "c"), (4, "x y\x85z\x00 \x1f", "c"), (5, "only", None), (6, "one two", ""), *[(10 + i, "some words here", "d") for i in range(200)], (500, "\t\n ", "zero"), *[(600 + i, "q " * 100, "é") for i in range(500)]]
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id long, text string, source string, size int, taken string")
    target, took, size = check(rows, mix(df, columns=["doc_id"]).collect())
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    assert abs(took["é"] - target["é"]) <= 300 and abs(took["d"] - target["d"]) <= 9  # under half of a bin
    whole = mix(df)
    assert whole.columns == ["doc_id", "text", "source", "size", "source_size", "target", "rate", "copies", "taken"]
    assert whole.count() == len(rows)
    assert mix(df.limit(0)).collect() == []
    assert mix(df.where("doc_id in (1, 2)"), columns=["doc_id"]).agg({"taken": "sum"}).first()[0] == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b c", "s")] * 40 + [(1, "a b c d", "s")] * 3 + [(i, "u v", "t") for i in range(100, 180)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df, columns=["doc_id"]).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)


def plain_rate(sizes, target, cap=2.0):
    """The tilt whose tokens meet the target, by bisection, and the rate of each size at it."""
    mean = sum(sizes) / len(sizes)
    at = lambda lam, n: cap / (1 + math.exp(max(-60.0, min(60.0, -lam * n / mean))))
    lo, hi = -60.0 * mean, 60.0 * mean
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(n * at(mid, n) for n in sizes) < target else (lo, mid)
    return {n: at((lo + hi) / 2, n) for n in set(sizes)}


def test_rates_meet_the_targets_by_one_tilt_a_source(spark):
    rnd = random.Random(4)
    rows = [(i, "w " * int(rnd.lognormvariate(3, 1)), f"s{rnd.choice((0, 0, 0, 1, 1, 2, 3))}") for i in range(400)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), columns=["doc_id", "source"]).collect()
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source and r["size"]]
        target = mine[0].target
        if target < 2 * mine[0].source_size - 1e-6:
            want = plain_rate([r["size"] for r in mine], target)
            assert all(r.rate == pytest.approx(want[r["size"]], abs=1e-4) for r in mine)
        else:
            assert all(r.rate == pytest.approx(2.0) and r.copies == 2 for r in mine)
