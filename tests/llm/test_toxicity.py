"""Operator 10: held-out accuracy, folds, plain scoring, and edge rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_kernels import M, plain_hash, plain_mix

from tessera.llm import toxicity as T
from tessera.llm.queries import op10_toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = op10_toxicity(spark, sf).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    mine = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    caught = sum(y and p for y, p in mine)
    assert caught >= 0.75 * sum(y for y, _ in mine) and sum(p and not y for y, p in mine) <= 0.03 * len(mine)
    assert sorted(got) == sorted(op10_toxicity(spark, sf).collect())


def test_scores_are_sums_of_word_weights(spark):
    model = T.fit(["you foulword here"] * 20 + ["more foulword text"] * 20, ["plain clean text here"] * 30 + ["other calm words"] * 30 + ["foulword"], 0.1)
    long = "calm words " * 20_000
    rows = [(1, "Foulword!"), (2, "calm"), (3, None), (4, ""), (5, long), (None, "FOULWORD foulwords"), (1, "Foulword!")]
    df = spark.createDataFrame([(i, t, 9, 0.5) for i, t in rows], "doc_id long, text string, predicted int, score double")
    got = {(r.doc_id, r.score, r.predicted) for r in T.scores(df, model, ["doc_id", "predicted"]).collect()}
    assert len(T.scores(df, model, ["doc_id"]).collect()) == len(rows)
    by = {i: (s, p) for i, s, p in got}
    assert by[1][1] == 1 and by[None][1] == 1 and by[2][1] == by[3][1] == by[4][1] == by[5][1] == 0
    assert by[3] == by[4]
    text = "a foulword and foulwordx"
    r, c, v = T._matrix([text])
    plain = 1 / (1 + np.exp(-(float(v @ model.weights[c]) + model.bias)))
    one = T.scores(spark.createDataFrame([(1, text)], "doc_id long, text string"), model, ["doc_id"]).first()
    assert one.score == pytest.approx(plain, abs=1e-6)


def test_without_toxic_labels_or_rows(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (2, 0), (None, 1)], "doc_id long, toxic int")
    for lab in (labels, labels.limit(0)):
        assert {(r.score, r.predicted) for r in T.scores(docs, T.learn(docs, lab), ["doc_id"]).collect()} == {(0.0, 0)}
    assert T.scores(docs.limit(0), T.learn(docs.limit(0), labels), ["doc_id"]).collect() == []


def plain_features(text):
    """feature -> value: words and their beginnings, by the plain hash of their bytes."""
    words, out = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.lower()), Counter()
    for w in (x.encode() for x in words):
        for kind, n in enumerate((None, *T.BEGINNINGS)):
            if n is None or len(w) > n:
                h = plain_hash(w if n is None else w[:n]) ^ 0x9E3779B97F4A7C15 * (kind + 1) & M
                out[plain_mix(h) >> 64 - T.BITS] += 1
    return {f: n / len(words) ** 0.5 for f, n in out.items()}


def test_features_and_scores_match_plain_ones(spark):
    rnd = random.Random(5)
    pool = ["calm", "words", "foulword", "FOULWORDS", "été", "漢字漢字漢字", "x1", "longerwordthanthat"]
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randint(1, 40))) + rnd.choice(("", "!", " ?!")) for _ in range(60)]
    rows, cols, vals = T._matrix(texts)
    for i, t in enumerate(texts):
        assert dict(zip(cols[rows == i].tolist(), vals[rows == i].tolist())) == pytest.approx(plain_features(t))
    weights = np.random.default_rng(1).normal(size=1 << T.BITS).astype(np.float32)
    model = T.Model(weights, -0.5)
    got = {r.doc_id: r.score for r in T.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        z = sum(float(weights[f]) * v for f, v in plain_features(t).items()) + model.bias
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_step_follows_the_risk():
    rng = np.random.default_rng(3)
    xp, xu, prior, decay = rng.normal(1, 1, (30, 4)), rng.normal(0, 1, (50, 4)), 0.2, 1e-3

    def parts(v):
        zp, zu = xp @ v[:4] + v[4], xu @ v[:4] + v[4]
        rest = np.mean([math.log1p(math.exp(z)) for z in zu]) - prior * np.mean([math.log1p(math.exp(z)) for z in zp])
        return prior * np.mean([math.log1p(math.exp(-z)) for z in zp]), rest, decay / 2 * float(v[:4] @ v[:4])

    seen = set()
    for bias in (-6.0, -2.0, 0.0, 2.0):
        for scale in (0.1, 1.0, 3.0):
            v = np.append(rng.normal(0, scale, 4), bias)
            step, rest = T.risk_gradient(v[:4], v[4], xp, xu, prior, decay)
            assert rest == pytest.approx(parts(v)[1])
            seen.add(rest >= 0)
            goal = (lambda u: sum(parts(u))) if rest >= 0 else (lambda u: parts(u)[2] - parts(u)[1])
            numeric = [(goal(v + e) - goal(v - e)) / 2e-5 for e in 1e-5 * np.eye(5)]
            assert step == pytest.approx(numeric, abs=1e-6)
    assert seen == {True, False}


def test_equally_strong_features_at_the_bound():
    row, col = np.repeat(np.arange(40), 3), np.tile([9, 5, 7], 40)
    part = row < 20  # all three stand in every toxic text and in no other
    assert T._telling(row[part], col[part], 20, 40, 2, 0.0).tolist() == [5, 7]
