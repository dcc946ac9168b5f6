"""Operator 3: the table parse against a plain greedy parse, accuracy on held-out rows, and edge rows."""

import random
import zlib

import numpy as np

from tessera.llm import kernels as K
from tessera.llm import language_id as L
from tessera.llm.queries import op3_language_id


def plain_norm(text):
    out = "".join(c.lower() if c.isalpha() else "\0" for c in text)
    while "\0\0" in out:
        out = out.replace("\0\0", "\0")
    return out.encode()


def plain_phrases(sample, text):
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i = max(j - 1, i + 1)
        n += 1
    return n


def test_phrases_match_a_plain_parse():
    rnd = random.Random(1)
    word = lambda a: "".join(rnd.choice(a) for _ in range(rnd.randint(1, 6)))
    samples = {lang: " ".join(word(a) for _ in range(150)) for lang, a in (("aa", "abcé"), ("bb", "bcdß"))}
    model = L.fit(list(samples.items()))
    texts = [" ".join(word("abcdéß") for _ in range(rnd.randint(0, 40))) for _ in range(50)] + ["", "12 !", "zz1zz", "Ab É", " ".join(word("abé") for _ in range(1500)), "ab" * 4000, samples["aa"] * 4, "漢字" * 900, "漢a" * 900]
    joined = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    got, _, has = L.phrases(model, np.frombuffer(joined, np.uint8), offsets)
    for i, t in enumerate(texts):
        norm = plain_norm(t)
        assert has[i] == any(c.isalpha() for c in t)
        for j, lang in enumerate(model.langs):
            assert got[i, j] == plain_phrases(plain_norm(" " + samples[lang]), norm), (i, lang)
    assert sum(1 for _ in K.chunks(np.frombuffer(joined, np.uint8), offsets, 100)) > 5


def test_held_out_accuracy(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op3_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    mine = [r for r in got if r.held_out]
    assert len(mine) > 20 and sum(r.lang_pred == lang[r.doc_id] for r in mine) >= 0.98 * len(mine)


def test_edge_rows(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = L.learn(base)
    long = "the of and that " * 30_000
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !? \x00", None), (4, long, "xx"), (4, long, "xx"), (None, "the of and that with", "de"), (5, "漢字", "de"), (6, "a", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in L.identify(df, model, ["doc_id", "score"]).collect()), key=str)
    assert [x for x in got if x[0] in (1, 2, 3)] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)]
    assert all(x[1] == "en" for x in got if x[0] in (4, None)) and len(got) == 8
    assert all(x[1] in model.langs for x in got if x[0] in (5, 6))
    nothing = L.learn(df.where("doc_id < 3"))
    assert {r.lang_pred for r in L.identify(df, nothing, ["doc_id"]).collect()} == {"und"}
    assert L.identify(df.limit(0), model, ["doc_id"]).collect() == []
    big = base.unionByName(df.where("doc_id <= 3").selectExpr("doc_id", "text", "lang", "'s' AS source", "0L AS n_chars"))
    kept = L.accepted(big)
    assert kept.columns == base.columns and kept.count() == base.count()


def test_texts_stay_without_labels(spark):
    from tessera.llm.language_id import accepted

    rows = [(1, "some words"), (2, None), (3, ""), (4, "12 !?"), (5, "7 é"), (None, "x")]
    df = spark.createDataFrame([(i, t, None, 4) for i, t in rows], "doc_id long, text string, lang string, n_chars long")
    kept = accepted(df)
    assert kept.columns == df.columns and sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "some words"), ("5", "7 é"), ("None", "x")]
    assert accepted(df.limit(0)).collect() == []


def test_scripts_with_many_letters(spark):
    rnd = random.Random(5)
    scripts = {"el": (0x3B1, 24), "ru": (0x430, 32), "he": (0x5D0, 27), "hi": (0x915, 35), "en": (0x61, 26), "zh": (0x4E00, 3000), "ko": (0xAC00, 2500), "yi": (0xA000, 1100)}
    rows = []
    for lang, (first, n) in scripts.items():
        words = ["".join(chr(first + min(int(rnd.expovariate(8 / n)), n - 1)) for _ in range(rnd.randint(1, 6))) for _ in range(800)]
        rows += [(len(rows) + i, " ".join(rnd.choice(words) for _ in range(rnd.randint(20, 60))), lang) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = L.identify(df, L.learn(df), ["doc_id", "lang"]).collect()
    for lang in scripts:
        mine = [r for r in got if r.lang == lang and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
        assert mine and sum(r.lang_pred == lang for r in mine) >= 0.95 * len(mine), lang


def test_own_columns_stay(spark):
    rows = [(1, "some words", "en", 0.5, "x"), (2, None, "en", 0.25, "y"), (3, "more words", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    kept = L.accepted(df)
    assert kept.columns == df.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]
