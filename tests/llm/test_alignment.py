"""Operator 11 against a plain form that encodes whole texts and counts pair by pair."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from tessera.llm import alignment as A
from tessera.llm.queries import op11_alignment

SCHEMA = "doc_id long, text string, chunk int, doc string, b string"
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def pair():
    return A.Tokenizers(f"{A.TOKENIZERS}/{A.A_FILE}", f"{A.TOKENIZERS}/{A.B_FILE}")


def groups_of(t, text):
    """[(A ids, B ids)] of a text's groups, by the tokenizers themselves; none if the bytes differ."""
    if not text:
        return []
    a, b = t.whole.encode(" " + text, add_special_tokens=False).ids, t.pieces.encode(text)
    raw = (" " + text).encode()
    if b"".join(t.a_bytes[i] for i in a) != raw or b"".join(t.b_bytes[i] for i in b) != raw:
        return []
    out, i, j, x, y = [], 0, 0, 0, 0
    while i < len(a):
        xs, ys = [a[i]], [b[j]]
        x, y, i, j = x + len(t.a_bytes[a[i]]), y + len(t.b_bytes[b[j]]), i + 1, j + 1
        while x != y:
            if x < y:
                xs.append(a[i])
                x, i = x + len(t.a_bytes[a[i]]), i + 1
            else:
                ys.append(b[j])
                y, j = y + len(t.b_bytes[b[j]]), j + 1
        out.append((xs, ys))
    return out


def plain(t, rows):
    made = [(d, groups_of(t, text)) for d, text in rows]
    count = Counter((xs[-1], ys[-1]) for _, gs in made for xs, ys in gs)
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for d, gs in made:
        n = [count[xs[-1], ys[-1]] for xs, ys in gs]
        said = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in gs)
        best = sum(count[xs[-1], ys[-1]] == top[ys[-1]] for xs, ys in gs)
        out.append((d, sum(len(xs) for xs, _ in gs), sum(len(ys) for _, ys in gs), len(gs), len(gs), best, sum(n), sha256(said.encode()).hexdigest() if gs else ""))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def test_whole_table(spark, pair):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(op11_alignment(spark, sf)) == plain(pair, docs)


def odd_texts(seed=5):
    rnd = random.Random(seed)
    bits = ["a", "the", " ", "  ", "\n", "\t", "'s", "don't", "é", "日本語", "नमस्ते", "한국 말", " ", "　", " ", "\x85", "😀", "é", "<s>", "<|endoftext|>", "▁", "123", "!?", "\x00", "﻿", "ﬁ", " ", " "]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 40))) for _ in range(400)]


def test_odd_texts_and_edge_rows(spark, pair):
    texts = odd_texts() + [None, "", " ", "a", "a", "\n", "▁", " lead", "trail ", "a  b", "x" * 5_000, "word " * 3_000, " " * 5_000 + "x", "\n" * 3_000]
    rows = [(i % 50, t) for i, t in enumerate(texts)] + [(None, "null id"), (None, "null id")]
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA).repartition(3)
    got = rows_of(A.align(df))
    assert got == plain(pair, rows)
    assert any(r[1] == 0 for r in got) and any(r[5] < r[4] for r in got)
    assert A.align(df.limit(0)).count() == 0


def test_parts_of_long_texts_and_cells(spark, pair, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["the", "of", "an", "reverse", "token", "zq", "été"]) for _ in range(n))) for i, n in enumerate([3, 900, 40, 2_000, 7, 1_500])]
    rows += [(9, "fine words first " * 300 + "▁ and then one that does not come back"), (10, "the of " * 400)]
    monkeypatch.setattr(A, "CELL", 4)
    df = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], SCHEMA)
    assert rows_of(A.align(df, chunk=700)) == plain(pair, rows)


def test_both_encoders_agree(pair):
    texts = [" " + t for t in odd_texts(8)]
    assert pair.fast and pair.cuts
    assert [pair.fast.encode_ordinary(t) for t in texts] == [pair.whole.encode(t, add_special_tokens=False).ids for t in texts]
