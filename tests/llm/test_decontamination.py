"""Operator 6 against a plain search of all windows."""

import pickle
import random
import re
import string
from collections import Counter

import numpy as np
import pytest

from tessera.llm import decontamination as D
from tessera.llm.queries import op6_decontamination


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def shingles(w):
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def expected(docs, items):
    out = []
    for item_id, text in items:
        b = words(text)
        if not b:
            continue
        sb = shingles(b)
        for doc_id, t in docs:
            a = words(t)
            if not a or (len(b) < 5 and len(a) < len(b)) or not set(shingles(a) if len(b) >= 5 else {tuple(a[i : i + len(b)]) for i in range(len(a))}) & set(sb):
                continue
            n, best = min(len(a), len(b)), (0.0, 0)
            for i in range(len(a) - n + 1):
                sa = shingles(a[i : i + n])
                best = max(best, (sum((sa & sb).values()) / sum((sa | sb).values()), -i))
            if best[0] >= 0.8:
                out.append((doc_id, item_id, -best[1], n, round(best[0], 9)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.item_id, r.first_word, r.n_words, round(r.similarity, 9)) for r in df.collect()), key=str)


def test_whole_table(spark, sf_dir):
    read = lambda t, k: [(r[k], r.text) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()]
    want = expected(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert want and got(op6_decontamination(spark, sf_dir)) == want


@pytest.mark.parametrize("block", [200, 10**6])
def test_edge_rows(spark, block):
    rnd = random.Random(6)
    pool = [f"w{i}" for i in range(400)]
    item = lambda n: [rnd.choice(pool) for _ in range(n)]
    items = [(i, item(n)) for i, n in enumerate([60, 60, 30, 12, 5, 5, 80])]
    items += [(20, "Only three words".split()), (21, []), (22, ["same"] * 40)]
    docs = [(1, None), (2, ""), (3, "..."), (4, "x only THREE words, y"), (5, "same " * 45), (6, " ".join(items[4][1][:4]))]
    for i in range(60):
        k = rnd.randrange(7)
        w = list(items[k][1])
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = "changed"
        docs.append((100 + i, " ".join(item(rnd.randint(0, 50)) + w[: len(w) - rnd.randint(0, 3)] + item(rnd.randint(0, 50))).upper()))
    docs.append((None, " ".join(items[0][1])))
    docs += [docs[-2]]
    docs.append((900, " ".join(item(20_000) + items[1][1])))
    items = [(i, " ".join(w)) for i, w in items] + [(30, None)]
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    found = got(D.contaminated(d, b, block))
    assert found == expected(docs, items)
    kept = D.decontaminate(d, b)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs if i is None or i not in {f[0] for f in found}}
    assert D.contaminated(d.limit(0), b).collect() == [] and D.contaminated(d, b.limit(0)).collect() == []


def test_many_short_items_stay_small_and_few_are_compared():
    rnd = random.Random(3)
    pool = ["".join(rnd.choice(string.ascii_lowercase) for _ in range(5)) for _ in range(3000)]
    items = [(i, " ".join(rnd.choice(pool) for _ in range(9)), 1) for i in range(150_000)]
    model = D.prepare(items)
    assert len(pickle.dumps(model)) < 60_000_000
    text = " ".join(rnd.choice(pool) for _ in range(5000)) + " " + items[77][1]
    raw = np.frombuffer(text.encode(), np.uint8)
    s = D.K.window_hashes(D.K.Words(raw, np.array([0, len(raw)]), D.K.NON_WORD).hashes(lower=True), D.SHINGLE)
    _, rare = D._rare_hits(model, s, np.ones(len(s), bool))
    assert len(D._postings(model, np.unique(rare))) < 0.01 * len(items)  # for all windows together
    assert {i: b[0] for i, b in D._search(model, s, 5009, rare).items()} == {77: 1.0}


def test_blocks_name_every_item_in_the_radius_and_few_others(monkeypatch):
    rnd = np.random.default_rng(4)
    pool = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rnd.choice(pool, 12 if i % 10 else 13)), 1) for i in range(12_000)]
    model = D.prepare(items)
    flip = np.zeros((400, 64), np.uint8)
    for i, row in enumerate(flip):
        row[rnd.choice(64, i % 40, replace=False)] = 1
    prints = model.prints[rnd.integers(0, len(items), 400)] ^ np.packbits(flip, axis=1).view(np.uint64).ravel()
    for n in (12, 13, 14):  # more items than values within a block's radius, fewer, and none
        of = np.flatnonzero(model.n_words == n)
        bits = np.bitwise_count(prints[:, None] ^ model.prints[of][None, :])
        want = {(int(x), int(of[y]), int(bits[x, y])) for x, y in zip(*np.nonzero(bits <= D.RADIUS))}
        which, item, differ = D.within_radius(model, prints, n)
        assert set(zip(which.tolist(), item.tolist(), differ.tolist())) == want and len(which) == len(want)
        assert n == 14 or want
        named = D.named(model, prints, n)
        assert len(named[0]) <= 0.25 * len(prints) * len(of)
        with monkeypatch.context() as one_by_one:
            one_by_one.setattr(D, "PROBES", 1)
            assert [c.tolist() for c in D.within_radius(model, prints[:20], n)] == [c[which < 20].tolist() for c in (which, item, differ)]


def test_items_come_from_the_blocks():
    rnd = random.Random(5)
    pool = [f"w{i}" for i in range(2000)]
    items = [(i, " ".join(rnd.choice(pool) for _ in range(40)), 1) for i in range(50)]
    model = D.prepare(items)
    raw = np.frombuffer(items[7][1].encode(), np.uint8)
    s = D.K.window_hashes(D.K.Words(raw, np.array([0, len(raw)]), D.K.NON_WORD).hashes(lower=True), D.SHINGLE)
    _, rare = D._rare_hits(model, s, np.ones(len(s), bool))
    assert {i: b[0] for i, b in D._search(model, s, 40, rare).items()} == {7: 1.0}
    model.tables = [(keys[:0], of[:0]) for keys, of in model.tables]
    assert D._search(model, s, 40, rare) == {}


def test_string_ids_and_repeated_items(spark):
    item = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([("a", f"x {item} y"), (None, item), ("b", "none")], "doc_id string, text string")
    b = spark.createDataFrame([("k", item), ("k", item), (None, item)], "item_id string, text string")
    assert got(D.contaminated(d, b)) == sorted([(i, k, p, 30, 1.0) for i, p in (("a", 1), (None, 0)) for k in ("k", "k", None)], key=str)
