"""Operator 8 against a plain reading of its contract."""

import re

import xxhash

from tessera.llm.components import components
from tessera.llm.queries import op8_simhash_dedup
from tessera.llm.simhash_dedup import deduplicate, links, near_duplicates


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    distinct = sorted(parent)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin(a ^ b).count("1") <= 3:
                parent[find(a)] = find(b)
    return {f: find(f) for f in distinct}


def expected(rows):
    fp = [(i, plain_fingerprint(t)) for i, t in rows]
    root = plain_components([f for _, f in fp])
    low = {}
    for i, f in fp:
        if i is not None:
            low[root[f]] = min(i, low.get(root[f], i))
    return sorted(((i, f"{f:016x}", low.get(root[f])) for i, f in fp), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_whole_table_matches_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(op8_simhash_dedup(spark, sf_dir)) == expected(rows)


def test_edge_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one two"), (6, "ONE two"), (7, long), (8, long), (8, long), (None, "one two"), (9, "é\x00ü ñ x \x85 z")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, component string")
    near = near_duplicates(df)
    out = sorted(((r.id, f"{r.fp & (2**64 - 1):016x}", r.component) for r in near.collect()), key=str)
    assert out == expected(rows)
    kept = deduplicate(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(["1", "4", "5", "7", "9", "None"])
    assert deduplicate(df).columns == df.columns
    assert near_duplicates(df.limit(0)).collect() == []


def test_links_keep_components_in_split_blocks(spark, monkeypatch):
    import random

    from tessera.llm import simhash_dedup

    monkeypatch.setattr(simhash_dedup, "BLOCK", 8)
    rnd, fps = random.Random(5), []
    for _ in range(6):
        c = rnd.getrandbits(64)
        fps += [c] + [c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 5))) for _ in range(60)]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    edges = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in links(df).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in edges)
    want = plain_components(fps)
    parent = {f: f for f in want}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = lambda m: sorted(sorted(f for f in m if m[f] == r) for r in set(m.values()))
    assert groups({f: find(f) for f in parent}) == groups(want)


def test_components_of_a_long_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(7, 7), (200, 300), (300, 200)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 300: 200}
    assert components(df.limit(0)).collect() == []
