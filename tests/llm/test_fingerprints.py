"""Operator 5 against a plain reading of the contract and of closed syncmers."""

import hashlib
import random
import re
import struct

import pytest
import xxhash

from tessera.llm import fingerprints as P
from tessera.llm.queries import op5_fingerprints


def xx(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else struct.pack("<Q", p), seed)
    return seed


def plain_sketch(text):
    h = [xx(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if len(h) < P.K:
        found = {xx(*h) >> 32} if h else set()
    else:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        s = [signed(xx(a, b)) for a, b in zip(h, h[1:])]
        found = {xx(*h[i : i + P.K]) >> 32 for i in range(len(h) - P.K + 1) if min(s[i : i + 4]) in (s[i], s[i + 3])}
    return sorted(found)[: P.SKETCH]


def plain_likeness(a, b):
    u = sorted(set(a) | set(b))[: P.SKETCH]
    return len(set(u) & set(a) & set(b)) / len(u) if u else 1.0


def expected(rows):
    rows = [(i, t or "") for i, t in rows]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = []
    for j, (i, t) in enumerate(order):
        nxt = order[(j + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, e, n = plain_sketch(t), plain_sketch(edited), plain_sketch(nxt)
        show = lambda k: "".join(f"{x:08x}" for x in k)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), show(a), show(e), pytest.approx(plain_likeness(a, e)), pytest.approx(plain_likeness(a, n))))
    return out


def got(df):
    rows = sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0), reverse=True)
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in rows]


def test_whole_table(spark, sf_dir, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    monkeypatch.setattr(P, "BUCKET_ROWS", 7)  # many buckets, so that next documents lie across their bounds
    assert got(op5_fingerprints(spark, sf_dir)) == expected(rows)


@pytest.mark.parametrize("bucket", [1, 4, 1000])
def test_edge_rows(spark, monkeypatch, bucket):
    monkeypatch.setattr(P, "BUCKET_ROWS", bucket)
    rnd = random.Random(2)
    rows = [(-5, "a b c d e f g h"), (0, None), (3, ""), (4, " "), (1 << 62, "é ü ñ 漢字 x"), (9, "one"), (None, "null id text here with words"), (77, " ".join(str(rnd.random()) for _ in range(30_000))), *[(100 + i, " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 30)))) for i in range(20)]]
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, bucket int, next_id string")
    assert got(P.fingerprints(df)) == expected(rows)
    assert P.fingerprints(df.limit(0)).collect() == []
    same = spark.createDataFrame([(1, "x y z")] * 3 + [(2, "x y z")], "doc_id long, text string")
    assert {(r.n_chars, r.near_edited > 0, r.near_next) for r in P.fingerprints(same).collect()} <= {(5, True, 1.0), (5, False, 1.0)}
    assert len(P.fingerprints(same).collect()) == 4


def test_shared_passages_by_position(spark):
    words = [f"w{i}" for i in range(80)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "lead in " + " ".join(words[10:60]))], "doc_id long, text string")
    found = P.shared_passages(df.where("doc_id = 1"), df).collect()
    assert [(r.left_id, r.right_id, r["shift"]) for r in found] == [(1, 2, -8)] and found[0].n > 10


def plain_anchors(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = set(plain_all(text))
    if len(w) < P.K:
        return [(0, xx(*[xx(x) for x in w]) >> 32)] if w else []
    at = [(i, xx(*[xx(x) for x in w[i : i + P.K]]) >> 32) for i in range(len(w) - P.K + 1)]
    return [(i, a) for i, a in at if a in found]


def plain_all(text):
    was, P.SKETCH = P.SKETCH, 1 << 40
    try:
        return plain_sketch(text)
    finally:
        P.SKETCH = was


def test_all_anchors_count_with_their_positions(spark):
    rnd = random.Random(9)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    shared = words(60)
    texts = {9: words(1500) + shared + words(900), 8: words(200) + shared + words(3000), 7: words(2500), 6: ["one", "two"], 5: ["one", "two"], 4: [], 3: ["same"] * 600, 2: ["x"] + ["same"] * 599}
    texts = {i: " ".join(w) for i, w in texts.items()}
    rows = {r.doc_id: r for r in P.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, r in rows.items():
        mine, nxt = plain_anchors(texts[i]), plain_anchors(texts[r.next_id])
        half = len(texts[i]) // 2
        edited = plain_anchors(texts[i][: len(texts[i]) - half] + texts[r.next_id][:half])
        assert [tuple(x) for x in r.anchors] == mine
        for other, part, shift, n in ((edited, r.share_edited, r.shift_edited, r.aligned_edited), (nxt, r.share_next, r.shift_next, r.aligned_next)):
            a, b = {x for _, x in mine}, {x for _, x in other}
            assert part == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
            assert (shift is None) == (not a & b) and n == (0 if shift is None else len({(p + shift, x) for p, x in mine} & set(other)))
    assert rows[9].next_id == 8 and rows[9].shift_next == -1300 and rows[9].aligned_next > 20 and len(rows[9].anchors) > 1000
    assert rows[8].shift_edited == 0 and rows[6].aligned_next == 1 and rows[7].aligned_next == 0 and rows[3].shift_next == 1


def next_of(rows):
    """The multiset of (text, next text) where documents stand by id descending, then by the text's hash descending."""
    signed = lambda t: (lambda x: x - (1 << 64) if x >> 63 else x)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(rows, key=lambda r: (r[0] if r[0] is not None else P.LEAST_ID, signed(r[1])), reverse=True)
    return sorted((r[1], order[(j + 1) % len(order)][1]) for j, r in enumerate(order))


def test_hot_ids_are_cut_and_keep_their_order(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 3)
    monkeypatch.setattr(P, "GROUP_BITS", 1)
    rows = [(7, f"seven {i}") for i in range(90)] + [(8, "the same text")] * 70 + [(None, f"none {i}") for i in range(60)]
    rows += [(10**12 + i, f"crowd {i}") for i in range(80)] + [(i * 10**15, f"wide {i}") for i in range(-20, 20)] + [((1 << 63) - 1, "last"), (-(1 << 63) + 1, "first")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = P.with_next(df)
    sizes = [r["count"] for r in dealt.where("copy = 0").groupBy("bucket").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= P.HOT * 3 and dealt.count() - len(rows) == len(sizes)
    w = P.Window.partitionBy("bucket").orderBy("copy", *[P.F.col(c).desc() for c in ("id", "th", "u")])
    found = dealt.withColumn("nt", P.F.lead("text").over(w)).where("copy = 0").select("text", "nt").collect()
    assert sorted(tuple(r) for r in found) == next_of(rows)
    with pytest.raises(TypeError):
        P.fingerprints(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
