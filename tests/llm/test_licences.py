"""Operator 2: base phrases against a plain search, templates, and edge rows."""

import random
import re

from tessera.llm import licences as L
from tessera.llm.queries import op2_licences

NAMES = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(doc_id, text):
    w = words(text)
    at = [(i, label) for p, label in L.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return (doc_id, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    want = sorted(plain(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = op2_licences(spark, sf).collect()
    assert sorted(tuple(r[n] for n in NAMES) for r in got) == want and any(x[2] for x in want)
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and (r.score > 0) == (r.labels != "")


def test_templates_and_edge_rows(spark):
    rnd = random.Random(8)
    vocabulary = L._vocabulary()[0]
    notice = {label: text for label, text, _ in L.TEMPLATES}
    rows = [(1, None), (2, ""), (3, "..."), (4, "the MIT\n\tLicense, mit-license mit licenses xmit license"), (5, "mit " * 3 + "license"), (6, "é mit license\x00apache LICENSE")]
    rows += [(7, "General Public License " * 3), (None, "apache license"), (7, "General Public License " * 3), (8, "x " * 50_000 + "mit license")]
    rows += [(100 + i, " ".join(rnd.choice(vocabulary[:40] + ["mit", "license", "apache", "general", "public"]) for _ in range(300))) for i in range(30)]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, n_words int, labels string")
    got = L.scan(df).collect()
    assert sorted((tuple(r[n] for n in NAMES) for r in got), key=str) == sorted((plain(i, t) for i, t in rows), key=str)
    made = spark.createDataFrame([(i, f"Some lead words. {text.upper()} and more") for i, (_, text) in enumerate(sorted(notice.items()))], "doc_id long, text string")
    for r in L.scan(made).collect():
        assert sorted(notice)[r.doc_id] in r.labels.split(",") and r.score == 1.0
    bsd = notice["bsd"].split()
    near = bsd[:12] + ["other"] + bsd[13:]
    broken = ["x" if i == 3 else w for i, w in enumerate(bsd)]  # the key phrase isn't whole
    two = spark.createDataFrame([(1, " ".join(near)), (2, " ".join(broken))], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in L.scan(two).collect()} == {1: "bsd", 2: ""}
    assert L.scan(df.limit(0)).collect() == []


def test_places_without_the_rarest_words(spark):
    text = {label: t for label, t, _ in L.TEMPLATES}["bsd"]
    changed = ("provided", "conditions", "met")
    rarity = {w: 9.0 if w in changed else 1.0 for w in L._vocabulary()[0]}
    altered = " ".join("other" if w in changed else w for w in text.split())
    r = L.scan(spark.createDataFrame([(1, f"lead in {altered} end")], "doc_id long, text string"), rarity).first()
    assert "bsd" in r.labels.split(",") and r.score >= L.COVERAGE


def plain_labels(text):
    """Every position of every template is tried."""
    w, labels, best = words(text), set(), 0.0
    for label, passage, key in [(b, p, p) for p, b in L.BASE] + L.TEMPLATES:
        p, k = passage.split(), key.split()
        at = next(i for i in range(len(p)) if p[i : i + len(k)] == k)
        for i in range(-len(p), len(w)):
            if i + at >= 0 and w[i + at : i + at + len(k)] == k:
                cover = sum(0 <= i + j < len(w) and w[i + j] == x for j, x in enumerate(p)) / len(p)
                if cover >= L.COVERAGE:
                    labels.add(label)
                    best = max(best, cover)
    return ",".join(sorted(labels)), best


def test_labels_match_a_scan_of_all_positions(spark):
    rnd = random.Random(11)
    rows = []
    for _, passage, _ in L.TEMPLATES * 6:
        w = passage.split()
        for _ in range(rnd.randint(0, len(w) // 3)):
            w[rnd.randrange(len(w))] = rnd.choice(["other", "license", "software", "public"])
        rows.append((len(rows), " ".join(rnd.choice(L._vocabulary()[0]) for _ in range(rnd.randint(0, 3))) + " " + " ".join(w[rnd.choice((0, 0, 0, 2)) :])))
    want = {i: plain_labels(t) for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rarity in (None, {w: -float(len(w)) for w in L._vocabulary()[0]}):
        got = {r.doc_id: (r.labels, r.score) for r in L.scan(df, rarity).collect()}
        assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
        assert all(abs(got[i][1] - want[i][1]) < 1e-9 for i in got)
    assert len({x[0] for x in want.values()}) > 15
