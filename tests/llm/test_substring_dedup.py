"""Operator 4 against a plain reading of its contract."""

import hashlib
import random
import re
from collections import Counter

from tessera.llm.substring_dedup import without_repeats


def expected(rows, k):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {j + o for j in range(len(w) - k + 1) if seen[tuple(w[j : j + k])] > 1 for o in range(k)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def run(spark, rows, k):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, th int, spans int")
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in without_repeats(df, k, with_text=True).collect()), key=str)


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    p = " ".join(f"p{i}" for i in range(35))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, f"x {p} y"), (6, f"z\t{p}\nü"), (7, p[:-1]), (8, f"{p} {p}"), (9, long), (9, long), (None, "same " * 36), (10, "same " * 80), (11, long + " more")]
    assert run(spark, rows, 35) == expected(rows, 35)
    assert run(spark, [], 35) == []


def test_random_texts_with_few_words(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("ab" if i % 3 else "abcdefgh") for _ in range(rnd.randint(0, 60)))) for i in range(200)]
    base = [" ".join(f"t{rnd.randint(0, 10**6)}" for _ in range(80)) for _ in range(5)]
    for i in range(60):  # near copies: one word changed
        w = base[i % 5].split()
        w[rnd.randrange(80)] = "changed"
        rows.append((1000 + i, " ".join(w[rnd.randint(0, 9) :])))
    for k in (8, 11):
        assert run(spark, rows, k) == expected(rows, k)


def test_contrived_words_are_told_apart(spark):
    turned = lambda n, a, b: "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))
    rows = []
    for n in (1024, 4096):
        other = " ".join(f"n{n}w{i}" for i in range(34))
        rows += [(n, f"{turned(n, 'a', 'b')} {other}"), (n + 1, f"{turned(n, 'b', 'a')} {other}"), (n + 2, f"own {turned(n, 'a', 'c')} {other}")]
    rows += [(9000, turned(1024, "no ", "yes ")), (9001, turned(1024, "yes ", "no "))]  # whole texts of two words: windows repeat
    assert run(spark, rows, 35) == expected(rows, 35)
    assert all(r[2] == 0 for r in run(spark, rows, 35) if r[0] < 9000)
