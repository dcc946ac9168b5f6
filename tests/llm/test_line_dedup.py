"""Operator 9 against a plain comparison of all line pairs."""

import random
import re


from tessera.llm import line_dedup as D


def words(line):
    return tuple(re.findall(r"[^\x20\x09-\x0D]+", line))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def expected(rows):
    """rows in order of earliness, each a document of its own."""
    seen, out = [], []
    for i, t in rows:
        kept, n = [], 0
        for line in (t or "").split("\n") if t else []:
            w = words(line)
            gone = bool(w) and any(w == v or (abs(len(w) - len(v)) < 2 and distance(w, v) <= min(1, max(len(w), len(v)) // D.PART)) for v in seen)
            if w:
                seen.append(w)
            n += gone
            if not gone:
                kept.append(line)
        out.append((i, "\n".join(kept), len((t or "").split("\n")) if t else 0, n))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 3, 4) for i, t in rows], "doc_id long, text string, gone int, n_lines int")
    got = D.without_lines(df, keep=["doc_id", "gone"]).collect()
    return sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_removed) for r in got), key=lambda r: (r[0] is not None, r[0] or 0))


def test_random_and_edge_rows(spark):
    rnd = random.Random(4)
    base = [[f"b{k}w{i}" for i in range(n)] for k, n in enumerate((3, 4, 5, 6, 9, 10, 12, 15, 40))]
    rows = [(None, "null id line"), (1, None), (2, ""), (3, "\n\n \n"), (4, "A  b\r\nnull id line"), (5, "a b\nA b"), (6, " ".join(f"x{i}" for i in range(900))), (7, " ".join(f"x{i}" for i in range(900) if i != 500) + "\nend é\x00")]
    for i in range(120):
        lines = []
        for _ in range(rnd.randint(1, 4)):
            w = list(rnd.choice(base))
            for _ in range(rnd.choice((0, 1, 1, 2))):
                k = rnd.randrange(len(w))
                op = rnd.randint(0, 2)
                w[k : k + 1] = [f"n{rnd.randint(0, 3)}"] if op == 0 else [] if op == 1 else [w[k], f"n{rnd.randint(0, 3)}"]
            lines.append(" ".join(w))
        rows.append((10 + i, "\n".join(lines)))
    assert run(spark, rows) == expected(rows)
    assert run(spark, []) == []


def test_exact_only_and_repeated_rows(spark):
    line = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"{line}\nown one"), (1, f"{line}\nown one"), (2, f"{line} more\nown two"), (3, line), (4, "")], "doc_id long, text string")
    assert sorted(r.n_removed for r in D.without_lines(df, fuzzy=False).collect()) == [0, 0, 0, 0, 1]
    kept = D.deduplicate(df.selectExpr("*", "length(text) AS n_chars", "'s' AS source"))
    assert sorted((r.doc_id, r.text, r.n_chars) for r in kept.collect()) == [(1, f"{line}\nown one", len(line) + 8)] * 2 + [(2, "own two", 7), (4, "", 0)]
    assert kept.columns == ["doc_id", "text", "n_chars", "source"]


def test_within_one_edit():
    assert all(D.within_one_edit(x.split(), y.split()) == (distance(x.split(), y.split()) <= 1) for x in ("a b c", "a b", "", "a c b", "b c", "a x c d") for y in ("a b c", "a c", "x", "a b c d", "a"))


def thue_morse(n, a, b):
    return [a if bin(i).count("1") % 2 == 0 else b for i in range(n)]


def test_contrived_words_and_lines_are_told_apart(spark):
    x, y = "".join(thue_morse(4096, "a", "b")), "".join(thue_morse(4096, "b", "a"))
    long, other = " ".join(thue_morse(1024, "no", "yes")), " ".join(thue_morse(1024, "yes", "no"))
    rows = [(1, x), (2, y), (3, long), (4, other), (5, f"{x} {long}"), (6, x[:1024]), (7, y[:1024]), (8, f"{y}\n{other}")]
    assert run(spark, rows) == expected(rows) and [r[3] for r in run(spark, rows)] == [0, 0, 0, 0, 1, 0, 0, 2]  # 5 is 3 with a word more


def test_one_rule_at_every_length(spark):
    rows = []
    for n in range(1, 14):
        w = [f"l{n}w{i}" for i in range(n)]
        rows += [(10 * n, " ".join(w)), (10 * n + 1, " ".join(["other", *w[1:]])), (10 * n + 2, " ".join([*w, "more"]))]
    assert run(spark, rows) == expected(rows)
    assert {r[0] for r in run(spark, rows) if r[3]} == {42} | {10 * n + k for n in range(5, 14) for k in (1, 2)}


def test_string_ids_and_own_columns(spark):
    line = " ".join(f"w{i}" for i in range(9))
    rows = [("b", f"{line}\nleft", 0.5, 7, "k"), ("a", f"{line} more", 0.25, 8, None), (None, "left", 0.75, 9, "e"), ("c", None, 1.0, 1, "n")]
    df = spark.createDataFrame(rows, "doc_id string, text string, score double, n_lines int, kept_text string")
    got = {r.doc_id: tuple(r) for r in D.deduplicate(df.withColumn("emptied", df.n_lines)).collect()}
    assert got == {"a": ("a", f"{line} more", 0.25, 8, None, 8), None: (None, "left", 0.75, 9, "e", 9), "c": ("c", None, 1.0, 1, "n", 1)}
