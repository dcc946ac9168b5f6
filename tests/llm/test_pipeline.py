"""The pipeline against plain versions of its stages, on a small fixture and on the smallest tables."""

import random
from collections import defaultdict

import corpus_pipeline
import pytest
from test_decontamination import expected as plain_leaks
from test_line_dedup import expected as plain_lines
from test_mixing import plain_targets
from test_simhash_dedup import plain_components, plain_fingerprint


def plain_kept(rows, items):
    """(doc_id, text) that the first four stages keep; rows in order of their ids."""
    rows = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    rows = [(i, kept) for (i, t), (_, kept, _, n) in zip(rows, plain_lines(rows)) if not n or kept.strip(" \t\n\x0b\x0c\r")]
    prints = [plain_fingerprint(t) for _, t in rows]
    root, first = plain_components(prints), {}
    for (i, _), f in zip(rows, prints):
        first.setdefault(root[f], i)
    rows = [(i, t) for (i, t), f in zip(rows, prints) if first[root[f]] == i]
    leaks = {x[0] for x in plain_leaks(rows, items)}
    return [(i, t) for i, t in rows if i not in leaks]


def fixture():
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghi") for _ in range(rnd.randint(2, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(k, line(rnd.randint(20, 60))) for k in range(4)]
    shared = [line(n) for n in (5, 12, 30)]
    rows = [(0, None), (1, ""), (2, "123 !!!"), (3, shared[0])]
    for i in range(4, 90):
        parts = [line(rnd.randint(1, 40)) for _ in range(rnd.randint(1, 4))]
        if rnd.random() < 0.4:
            parts.insert(rnd.randrange(len(parts) + 1), rnd.choice(shared))
        if rnd.random() < 0.15:
            parts.append(line(8) + " " + rnd.choice(items)[1] + " " + line(3))
        rows.append((i, "\n".join(parts)))
    for i in range(90, 110):
        w = rows[rnd.randint(4, 89)][1].split(" ")
        if i % 2:
            w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows.append((200, " ".join(f"x{k}" for k in range(3000))))
    return rows, items


def test_run_matches_plain_stages(spark, tmp_path):
    rows, items = fixture()
    source = lambda i: None if i % 7 == 0 else f"s{i % 5}"
    spark.createDataFrame([(i, t, "en", source(i), len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
    want = plain_kept(rows, items)
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want) and len(want) < 100
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    text, sizes, took = dict(want), defaultdict(int), defaultdict(int)
    for i, t in want:
        sizes[source(i)] += len(t.split())
    goal = plain_targets(sizes)
    for r in got:
        assert r.text == text[r.doc_id] and r.copies in (1, 2) and r.taken == r.copies * r.size and r.target == pytest.approx(goal[r.source])
        took[r.source] += r.taken
    assert all(abs(took[s] - goal[s]) <= 0.1 * goal[s] + 30 for s in goal)


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).count() == docs.count()
    assert corpus_pipeline.run(spark, sf_dir).count() > 0


def test_empty_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_rows_without_an_id_of_their_own(spark, tmp_path):
    rnd = random.Random(8)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    stages = dict(corpus_pipeline.STAGES)
    near, leaks = (next(f for name, f in stages.items() if word in name) for word in ("near-dedup", "decontamination"))
    item, a, b, c, d = text(40), text(200), text(200), text(200), text(200)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = lambda df: sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)
    rows = [(None, a, "s"), (3, a, "s"), (4, a, "s"), (None, b, "s"), (None, b, "s"), (7, c, "t"), (7, c, "s"), (7, d, "s"), (7, d, "s"), (9, d, "s")]
    assert kept(near(spark, frame(rows), str(tmp_path))) == sorted([(3, a, "s"), (None, b, "s"), (7, c, "s"), (7, d, "s")], key=str)
    rows = [(None, f"{a} {item} {b}", "s"), (None, c, "s"), (5, f"{item} {b}", "s"), (5, d, "s"), (5, d, "s"), (6, None, "s")]
    df = leaks(spark, frame(rows), str(tmp_path))
    assert df.columns == ["doc_id", "text", "source"] and kept(df) == sorted([(None, c, "s"), (5, d, "s"), (5, d, "s"), (6, None, "s")], key=str)
