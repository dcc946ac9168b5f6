"""Operator 12 against a plain tree, and its SQL."""

import random
import zlib
from hashlib import sha256

import duckdb
from pyspark.sql import functions as F

from tessera.llm import queries as Q
from tessera.llm.manifest import manifest

NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], r[3], text)])


def climb(nodes, fanout=16):
    """The last node of a list and, for each place, its siblings (left, right) level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p // fanout * fanout
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + fanout])))
            at[i] = p // fanout
        level = [H(*level[i : i + fanout]) for i in range(0, len(level), fanout)]
    return level[0], paths


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {}
    for s in order:
        rs = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        made[s] = (rs, *climb([leaf(r, r[4]) for r in rs]))
    root, tops = climb([made[s][1] for s in order])
    out = []
    for s, top in zip(order, tops):
        rs, subroot, paths = made[s]
        for r, p in zip(rs, paths):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            h = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if hit else r[4])
            for left, right in p + top:
                h = H(left, h, right)
            out.append((r[0], leaf(r, r[4]), subroot, root, H(*[x + y for x, y in p + top]), h, h == root))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def query(df):
    low = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(df, {"text": F.when(hit, low).otherwise(F.col("text"))})


def test_whole_table_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    have = got(Q.op12_manifest(spark, sf))
    assert have == plain(rows) and any(not r[-1] for r in have)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    said = duckdb.sql(Q.oracle_sql()["op12_manifest"])
    at = [said.columns.index(n) for n in NAMES]
    assert sorted((tuple(r[i] for i in at) for r in said.fetchall()), key=str) == have


def test_deep_trees_many_groups_and_edge_rows(spark):
    rnd = random.Random(4)
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(900)] + [(i, f"s{i % 40}", None, None, "Ab" * rnd.randrange(3)) for i in range(1000, 1100)]
    rows += [(5000, None, "de", 3, None), (5001, "", "de", 3, "É"), (5002, "é", "de", 3, "Z"), (5003, "\U0001f600", "x", 1, "Q"), (None, "hot", "en", 1, "A"), (None, "hot", "en", 1, "B")]
    rows += [(7, "hot", "en", 7, "Text 7")] * 30 + [(6000, "long", "en", 9, "Word " * 200_000)]
    names = "doc_id long, source string, lang string, n_chars long, text string, g string, idx int, path string, h string"
    df = spark.createDataFrame([(*r, "g", 1, "p", "h") for r in rows], names).repartition(5)
    have = got(query(df))
    assert have == plain(rows) and {r[-1] for r in have} == {True, False}
    assert query(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "s", "en", 1, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    assert got(query(one)) == plain([(1, "s", "en", 1, "x")])
