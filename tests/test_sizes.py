"""Queries on odd and on larger inputs than the tables have."""

import random
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from test_queries import plain

from tessera.operators import chunking, memory, search
from tessera.plans import registry
from tessera.streaming import jobs


def test_query_analysis_on_odd_letters_and_blanks(spark, tmp_path):
    """Words and blanks are ASCII ones, as in the SQL: letters beyond them end a word."""
    texts = ["éagm and agmé", "the fee is due", " yes please", "\x0byes please", "hi　", "ſalam", "ſame", "ſure", "DİRECTOR and sdn. bhd and llp", "dırector agm", "Kan", "über dan atau", "日apa日", "company\x0blimited by guarantee", "éCLBG", "a company limited by guarantee", "", None]
    df = spark.createDataFrame([(i, n, t) for i, t in enumerate(texts) for n in (0, 1)], "conv_id long, turn long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = registry.queries()["query_analysis"](spark, str(tmp_path)).toPandas()
    assert plain(got) == plain(duck.sql(registry.oracle_sql()["query_analysis"]).df()) and got.followup.sum() >= 1


class Handle:
    """State of one key, list or map, whose calls are counted."""

    def __init__(self):
        self.rows, self.calls, self.timers = [], 0, set()

    def getListState(self, name, schema, ttl=None):
        return self

    getMapState = getListState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "get":
                return iter(self.rows)
            if name in ("put", "clear", "appendList"):
                self.rows = [*(self.rows if name == "appendList" else []), *(args[0] if args else [])]
            return bool(self.rows)

        return call


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_memories_take_a_users_state_once():
    """Calls to the state don't grow with a user's memories; later ends replace earlier ones or take them back."""
    handle, state = Handle(), jobs.Memories(None)
    state.init(handle)
    told = lambda frames: [r for f in frames for r in f[["id", "state"]].itertuples(index=False, name=None)]
    batch = lambda rows: iter([pd.DataFrame(rows, columns=["id", "ends"])])
    assert len(told(state.handleInputRows((7,), batch([(i, 1_000_000 * (i + 1) if i % 2 else None) for i in range(1_000)]), Now(0)))) == 1_000
    assert handle.calls < 10 and handle.timers == {2_000}
    state.handleInputRows((7,), iter([]), Now(0))
    assert told(state.handleInputRows((7,), batch([(1, None), (3, 9_000_000_000), (2, 3_000_000)]), Now(0))) == [(1, "kept"), (3, "kept"), (2, "kept")]
    assert told(state.handleExpiredTimer((7,), Now(6_500), None)) == [(5, "ended"), (2, "ended")]
    assert told(state.handleExpiredTimer((7,), Now(6_500), None)) == [] and 8_000 in handle.timers
    assert len(told(state.handleExpiredTimer((7,), Now(10**9), None))) == 498 and handle.rows == [] and handle.calls < 30


def test_memories_by_words_meet_lists_of_words_only(spark, monkeypatch):
    """Over many cells and ties as by comparing all pairs, which the plan does no more."""
    rnd = random.Random(2)
    text = lambda n: " ".join(f"w{min(60, int(rnd.paretovariate(0.6)))}" for _ in range(n))
    held = [("ab"[i % 2], i, rnd.choice(["longterm", "midterm"]), i // 3, text(rnd.randrange(12)) or None, None) for i in range(400)]
    asked = [(i, "abc"[i % 3], text(rnd.randrange(9)), [1.0]) for i in range(60)]
    r = spark.createDataFrame(held, "user string, memory_id long, tier string, seq long, content string, embedding array<float>")
    q = spark.createDataFrame(asked, "query_id long, user string, text string, embedding array<float>")
    monkeypatch.setattr(memory, "CELL", 30)
    for least in (0.1, 0.0):
        out = memory.rank(r.withColumn("seq", r.seq * 1000 + r.memory_id), q, least)
        want = []
        for i, user, words, _ in asked:
            w = set(words.split())
            mine = [(-len(w & set((c or "").split())) / max(len(w), 1) * 0.4, tier != "longterm", seq * 1000 + m, m) for u, m, tier, seq, c, _ in held if u == user]
            want += [(i, n, x[3], round(-x[0], 9)) for n, x in enumerate(sorted(x for x in mine if -x[0] >= least)[:3], 1)]
        assert sorted((x.query_id, x.rank, x.memory_id, round(x.score, 9)) for x in out.collect()) == sorted(want) != []
    assert "array_intersect" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_walked_chunks_are_handed_on_by_few(spark, monkeypatch):
    """Documents and their chunks don't wait as whole batches of Python objects."""
    monkeypatch.setattr(chunking, "HANDED_ON", 100)
    faq = "\n".join(f"Q: What of {i}?\nA: The answer to {i}." for i in range(50))
    act = "\n".join(f"Section {i}A. Of {i}\n{'what is to be done and by whom ' * 3}" for i in range(1, 50))
    docs = spark.createDataFrame([("f", "n", faq), ("a", "n", act), ("none", "n", None)], "source_key string, source_name string, text string")
    for parser, key, n in ((chunking.parse_faq, "f", 50), (chunking.parse_act, "a", 49)):
        out = parser(docs.where(docs.source_key.isin(key, "none")))
        assert "InPandas" not in out._jdf.queryExecution().toString()
        assert [(r.source_key, r.chunk_no) for r in out.orderBy("chunk_no").collect()] == [(key, i) for i in range(1, n + 1)]


def test_long_texts_are_cut_a_few_rows_at_a_time(spark):
    df = spark.createDataFrame([("a word. " * 400,), (None,), ("short",)], "t string").select(chunking.split_long_column("t").alias("p"))
    assert "ArrowEvalPython" not in df._jdf.queryExecution().toString() and [len(r.p) for r in df.collect()] == [3, 0, 0]


def test_scores_are_summed_where_a_chunks_postings_are(spark):
    """No row a query, chunk and word is shuffled."""
    chunks = spark.createDataFrame([("a", i, f"alpha beta w{i % 7}") for i in range(50)], "source_key string, chunk_no long, text string")
    asked = spark.createDataFrame([(1, "alpha w3 w3"), (2, "none")], "query_id long, text string")
    out = search.bm25(asked, chunks)
    assert "hashpartitioning(query_id" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.chunk_no: r.bm25 for r in out.collect()}
    assert len(got) == 50 and {c for c, v in got.items() if v > min(got.values()) + 1e-9} == {i for i in range(50) if i % 7 == 3}


def test_sets_go_to_cells_of_pairs(spark, monkeypatch):
    """A family of near copies, small, large and of mixed sizes, equals the comparison of all pairs, and no set is joined to a pair."""
    rnd = random.Random(5)
    texts = []
    for family, (size, copies) in enumerate([(6, 12), (40, 40), (300, 12), (500, 12), (530, 12), (1010, 8), (2100, 6)]):
        base = [f"f{family}w{i}" if i % 3 else f"c{rnd.randrange(2500)}" for i in range(size)]
        for _ in range(copies):
            some = [w if rnd.random() > 0.06 else rnd.choice([f"c{rnd.randrange(2500)}", ""]) for w in base]
            texts.append(" ".join(some + [f"x{rnd.randrange(10**9)}" for _ in range(rnd.randrange(1 + size // 9))]))
    texts += [texts[0], texts[30], " ".join(reversed(texts[30].split())), "", None, "one", "one two"]
    docs = [(i, t) for i, t in enumerate(texts)]
    rnd.shuffle(docs)
    df = spark.createDataFrame([*docs, docs[3]], "doc_id long, text string")  # one row twice
    classes = {}
    for i, t in sorted(docs):
        if t:
            classes.setdefault(frozenset(t.split()), i)
    sets = sorted((i, s) for s, i in classes.items())
    want = {(a, b): len(s & t) / len(s | t) for x, (a, s) in enumerate(sets) for b, t in sets[x + 1 :] if len(s & t) / len(s | t) > 0.8}
    assert len(want) > 200
    for paired in (search.PAIRED, 2_000):
        monkeypatch.setattr(search, "PAIRED", paired)
        out = search.near_duplicates(df)
        assert "array_intersect" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = [(r.a, r.b, r.jaccard) for r in out.collect()]
        assert len(got) == len(want) and {(a, b): j for a, b, j in got} == want
    assert search.near_duplicates(df.where("doc_id < 0")).collect() == []


def test_texts_become_sets_without_a_row_a_token(spark, monkeypatch):
    """Tokens are told apart and numbered by batch: no step lays out the tokens of texts, or of prefixes, as rows of Spark's."""
    plans, keep = [], search.store
    monkeypatch.setattr(search, "store", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    texts = ["One two THREE four five", "one two three four five six", "K\u00d6ln one-two:three four,five", "five four three two one one", "", None, "\u00e9\u00e9", "x y"]
    df = spark.createDataFrame([*enumerate(texts), (None, "x y"), (None, "one two three four five")], "doc_id long, text string")
    out = search.near_duplicates(df)
    assert [(r.a, r.b, r.jaccard) for r in out.collect()] == [(0, 1, 5 / 6)]
    assert len(plans) > 5 and not any("explode" in x or "regexp" in x for x in plans)


def test_coded_texts_equal_their_tokens(monkeypatch):
    """Whatever texts are coded together, and wherever they end, codes stand for the distinct tokens of each; rows read from a cut batch too."""
    rnd = random.Random(8)
    texts = ["", "ab", "cd", "", None, "-", "z" * 300, "a1 \u00e9b2\u00e9 a1", *("".join(rnd.choice("ab1 .\u00fc") for _ in range(rnd.randrange(40))) for _ in range(200)), "end"]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t and t.encode() for t in texts], pa.binary()), pa.array(range(1000, 1000 + len(texts)))], ["k", "t", "row"]).slice(1)
    want = {i: sorted(set(re.findall("[a-z0-9]+", t))) for i, t in enumerate(texts) if i and t and re.search("[a-z0-9]", t)}
    digests = None
    for together in (1, 100, 1 << 20):
        monkeypatch.setattr(search, "CODED", together)
        out = [r for b in search._coded(iter([rows, rows.slice(0, 0)])) for r in b.to_pylist()]
        term = {(r["batch"], r["code"]): r["term"] for r in out if r["code"] is not None}
        sets = [r for r in out if r["code"] is None]
        assert {r["k"]: [term[r["batch"], c] for c in np.frombuffer(r["codes"], np.int32)] for r in sets} == want and len(sets) == len(want)
        assert len({r["batch"] for r in sets}) > 1 or together > 100
        digests = digests or {r["k"]: r["digest"] for r in sets}
        assert digests == {r["k"]: r["digest"] for r in sets}
    assert len(set(digests.values())) == len({tuple(x) for x in want.values()})


def test_sets_meet_in_bands_of_their_sizes(monkeypatch):
    """Sets whose sizes may make a pair meet at their first number, in one place; others don't, however many have the number."""
    sizes = [*range(1, 60), 500, 511, 512, 640, 641, 1023, 1024, 1280, 4000, 5000]
    s = [np.arange(n, dtype=np.int32) for n in sizes]
    sets = pa.RecordBatch.from_arrays([pa.array(range(len(s))), pa.array(sizes, pa.int32()), pa.array([x.tobytes() for x in s], pa.binary())], ["k", "n", "s"])
    kept = None
    for least, most in ((0.8, 1 << 24), (0.8, 4_000), (0.5, 1 << 24), (0.999, 1 << 24)):
        monkeypatch.setattr(search, "HANDED_ON", most)
        a, b = ([r for x in search._prefixes(iter([sets]), least, np.dtype(np.int32), smaller) for r in x.to_pylist()] for smaller in (True, False))
        if least == 0.8:
            kept = kept or (a, b)
            assert all(sorted(map(str, x)) == sorted(map(str, y)) for x, y in zip(kept, (a, b)))
        at = lambda rows: {n: [r["place"] for r in rows if r["n"] == n and r["at"] == 1] for n in sizes}  # noqa: E731, B023
        small, large = at(a), at(b)
        for x in sizes:
            for y in sizes:
                met = len(set(small[x]) & set(large[y]))
                assert met == 1 if x <= y and y * least <= x else met <= 1
        if least == 0.8:
            assert sum(len(set(small[x]) & set(large[y])) for x in sizes for y in sizes if y * least**2 > x) == 0
            assert max(r["at"] for r in a if r["n"] == 4000) == 4000 - 3556 + 1 and max(r["at"] for r in b if r["n"] == 4000) == 801
            assert {r["at"]: r["before"] for r in b if r["n"] == 59}[7] == [2, 3, 4, 5]
