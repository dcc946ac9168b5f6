"""Unit tests of what the queries don't show: splitting, state, extraction, index files, models, learned corrections."""

import json
import random
import re
from datetime import datetime

from pyspark.sql import functions as F

from tessera.functions import models
from tessera.functions import responses as R
from tessera.functions import text as T
from tessera.functions.vectors import similarities, unit
from tessera.operators import chunking, feedback, memory, search, store
from tessera.sources import extract, registry


def test_split_long_keeps_text_and_bounds():
    rnd = random.Random(1)
    for _ in range(50):
        text = " ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 9))) + rnd.choice(["", "", ".", "!"]) for _ in range(rnd.randint(1, 900)))
        pieces = chunking.split_long(text, 300)
        assert all(len(p) <= 300 for p in pieces) and re.sub(r"\s", "", "".join(pieces)) == re.sub(r"\s", "", text)
    assert chunking.split_long("x" * 700, 300) == ["x" * 300, "x" * 300, "x" * 100]
    assert len(chunking.split_long("[TABLE] " + "a b. " * 500)) == 1 and len(chunking.split_long("a | b | c | d | e. " * 500)) == 1


def test_other_chunks_and_visual_blocks():
    para = "A sentence of some length, to be packed. " * 60
    text = para + "[VISUAL DESCRIPTION]\n" + "A picture of a chart that shows the fees of several years, as bars.\n[/VISUAL DESCRIPTION]" + para
    got = list(chunking.other_chunks(text))
    assert [g["section"].split()[0] for g in got].count("Visual") == 1 and all(len(g["content"]) <= 1200 for g in got)
    assert [int(g["section"].split()[1]) for g in got] == list(range(1, len(got) + 1))
    assert list(chunking.other_chunks("short")) == []


def test_router_and_report(spark):
    text = "OBJECTIVE\n" + "Words enough to make a chunk of this heading, and some more. " * 2
    s = spark.createDataFrame([("g", "G", "general"), ("o", "O", "others"), ("e", "E", "act")], "key string, name string, doc_type string")
    t = spark.createDataFrame([("g", text), ("o", text), ("e", "nothing")], "key string, text string")
    chunks, report = registry.process(s, t)
    assert {(r.source_key, r.section) for r in chunks.collect()} == {("g", "OBJECTIVE"), ("o", "Section 1"), ("o", "Section 2")}  # cut at the last sentence end
    assert {(r.status, tuple(r["keys"])) for r in registry.report_lists(report).collect()} == {("ok", ("g", "o")), ("failed", ("e",))}


def test_table_functions(spark):
    chunking.register(spark)
    rows = spark.sql("SELECT d.id, c.section FROM VALUES (1, 'Q: What is it?\\nA: This.') AS d(id, text), LATERAL parse_faq(d.text) AS c").collect()
    assert [(r.id, r.section) for r in rows] == [(1, "")]
    assert spark.sql("SELECT size(split_long(repeat('word ', 700))) AS n").first().n == 3


def test_text_functions(spark):
    row = spark.createDataFrame([("a–b “c” -LRB-d-RRB- incor-\nporated  x\r\n\r\n\r\n\r\ny ",)], "t string")
    assert row.select(T.clean_text(F.col("t"))).first()[0] == 'a-b "c" (d) incorporated x\n\ny'
    s = spark.createDataFrame([("[OCR PAGE 3]\nx[TABLE]\ny\n\n\n\nz",)], "t string")
    assert s.select(T.sanitize(F.col("t"))).first()[0] == "xy\n\nz"
    d = spark.createDataFrame([("a b c d e f g h i j k l m n o p q r s t",), ("This is a plain sentence of common words. And another one follows.",)], "t string")
    assert [r[0] for r in d.select(T.looks_like_diagram(F.col("t"))).collect()] == [True, False]
    p = spark.createDataFrame([(" ".join(f"Sentence number {i} ends here." for i in range(60)),)], "t string")
    pages = p.select(T.pack_sentences(F.col("t"), 200)).first()[0]
    assert all(len(x) <= 200 for x in pages) and " ".join(pages) == p.first().t
    q = spark.createDataFrame([("  What  IS it?! ",), ("what is it",)], "t string")
    assert len({r[0] for r in q.select(T.query_hash(F.col("t"))).collect()}) == 1
    assert spark.createDataFrame([(["a", "<think>no", "</think>b"],)], "p array<string>").select(T.visible_tokens(F.col("p"))).first()[0] == "ab"
    assert [r[0] for r in spark.createDataFrame([(100,), (9_000,), (99_000,)], "n int").select(T.context_size(F.col("n"))).collect()] == [2048, 2560, 8192]
    assert spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(unit(F.col("v"))).collect()[0][0] == [0.6, 0.8]


def test_pages_to_text(spark):
    native = "Native text of a page. " * 6
    read = lambda b: [{"page": 1, "native": native, "tables": extract.table_text([["a", None], ["b", "c"]])}, {"page": 2, "native": "head", "ocr": "scanned words"}, {"page": 3, "native": " "}]
    files = spark.createDataFrame([("p", b"x")], "path string, content binary")
    pages = extract.read_pages(files, read)
    got = extract.assemble(pages).first()
    assert got.text == native + "\n[TABLE]\na | \nb | c\n[/TABLE]\n" + "\n\n[VISUAL DESCRIPTION]\nhead\nscanned words\n[/VISUAL DESCRIPTION]\n" and not got.needs_fallback
    assert "[OCR PAGE 2]\nhead\nscanned words" in extract.assemble(pages, False).first().text
    assert extract.assemble(pages.where("page = 3")).first().needs_fallback


def test_chunk_files_and_external_tables(spark, tmp_path):
    rows = [("k", "n", "", "", "", "S", "T", 'multi\nline "quoted" text'), ("k", "n", "", "", "", "", "", "second")]
    spark.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], chunking.CHUNK_SCHEMA).coalesce(1).transform(lambda d: registry.write_chunks_csv(d, f"{tmp_path}/c") or d)
    back = registry.read_chunks(spark, f"{tmp_path}/c").orderBy("chunk_no").collect()
    assert [(r.section, r.content) for r in back] == [("S", rows[0][-1]), ("", "second")]
    ext = spark.createDataFrame([("x" * 70, "t", None), ("short", "t", "u"), ("y" * 60, None, "u")], "Body string, Title string, Section_Title string")
    got = registry.external_chunks(ext, "k", "n").collect()
    assert [(r.section_title, len(r.content)) for r in got] == [("t", 70), ("u", 60)]


def test_index_files_status_and_cache(spark, tmp_path):
    chunks = spark.createDataFrame([("s1", 1, "the fee is due", "A" * 50, None, None), ("s2", 1, "another text", "B" * 50, "7", "P")], "source_key string, chunk_no long, text string, content string, section string, part string").withColumn("section_title", F.lit(None).cast("string"))
    idx = search.index_chunks(chunks)
    assert [r.text for r in idx.orderBy("source_key").collect()] == ["A" * 50, "7 (P)\n\n" + "B" * 50]
    search.build_index(chunks.select("source_key", "chunk_no", "text"), f"{tmp_path}/i")
    search.build_index(chunks.where("source_key = 's1'").select("source_key", "chunk_no", F.lit("new words").alias("text")), f"{tmp_path}/i")
    tables = search.load_index(spark, f"{tmp_path}/i")
    assert {r.term for r in tables["postings"].collect()} == {"new", "words", "another", "text"}
    sources = spark.createDataFrame([(k, k != "off") for k in ("a", "b", "c", "d", "off")], "key string, enabled boolean")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    got = search.index_status(sources, keys("a", "b").withColumn("version", F.when(F.col("key") == "x", 2).otherwise(3)), keys("c"), keys("a"))
    assert {r.key: r.status for r in got.collect()} == {"a": "ready", "b": "cached", "c": "not_indexed", "d": "needs_preprocess"}
    texts = spark.createDataFrame([(1, "same words"), (2, "same words"), (3, " "), (4, "others")], "id int, text string")
    cache = spark.createDataFrame([("none", [1.0])], "digest string, embedding array<float>")
    made = search.embed(texts, cache, models.HashedWords())
    assert {r.id for r in made.collect()} == {1, 2, 4} and made.select("digest").distinct().count() == 2
    again = search.embed(texts, made.select("digest", "embedding").distinct(), models.HashedWords())
    assert again.count() == 3


def test_hybrid_options(spark):
    chunks = spark.createDataFrame([("s", 1, "fee of a company limited by guarantee", "5", [1.0, 0.0]), ("s", 2, "fee of a company", "6", [0.8, 0.6]), ("s", 3, "nothing near", "6", [0.0, 1.0]), ("t", 1, "fee of a company", "8", [0.8, 0.6])], "source_key string, chunk_no long, text string, section string, embedding array<double>")
    q = spark.createDataFrame([(1, "fee", "en", [1.0, 0.0]), (2, "yuran", "ms", [1.0, 0.0]), (3, "clbg fee", "en", [1.0, 0.0])], "query_id long, text string, lang string, embedding array<double>")
    got = {(r.query_id, r.source_key, r.chunk_no): round(r.score, 3) for r in search.hybrid(q, chunks).collect()}
    assert got[2, "s", 1] == 0.4 and got[2, "s", 2] == 0.8 and got[3, "s", 1] > got[3, "s", 2] and (1, "s", 3) not in got
    found = search.search(q, chunks).where("query_id = 1").orderBy("rank").collect()
    assert len({r.text for r in found}) == len(found) and [r.rank for r in found] == list(range(1, len(found) + 1))
    boosts = q.where("query_id = 2").select(T.query_hash(F.col("text")).alias("query_hash"), F.lit("section 6").alias("section_parent"), F.lit(0.15).alias("delta"))
    boosted = {(r.query_id, r.source_key, r.chunk_no): round(r.score, 3) for r in search.hybrid(q, chunks, boosts=boosts).collect()}
    assert boosted[2, "s", 2] == 0.95 and boosted[2, "t", 1] == 0.8
    src = spark.createDataFrame([("s", "S", "FAQ", True, ["LLP Act 2012"]), ("t", "T", "FAQ", True, []), ("u", "U", "FAQ", False, [])], "key string, name string, category string, enabled boolean, relates_to_acts array<string>")
    asked = spark.createDataFrame([(1, "companies act fee"), (2, "fee")], "query_id long, text string")
    assert {(r.query_id, r.source_key) for r in search.prune_sources(asked, src).collect()} == {(1, "t"), (2, "s"), (2, "t")}
    cited = search.summary(search.search(q, chunks), src).where("query_id = 2").first()
    assert cited.citations == ["S", "T"] or cited.citations == ["S"]


def test_learned_corrections(spark):
    at = datetime(2024, 1, 1)
    over = spark.createDataFrame([("hold_agm", "f1", "F", 0.5, False, 1, 0, at)], "intent_action string, form_id string, form_name string, confidence double, locked boolean, confirmed_positive long, confirmed_negative long, ts timestamp")
    fixes = spark.createDataFrame([], "query_hash string, action string, ts timestamp")
    notes = spark.createDataFrame([], "key string, type string, correct_intent string, example_query string, patch_text string, ts timestamp")
    bad = spark.createDataFrame([("How to  hold it?", "hold_agm", "f1", at), ("add it", "register_company", None, at), ("x", "no_such_action", "f", at)], "query string, suggested_intent string, form_id string, ts timestamp")
    o, c, n = feedback.correct_mapping(feedback.count_negatives(over, bad.select("form_id").na.fill("")), fixes, notes, bad)
    assert {(r.intent_action, r.form_id, r.confirmed_negative) for r in o.collect()} == {("hold_agm", "f1", 1), ("register_company", "", 0)}
    assert {r.action for r in c.collect()} == {"hold_agm", "register_company"} and n.count() == 2
    up = feedback.reinforce(o, c, bad.where("suggested_intent = 'hold_agm'").select(T.query_hash(F.col("query")).alias("query_hash")))
    assert {(r.intent_action, r.locked) for r in up.collect()} == {("hold_agm", True), ("register_company", False)}
    boosts = spark.createDataFrame([], "query_hash string, section_parent string, reason string, ts timestamp, delta double, section_child string")
    made = feedback.correct_retrieval(boosts, spark.createDataFrame([("q", ["Section 46", "s. 46", "58"], at)], "query string, suggested_sections array<string>, ts timestamp"))
    assert {(r.section_parent, r.delta) for r in made.collect()} == {("46", 0.15), ("58", 0.15)}
    fb = spark.createDataFrame([("a", at, "", 1), ("a", datetime(2024, 1, 2), "", 1), ("b", at, "other", 1)], "qa_id string, ts timestamp, failure_type string, rating int")
    back = feedback.write_back(fb, spark.createDataFrame([("a", "incomplete"), ("b", "incorrect")], "qa_id string, failure_type string"))
    assert sorted((r.qa_id, r.failure_type) for r in back.collect()) == [("a", ""), ("a", "incomplete"), ("b", "other")]
    turns = spark.createDataFrame([("t", "strike off my company", "It was cut off before completion", []), ("u", "hello", "Yes.", [])], "qa_id string, query string, response string, shown array<string>")
    got = {r.qa_id: (r.root_agent, r.suggested_intent, r.failure_type) for r in feedback.negative_pipeline(turns).collect()}
    assert got == {"t": ("form_mapping", "strike_off_company", "incomplete"), "u": ("unknown", "", "other")}


def test_history_and_memory_blocks(spark):
    turns = spark.createDataFrame([(1, i, f"question {i}", "An answer of some length. " * 12) for i in range(1, 9)], "session int, turn int, query string, response string")
    block = memory.history_block(turns, budget=900).first()
    assert len(block.block) <= 900 and "question 8" in block.block and "question 2" not in block.block and block.kept < 6
    only = memory.history_block(turns.where("turn = 1"), budget=10).first()
    assert only.kept == 1 and only.block.count("─" * 40) == 2
    chosen = spark.createDataFrame([(1, 2, "correction", "b"), (1, 1, "preference", "a")], "query_id int, rank int, memory_type string, content string")
    assert "  Your preference: a\n  Your correction: b\n" in memory.memory_block(chosen).first().block
    chat = spark.createDataFrame([("s", 2, "q2", "r2"), ("s", 1, "q1", "r1")], "session string, seq int, query string, response string")
    assert memory.conversation_text(chat).first().text.startswith("User: q1\nAssistant: r1\n\nUser: q2")


def test_state_versions(spark, tmp_path):
    path = f"{tmp_path}/state"
    assert store.load_state(spark, path, "a int").count() == 0
    for v in (1, 2, 10):
        store.save_state(spark.createDataFrame([(v,)], "a int"), path, v)
    assert [r.a for r in store.load_state(spark, path, "a int").collect()] == [10]


def test_models_and_json():
    assert models.accept_rewrite("q", "<think>x</think> a longer query ") == "a longer query" and models.accept_rewrite("q", "ab") == "q"
    assert models.accept_description("too few words") == "" and models.FixedAnswer("a").complete("p") == "a" and models.Unseeing().read(b"", "") == ""
    assert models.HashedWords().embed(["", "a"])[0] is None
    assert R.repair_json('{"a": "b\tc\\d"}') == json.dumps({"a": "b\tc\\d"}) and R.repair_json("{") is None and R.repair_json(None) is None


def test_query_ids_of_any_type(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "vec_id long, embedding array<double>")
    got = similarities([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], rows, 0.5, ["vec_id"]).collect()
    assert sorted((r.query_id, r.vec_id, round(r.cosine, 6)) for r in got) == [("a", 1, 1.0), ("b", 1, 0.6), ("b", 2, 0.8)]
    assert similarities([], rows, 0.5, ["vec_id"]).collect() == []


def test_suppression_walks_users_in_order(spark):
    at = datetime(2024, 1, 1)
    rows = [("a", at, i, f"w{i % 3} x y z") for i in range(40)] + [("b", at, 0, "w0 x y z"), (None, at, 0, "w0 x y z"), (None, at, 1, "x w0 y z"), ("c", at, 0, ""), ("c", at, 1, "")]
    got = memory.suppress_repeats(spark.createDataFrame(rows, "user string, ts timestamp, pos int, content string")).collect()
    assert sorted(((r.user or "", r.pos) for r in got)) == [("", 0), ("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0), ("c", 1)]
