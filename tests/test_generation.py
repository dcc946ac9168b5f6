"""Prompts, retries and model-driven chunking, with stand-in models; the command line."""

import json

from pyspark.sql import functions as F

from tessera import cli
from tessera.functions.models import FixedAnswer, Parallel, complete_all
from tessera.operators import generation as G
from tessera.sources import extract


class Counting:
    def __init__(self, answers):
        self.answers = list(answers)

    def complete(self, prompt, system=""):
        return self.answers.pop(0)


def test_answers_are_tried_once_more():
    ok = "A whole answer that is long enough."
    assert G.answers(Counting([ok]), ["p"]) == [ok]
    assert G.answers(Counting(["short", ok]), ["p"]) == [ok]
    assert G.answers(Counting(["This one breaks off in the middle,", "❌ error"]), ["p"])[0].endswith("middle,")
    assert G.answers(Counting(["❌ error"]), ["p"]) == ["❌ error"]


class Server:
    """Answers by prompt; the first time of some it breaks off. What was asked is noted."""

    def __init__(self):
        self.asked = []

    def complete(self, prompt, system=""):
        self.asked.append(prompt)
        return "broken off," if int(prompt) % 3 == 0 and self.asked.count(prompt) == 1 else f"The whole answer to prompt number {prompt}."


def test_batches_are_asked_together():
    prompts, want = [str(i) for i in range(40)], [f"The whole answer to prompt number {i}." for i in range(40)]
    together = Server()
    assert G.answers(Parallel(together, 4), prompts) == want and G.answers(Server(), prompts) == want
    assert len(together.asked) == 54 and sorted(together.asked[40:], key=int) == prompts[::3]  # the broken ones once more, after all
    assert complete_all(Parallel(Server()), []) == [] and Parallel(FixedAnswer("a")).complete("p") == "a"


def test_prompt_blocks(spark):
    ranked = spark.createDataFrame([(1, 2, "B", "visual", "second"), (1, 1, "A", "text", "first")], "query_id int, rank int, source_name string, chunk_type string, text string")
    context = G.context_block(ranked)
    assert context.first().context == "[SOURCE: A]\nfirst\n[/SOURCE: A]\n\n[SOURCE: B | VISUAL CONTENT]\nsecond\n[/SOURCE: B]"
    p = context.select("query_id", G.prompt(F.lit("why?"), F.col("context"), F.lit("H\n"), F.lit(None).cast("string"), F.lit("")).alias("prompt"))
    text = p.first().prompt
    assert text.startswith("H\n<<CONTEXT_BLOCK>>") and text.index("first") < text.index("<<USER_QUESTION>>\nwhy?")
    assert G.generate(p, FixedAnswer("An answer that is long enough to stay.")).first().response.startswith("An answer")


def test_rewrite_and_classify(spark):
    q = spark.createDataFrame([(1, "is it due", 1, "h"), (2, "what are filing costs", 1, "h"), (3, "is it due", 0, "")], "query_id int, text string, turns_before int, history string")
    got = {r.query_id: r.text for r in G.rewrite(q, FixedAnswer("is the return due")).collect()}
    assert got == {1: "is the return due", 2: "what are filing costs", 3: "is it due"}
    c = G.classify(q, FixedAnswer('{"action": "hold_agm", "confidence": 0.8, "likely_sections": [340]}'), "t").where("query_id = 2").first()
    assert (c.action, c.confidence, c.likely_sections) == ("hold_agm", 0.8, ["340"])
    r = G.reflect(spark.createDataFrame([("a", "q", "r")], "qa_id string, query string, response string"), FixedAnswer('<think>x</think>{"root_agent": "retrieval", "suggested_sections": ["46"]}')).first()
    assert (r.root_agent, r.suggested_intent, r.suggested_sections) == ("retrieval", "", ["46"])


def test_chunks_by_model(spark):
    long = "A sentence of a page that is long enough to be kept as a chunk by itself."
    docs = spark.createDataFrame([("k", "n", f"{long} {long}"), ("s", "n", "short")], "source_key string, source_name string, text string")
    good = FixedAnswer("```json\n" + json.dumps([{"section": "1", "content": long}, {"content": "short"}]) + "\n```")
    assert [(r.source_key, r.section, r.content) for r in G.chunks_by_model(docs, good).collect()] == [("k", "1", long)]
    assert [r.content for r in G.chunks_by_model(docs, FixedAnswer("no json")).collect()] == [f"{long} {long}"]
    assert [r.content for r in G.chunks_by_model(docs, FixedAnswer('[{"content": "' + long + '"}, {"content": "cut')).collect()] == [long]

    class Reads:
        def read(self, image, mime):
            return image.decode()

    images = spark.createDataFrame([("i", "n", "image/png", long.encode()), ("j", "n", "image/png", b"few words")], "source_key string, source_name string, mime string, content binary")
    assert [r.source_key for r in G.chunks_of_images(images, Reads(), FixedAnswer("no json")).collect()] == ["i"]
    seen = G.describe(images.withColumnRenamed("source_key", "id"), Reads()).collect()
    assert {r.id: r.description for r in seen} == {"i": long, "j": ""}


def test_acquire():
    calls = []

    def slow(url):
        calls.append(url)
        if len(calls) < 3:
            raise TimeoutError
        return b"x"

    assert extract.acquire(b"l", "u", slow) == b"l" and extract.acquire(None, None, slow) is None and not calls
    assert extract.acquire(None, "u", slow) == b"x" and len(calls) == 3


def test_command_line(spark, tmp_path):
    for f in ("FAQ/others/a.pdf", "FAQ/others/b.csv", "FAQ/notes/c.pdf"):
        (tmp_path / "src" / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / f).write_bytes(b"x")
    text = "A sentence that is long enough to be kept as a chunk by itself, of a file."
    spark.createDataFrame([("a", text), ("b", "short")], "key string, text string").write.parquet(f"{tmp_path}/texts")
    run = lambda **k: sorted((r.key, r.status) for r in cli.process(spark, f"{tmp_path}/src", f"{tmp_path}/texts", f"{tmp_path}/out", **k).collect())
    assert run() == [("a", "ok"), ("b", "failed")]
    assert run() == [("a", "skipped"), ("b", "failed")]
    assert run(force=True, key="a") == [("a", "ok")]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_command_line_reads_tables_and_presentations(spark, tmp_path):
    from small_cases import _deck
    from tessera.sources import registry

    long = "A row of a table that is long enough to be kept as a chunk by itself."
    files = {"FAQ/others/t.csv": f'Title,Content\nOne,"{long}"\nTwo,short\n'.encode(), "FAQ/others/u.csv": b"a,b\n1,2\n", "FAQ/slide/deck one.pptx": _deck()}
    for name, content in files.items():
        (tmp_path / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / name).write_bytes(content)
    sources = registry.enabled(registry.discover(spark, f"{tmp_path}/src"))
    assert [(r["key"], r.slide_number, r.title) for r in registry.read_presentations(spark, sources).orderBy("slide_number").collect()] == [("deck_one", 1, "Fees of names"), ("deck_one", 2, ""), ("deck_one", 3, "Table")]
    spark.createDataFrame([], "key string, text string").write.parquet(f"{tmp_path}/texts")
    report = cli.process(spark, f"{tmp_path}/src", f"{tmp_path}/texts", f"{tmp_path}/out")
    assert sorted((r.key, r.status, r.n) for r in report.collect()) == [("deck_one", "ok", 1), ("t", "ok", 1), ("u", "failed", 0)]  # one slide has 60 characters, with its notes
    assert sorted((r.section, r.section_title) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [("", "One"), ("Slide 3: Table", "Table")]
