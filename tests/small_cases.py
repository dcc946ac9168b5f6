"""Queries over small invented tables for what the input tables can't show: readers, models, learned state, files, streams.

Expected rows are worked out by hand from the rules, as in fixtures.
"""

from __future__ import annotations

import io
import json
import zipfile
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import responses as R
from tessera.functions import text as T
from tessera.functions.models import FixedAnswer, HashedWords
from tessera.functions.vectors import unit
from tessera.operators import chunking, feedback, forms, memory, search, store
from tessera.operators import generation as G
import small_tables as fixtures
from small_tables import _P, _forms, _texts
from tessera.session import scratch
from tessera.sources import extract
from tessera.sources import registry as sources
from tessera.streaming import jobs

QUERIES: list[tuple] = []
AT = datetime(2024, 1, 1)


def expect(columns: str, rows: list[tuple], **types: str):
    def mark(f):
        QUERIES.append((f, fixtures.expected_sql(columns, rows, **types)))
        return f

    return mark


def sql(text: str):
    def mark(f):
        QUERIES.append((f, text))
        return f

    return mark


def _one_line(c) -> F.Column:
    return F.replace(c, F.lit("\n"), F.lit("/"))


class Decodes:
    """Reads an image that is its own text."""

    def read(self, image: bytes, mime: str) -> str:
        return image.decode()


class Halves:
    """Another image at half the size: what stands after the bar."""

    def __call__(self, image: bytes) -> bytes:
        return image.split(b"|")[-1]


class SlowHost:
    """Answers a URL `slow:n` after n time-outs."""

    def __init__(self):
        self.calls: dict[str, int] = {}

    def __call__(self, url: str) -> bytes:
        self.calls[url] = self.calls.get(url, 0) + 1
        if self.calls[url] <= int(url.split(":")[1]):
            raise TimeoutError
        return f"after {self.calls[url]}".encode()


# ---- sources and readers ----


@expect("key, name, category, type, doc_type, enabled", [("a", "a", "", "pdf", "act", True), ("b", "Bee", "FAQ", "csv", "faq", False), ("c", "c", "", "pdf", "act", True)])
def override_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON file with a note, a comment, an entry without a key, and a type that doesn't exist."""
    entries = [{"key": "a"}, {"_note": "n", "key": "n"}, {"key": "b", "name": "Bee", "category": "FAQ", "type": "csv", "doc_type": "faq", "enabled": False}, {"_comment": "c"}, {"name": "no key"}, {"key": "c", "type": "docx"}]
    path = scratch(spark)
    spark.createDataFrame([(json.dumps({"sources": entries}),)], "value string").coalesce(1).write.text(path)
    return sources.overrides(spark, path).select("key", "name", "category", "type", "doc_type", "enabled")


_SEVEN = ["Legislations", "Practice Notes", "Practice Directives", "Guidelines", "Circular", "FAQ", "Forms"]


@expect("category, names", [("FAQ", "A,B"), ("Own", "E"), *[(c, "") for c in _SEVEN if c != "FAQ"]])
def category_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("B", "FAQ", True), ("A", "FAQ", True), ("C", "Forms", False), ("E", "Own", True)]
    return sources.by_category(spark.createDataFrame(rows, "name string, category string, enabled boolean")).select("category", F.array_join("names", ",").alias("names"))


@expect("source_key, chunk_no, section, content", [("k", 1, "S", 'multi/line "quoted", text'), ("k", 2, "", "second"), ("l", 1, "", "third")], chunk_no="BIGINT")
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("k", "n", "", "", "", "S", "T", 'multi\nline "quoted", text'), ("k", "n", None, "", "", None, "", "second"), ("l", "n", "", "", "", "", "", "third")]
    path = scratch(spark)
    sources.write_chunks_csv(spark.createDataFrame([(*r, i) for i, r in enumerate(rows, 1)], chunking.CHUNK_SCHEMA).coalesce(1), path)
    return sources.read_chunks(spark, path).select("source_key", "chunk_no", "section", _one_line("content").alias("content"))


@expect("source_key, part, section_title, n", [("k", "P", "t", 70), ("k", "", "u", 60), ("k", "", "s", 61)])
def external_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by any of their names, the content of 60 characters or more without the blanks around it."""
    rows = [("x" * 70, "t", None, None, "P"), ("x" * 59, "t", "u", "s", "P"), ("y" * 60, None, "u", None, None), (f"  {'z' * 61}\n", "t", "u", "s", ""), (None, "t", "u", "s", "P")]
    df = spark.createDataFrame(rows, "Body string, Title string, Section_Title string, Subsection string, Part string")
    return sources.external_chunks(df, "k", "n").select("source_key", "part", "section_title", F.length("content").alias("n"))


def _deck() -> bytes:
    """A presentation of three slides, whose order is not that of their files; the second is empty."""
    a, p, r = ("http://schemas.openxmlformats.org/" + x for x in ("drawingml/2006/main", "presentationml/2006/main", "officeDocument/2006/relationships"))
    names = f'xmlns:a="{a}" xmlns:p="{p}" xmlns:r="{r}"'
    para = lambda *runs: "<a:p>" + "".join(f"<a:r><a:t>{x}</a:t></a:r>" for x in runs) + "</a:p>"
    shape = lambda kind, *paras: "<p:sp><p:nvSpPr><p:nvPr>" + (f'<p:ph type="{kind}"/>' if kind else "") + "</p:nvPr></p:nvSpPr><p:txBody>" + "".join(paras) + "</p:txBody></p:sp>"
    cell = lambda x: f"<a:tc><a:txBody>{para(x)}</a:txBody></a:tc>"
    table = f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr>{cell('Item')}{cell('Fee')}</a:tr><a:tr>{cell('Name')}{cell('RM 50')}</a:tr><a:tr>{cell('')}{cell('')}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    slide = lambda inner: f"<p:sld {names}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"
    rels = lambda *links: "<Relationships xmlns='http://schemas.openxmlformats.org/package/2006/relationships'>" + "".join(f"<Relationship Id='{i}' Type='{r}/{t}' Target='{x}'/>" for i, t, x in links) + "</Relationships>"
    files = {
        "ppt/presentation.xml": f"<p:presentation {names}><p:sldIdLst><p:sldId id='1' r:id='rId3'/><p:sldId id='2' r:id='rId1'/><p:sldId id='3' r:id='rId2'/></p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": rels(("rId1", "slide", "slides/slide1.xml"), ("rId2", "slide", "slides/slide2.xml"), ("rId3", "slide", "slides/slide3.xml")),
        "ppt/slides/slide3.xml": slide(shape("ctrTitle", para("Fees", " of names")) + shape("", para("First line"), para(" "), para("second &amp; last")) + shape("body", para("Another box"))),
        "ppt/slides/slide1.xml": slide(""),
        "ppt/slides/slide2.xml": slide(shape("title", para("Table")) + table),
        "ppt/slides/_rels/slide2.xml.rels": rels(("rId1", "notesSlide", "../notesSlides/notesSlide1.xml")),
        "ppt/notesSlides/notesSlide1.xml": f"<p:notes {names}><p:cSld><p:spTree>{shape('sldNum', para('3'))}{shape('body', para('Say this'))}</p:spTree></p:cSld></p:notes>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


@expect("key, slide_number, title, body, tables, notes", [
    ("k", 1, "Fees of names", "First line/second & last//Another box", "", ""), ("k", 2, "", "", "", ""), ("k", 3, "Table", "", "[TABLE]/Item | Fee/Name | RM 50/[/TABLE]", "Say this"),
])
def slide_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A presentation, and a file that is none."""
    df = extract.read_slides(spark.createDataFrame([("k", _deck()), ("bad", b"no archive")], "key string, content binary"))
    return df.select("key", "slide_number", "title", *[_one_line(c).alias(c) for c in ("body", "tables", "notes")])


@expect("key, text", [("long", "one two three four five six seven eight nine ten|"), ("short", "the half-size image has more words on it"), ("none", "")])
def image_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("long", b"one two three four five six seven eight nine ten|"), ("short", b"few words|the half-size image has more words on it"), ("none", b"")]
    return extract.read_images(spark.createDataFrame([(k, "image/png", c) for k, c in rows], "key string, mime string, content binary"), Decodes(), Halves())


@expect("id, description", [(0, "a chart of fees by year"), (1, ""), (2, "")])
def visual_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five words at least, reasoning not counted."""
    rows = [b"<think>so</think> a chart of fees by year", b"only four words here", b"<think>five words or even more</think>few"]
    return G.describe(spark.createDataFrame([(i, "image/png", c) for i, c in enumerate(rows)], "id int, mime string, content binary"), Decodes())


@expect("source_key, section, content", [("i", "", _P), ("j", "1", "Chunk that a model cut out of an image, long enough to be kept as it is.")])
def image_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image's text whole where the model's answer can't be read, its chunks where it can; too little text gives none."""
    rows = lambda *r: spark.createDataFrame([(k, "n", "image/png", c.encode()) for k, c in r], "source_key string, source_name string, mime string, content binary")
    answer = json.dumps([{"section": "1", "content": "Chunk that a model cut out of an image, long enough to be kept as it is."}, {"content": "short"}])
    df = G.chunks_of_images(rows(("i", _P), ("few", "few words")), Decodes(), FixedAnswer("no json")).unionByName(G.chunks_of_images(rows(("j", _P)), Decodes(), FixedAnswer(answer)))
    return df.select("source_key", "section", "content")


@expect("key, text", [("local", "mine"), ("slow", "after 3"), ("gone", None), ("neither", None)])
def fetched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The local copy first, three attempts at a URL, nothing after that."""
    rows = [("local", b"mine", "slow:0"), ("slow", None, "slow:2"), ("gone", None, "slow:3"), ("neither", None, None)]
    return extract.fetch_files(spark.createDataFrame(rows, "key string, content binary, url string").coalesce(1), SlowHost()).select("key", F.col("content").cast("string").alias("text"))


_NATIVE = "Native text of a page. " * 5


@expect("path, text, needs_fallback", [
    ("mixed", f"{_NATIVE}T//[VISUAL DESCRIPTION]/head/scanned/[/VISUAL DESCRIPTION]/", False), ("little", "few", True), ("table", "few[TABLE]", False), ("seen", "[VISUAL DESCRIPTION]/read/[/VISUAL DESCRIPTION]/", False),
    ("drawn", f"{_NATIVE}//[VISUAL DESCRIPTION]/a chart/[/VISUAL DESCRIPTION]", False),
])
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the order of their numbers: native text of 100 characters, else what was read, else what little there is."""
    rows = [("mixed", 2, "head", "", "scanned", ""), ("mixed", 1, _NATIVE, "T", "", ""), ("mixed", 3, " ", "", "", ""), ("little", 1, "few", "", "", ""), ("table", 1, "few", "[TABLE]", "", ""), ("seen", 1, "", "", "read", ""), ("drawn", 1, _NATIVE, "", "", "a chart")]
    df = extract.assemble(spark.createDataFrame(rows, "path string, page int, native string, tables string, ocr string, visual string"))
    return df.select("path", _one_line("text").alias("text"), "needs_fallback")


@expect("id, diagram", [(0, True), (1, False), (2, True), (3, True), (4, True), (5, False)])
def diagram_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ["too short a text", "This is a plain sentence of common words. And another one follows.", "a b c d e f g h i j k l m n o p q r s t u v", "---- ==== ---- ==== ---- ==== abc ==== ---- ====", "word " * 31, "word " * 29 + "end. Go"]
    return _texts(spark, rows).select("id", T.looks_like_diagram(F.col("text")).alias("diagram"))


_HEADED = f"OBJECTIVE\n{_P}"


@expect("key, status, n, section", [
    ("p_general", "ok", 1, "OBJECTIVE"), ("p_faq", "ok", 1, "GENERAL FEES"), ("p_slide", "ok", 1, "Section 1"), ("p_others", "ok", 1, "Section 1"), ("p_odd", "failed", 0, None), ("csv", "ok", 2, "S"), ("csv_none", "failed", 0, None),
    ("deck", "ok", 1, "Slide 1: T"), ("scan", "ok", 1, ""), ("zip", "failed", 0, None), ("p_short", "failed", 0, None),
], n="BIGINT")
def source_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of every type and doc_type through their readers, those without input or of unknown kinds too."""
    rows = [("p_general", "pdf", "general"), ("p_faq", "pdf", "faq"), ("p_slide", "pdf", "slide"), ("p_others", "pdf", "others"), ("p_odd", "pdf", "novel"), ("csv", "csv", "act"), ("csv_none", "csv", "act"), ("deck", "pptx", "slide"), ("scan", "image", "others"), ("zip", "zip", "act"), ("p_short", "pdf", "general")]
    s = spark.createDataFrame([(k, k, t, d) for k, t, d in rows], "key string, name string, type string, doc_type string")
    texts = spark.createDataFrame([("p_general", _HEADED), ("p_faq", "GENERAL FEES\nQ: Is there a fee?\nA: Yes."), ("p_slide", _P), ("p_others", _P), ("p_odd", _P), ("csv", _P), ("zip", _P), ("p_short", "short")], "key string, text string")
    table = spark.createDataFrame([("csv", "csv", "", "", "", "S", "", _P, 1), ("csv", "csv", "", "", "", "S", "", _P, 2), ("deck", "deck", "", "", "", "S", "", _P, 1)], ", ".join(f"{c} string" for c in chunking.CHUNK_COLUMNS) + ", row_no long")
    slides = spark.createDataFrame([("deck", 1, "T", _P, "", "")], "key string, slide_number int, title string, body string, tables string, notes string")
    images = spark.createDataFrame([("scan", "image/png", _P.encode())], "key string, mime string, content binary")
    chunks, report = sources.process(s, texts, table, slides, images, Decodes(), FixedAnswer("no json"))
    return report.join(chunks.groupBy(F.col("source_key").alias("key")).agg(F.max("section").alias("section")), "key", "left").select("key", "status", "n", "section")


@expect("status, keys", [("failed", "b,d"), ("ok", "a,c")])
def process_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.createDataFrame([(k, k, "general") for k in "dcba"], "key string, name string, doc_type string")
    _, report = sources.process(s, spark.createDataFrame([("a", _HEADED), ("b", "short"), ("c", _HEADED)], "key string, text string"))
    return sources.report_lists(report).select("status", F.array_join("keys", ",").alias("keys"))


@expect("source_key, chunk_no, section", [("a", 1, "Section 1"), ("a", 2, "Section 2"), ("f", 1, "HEAD"), ("g", 1, "OBJECTIVE"), ("z", 1, "Lodgement of documents"), ("o", 1, "Section 1"), ("o", 2, "Section 2")], chunk_no="BIGINT")
def parse_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of every type in one table, an unknown type among them; each one's chunks in order."""
    docs = [("a", "act", f"1. Short title\n{_P}\n2. Words\n{_P}"), ("f", "faq", "HEAD\nQ: What is it?\nA: An answer."), ("g", "general", _HEADED), ("z", "gazette", f"IN exercise of the powers\nLodgement of documents\n1. {_P}"), ("o", "others", f"{'x' * 1200}{_P}"), ("u", "novel", _P)]
    return chunking.parse(spark.createDataFrame([(k, k, d, t) for k, d, t in docs], "source_key string, source_name string, doc_type string, text string")).select("source_key", "chunk_no", "section")


@expect("path, version", [("latest", 10), ("none", 0)], version="BIGINT")
def state_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions 1, 2 and 10 are written; the last one is read. Where nothing was written there are no rows."""
    path = scratch(spark)
    for v in (1, 2, 10):
        store.save_state(spark.createDataFrame([(v,)], "a int").coalesce(1), path, v)
    read = lambda name, p: store.load_state(spark, p, "a int").agg(F.lit(name).alias("path"), F.coalesce(F.max("a"), F.lit(0)).cast("long").alias("version"))
    return read("latest", path).unionByName(read("none", scratch(spark)))


_LINES = [
    ("", "blank"), ("Short title ........ 12", "toc"), ("  14 ", "page"), ("P.U. (A) 37", "pu"), ("Laws of Malaysia ACT 777", "laws"), ("NOTE-see below", "note"), ("2 PN 3/2018", "pn"), ("PART B_v2", "faq_footer"),
    ("Peraturan 4. Yuran", "reg_toc"), ("WARTA KERAJAAN", "gazette_header"), ("COMPANIES ACT 2016", "gazette_header"), ("(3) Fee", "gazette_header"), ("Made 2 January", "signing"), ("[/table]", "table_tag"), ("PART IV", "part"),
    ("Part 2A", "part"), ("part in the management", "text"), ("DIVISION 3A", "division"), ("Subdivision 2", "subdivision"), ("Section 14A. Forming", "section"), ("12. Title", "section"), ("GENERAL FEES", "caps"), ("B. Later forms", "lettered"),
    ("Appendix 1", "appendix"), ("Schedule II", "appendix"), ("Para 3 on fees", "para"), ("paragraph 12", "para"), ("plain words", "text"),
]


@expect("id, class", [(i, c) for i, (_, c) in enumerate(_LINES)])
def line_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, [x for x, _ in _LINES]).select("id", chunking.line_class(T.strip(F.col("text"))).alias("class"))


# ---- text ----


@expect("id, pos, n", [(0, 0, 1499), (0, 1, 1499), (0, 2, 599), (1, 0, 1500), (1, 1, 1500), (1, 2, 100), (2, 0, 5005), (3, 0, 1499), (3, 1, 501), (4, 0, 5000)])
def long_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut after a sentence, within a word, never in a table, at a blank, never in rows with bars; pieces of under 60 characters go."""
    rows = ["a" * 98 + ". " + ("b" * 98 + ". ") * 35, "x" * 3100, "[TABLE]" + "a b. " * 999 + "abc", ("w" * 99 + " ") * 20 + "y" * 2, "a|b|c|d|" * 625]
    rows[0], rows[3] = rows[0][:3600].strip(), rows[3][:2001]
    return _texts(spark, rows).select("id", F.posexplode(chunking.split_long_column("text")).alias("pos", "piece")).select("id", "pos", F.length("piece").alias("n"))


@expect("id, text", [(0, "xy//z"), (1, "a b"), (2, "")])
def sanitized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ["[OCR PAGE 3]\nx[TABLE]\ny\n\n\n\nz[/SPEAKER NOTES]", " a b￿\n", "[IMAGE TEXT]\n[/IMAGE TEXT]"]
    return _texts(spark, rows).select("id", _one_line(T.sanitize(F.col("text"))).alias("text"))


@expect("id, text", [(0, '{"a": 1}'), (1, "b"), (2, "no blocks"), (3, "<think>open")])
def reasoning_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ['<think>x\ny</think>\n```json\n{"a": 1}\n```', "<THINK>a</THINK> b ", "no blocks", "<think>open"]
    return _texts(spark, rows).select("id", T.strip_reasoning(F.col("text")).alias("text"))


@expect("id, text", [(0, "ab"), (1, "a"), (2, "whole")])
def stream_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, ["a", "<thi", "nk>no", "</think>", "b"]), (1, ["a", "<think>", "never closed"]), (2, ["who", "le"])]
    return spark.createDataFrame(rows, "id int, parts array<string>").select("id", T.visible_tokens(F.col("parts")).alias("text"))


@expect("chars, answer, chunking", [(0, 2048, 1024), (100, 2048, 1024), (9000, 2560, 2304), (9217, 2560, 2560), (99000, 8192, 4096)])
def context_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(n,) for n in (0, 100, 9000, 9217, 99000)], "chars int")
    return df.select("chars", T.context_size(F.col("chars")).alias("answer"), T.context_size(F.col("chars"), 256, 1024, 4096).alias("chunking"))


@sql("SELECT id, left(md5(q || t), 12) AS qa_id FROM (VALUES (0, 'what is it', '2024-01-01T00:00:00'), (1, '', ''), (2, 'é', 'x')) AS v(id, q, t)")
def qa_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(0, "what is it", "2024-01-01T00:00:00"), (1, "", ""), (2, "é", "x")], "id int, q string, t string").select("id", T.qa_id(F.col("q"), F.col("t")).alias("qa_id"))


@expect("id, text", [(0, "Ask Suruhanjaya Syarikat Malaysia."), (1, "Ask Suruhanjaya Syarikat Malaysia."), (2, "Jabatan Syarikat"), (3, "nothing")])
def agency_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the name that the check looks for is put right here."""
    return _texts(spark, ["Ask Jabatan Pendaftaran Syarikat.", "Ask Jabatan Kebangsaan Pendaftaran Syarikat.", "Jabatan Syarikat", "nothing"]).select("id", R.corrected_agency(F.col("text")).alias("text"))


@expect("id, section, content", [(1, "HEAD", "Q: What is it?//A: This."), (1, "HEAD", "Q: Why?//A: So."), (2, "Section 1", _P), (3, None, "3")])
def table_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL names of the parsers and the splitter."""
    chunking.register(spark)
    faq = "SELECT d.id, c.section, replace(c.content, '\\n', '/') AS content FROM VALUES (1, 'HEAD\\nQ: What is it?\\nA: This.\\nQ: Why?\\nA: So.') AS d(id, text), LATERAL parse_faq(d.text) AS c"
    others = f"SELECT d.id, c.section, c.content FROM VALUES (2, '{_P}') AS d(id, text), LATERAL chunk_text(d.text) AS c"
    return spark.sql(f"{faq} UNION ALL {others} UNION ALL SELECT 3, CAST(NULL AS STRING), CAST(size(split_long(repeat('word ', 700))) AS STRING)")


# ---- models ----


@expect("kind, source_key, section, content", [("read", "k", "1", _P), ("whole", "k", "", f"{_P} {_P}"), ("cut", "k", "", _P)])
def model_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's chunks, the page where its answers can't be read, and what is complete of an answer that breaks off; short texts give none."""
    docs = spark.createDataFrame([("k", "n", f"{_P} {_P}"), ("s", "n", "short")], "source_key string, source_name string, text string")
    answers = {"read": "```json\n" + json.dumps([{"section": "1", "content": _P}, {"content": "short"}]) + "\n```", "whole": "no json", "cut": '<think>x</think>[{"content": "' + _P + '"}, {"content": "cut'}
    out = None
    for kind, answer in answers.items():
        part = G.chunks_by_model(docs, FixedAnswer(answer)).select(F.lit(kind).alias("kind"), "source_key", "section", "content")
        out = part if out is None else out.unionByName(part)
    return out


@expect("kind, id, text", [
    ("answer", 1, "A whole answer that is long enough."), ("rewrite", 1, "is the return due"), ("rewrite", 2, "what are filing costs"), ("rewrite", 3, "is it due"), ("action", 2, "hold_agm 0.8 340"), ("reflect", 1, "retrieval  46"),
])
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers, follow-ups rewritten (others never), intents and reflections, each by a model."""
    q = spark.createDataFrame([(1, "is it due", 1, "h"), (2, "what are filing costs", 1, "h"), (3, "is it due", 0, "")], "query_id int, text string, turns_before int, history string")
    shown = lambda df, kind, i, text: df.select(F.lit(kind).alias("kind"), F.col(i).cast("int").alias("id"), text.alias("text"))
    answer = G.generate(q.where("query_id = 1").select("query_id", F.col("text").alias("prompt")), FixedAnswer("A whole answer that is long enough."))
    action = G.classify(q.where("query_id = 2"), FixedAnswer('{"action": "hold_agm", "confidence": 0.8, "likely_sections": [340]}'), forms.taxonomy_text())
    why = G.reflect(spark.createDataFrame([("1", "q", "r")], "qa_id string, query string, response string"), FixedAnswer('<think>x</think>{"root_agent": "retrieval", "suggested_sections": ["46"]}'))
    out = shown(answer, "answer", "query_id", F.col("response")).unionByName(shown(G.rewrite(q, FixedAnswer("is the return due")), "rewrite", "query_id", F.col("text")))
    out = out.unionByName(shown(action, "action", "query_id", F.concat_ws(" ", "action", "confidence", F.array_join("likely_sections", ","))))
    return out.unionByName(shown(why, "reflect", "qa_id", F.concat_ws(" ", "root_agent", "suggested_intent", F.array_join("suggested_sections", ","))))


@expect("id, vector, made", [(1, 1, True), (2, 1, True), (4, 2, False), (5, 3, True)])
def embedding_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts share a vector, cached ones aren't made again, blank texts and those without words have none; texts count up to 2,000 characters."""
    texts = spark.createDataFrame([(1, "same words"), (2, "same words"), (3, " "), (4, "cached words"), (5, "w" * 2000 + " beyond"), (6, "!?")], "id int, text string")
    cache = spark.createDataFrame([("cached words", [2.0])], "text string, embedding array<float>").select(F.md5(F.col("text").cast("binary")).alias("digest"), "embedding")
    got = search.embed(texts, cache, HashedWords())
    named = got.withColumn("vector", F.when(F.col("id") <= 2, 1).when(F.col("id") == 4, 2).otherwise(3))
    same = got.where("id <= 2").agg(F.count_distinct("digest").alias("n"))
    return named.join(same).where("n = 1").select("id", "vector", (F.size("embedding") == 64).alias("made"))


@expect("query_id, prompt", [(1, f"H/<<CONTEXT_BLOCK>>/{G.RULE}/[SOURCE: A]/first/[/SOURCE: A]//[SOURCE: B | VISUAL CONTENT]/second/[/SOURCE: B]/{G.RULE}//<<USER_QUESTION>>/why?/P")])
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = spark.createDataFrame([(1, 2, "B", "visual", "second"), (1, 1, "A", "text", "first")], "query_id int, rank int, source_name string, chunk_type string, text string")
    return G.context_block(ranked).select("query_id", _one_line(G.prompt(F.lit("why?"), F.col("context"), F.lit("H\n"), F.lit(None).cast("string"), F.lit("P"))).alias("prompt"))


# ---- retrieval ----


@expect("query_id, source_key", [(1, "all"), (1, "company"), (2, "all"), (2, "company"), (2, "llp")])
def pruned_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enabled, selected sources of the wanted categories; one with acts is left out only for another act's query."""
    rows = [("all", "FAQ", True, []), ("company", "FAQ", True, ["Companies Act 2016"]), ("llp", "Forms", True, ["LLP Act 2012"]), ("off", "FAQ", False, []), ("other", "Circular", True, []), ("unselected", "FAQ", True, [])]
    s = spark.createDataFrame(rows, "key string, category string, enabled boolean, relates_to_acts array<string>")
    q = spark.createDataFrame([(1, "what does the companies act say"), (2, "what is the fee")], "query_id int, text string")
    return search.prune_sources(q, s, ["all", "company", "llp", "off", "other"], ["FAQ", "Forms"])


@expect("source_key, text, chunk_type, clbg", [
    ("a", f"Section 7 (PART I): Title//{_P}", "text", False), ("b", _P, "text", False), ("c", f"Section 8//[TABLE] {_P}", "table", False), ("d", f": Only a title//[VISUAL DESCRIPTION][TABLE] {_P}", "visual", False), ("f", f"{_P} Checklist for CLBG", "text", True),
])
def index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 40 characters or more with their headings; what they show, and whether they are on companies by guarantee."""
    rows = [("a", "Section 7", "Title", "PART I", _P), ("b", "", None, "", _P), ("c", "Section 8", "", None, f"[TABLE] {_P}"), ("d", "", "Only a title", "", f"[VISUAL DESCRIPTION][TABLE] {_P}"), ("e", "S", "", "", "x" * 39), ("f", None, None, None, f" {_P} Checklist for CLBG ")]
    df = search.index_chunks(spark.createDataFrame(rows, "source_key string, section string, section_title string, part string, content string"))
    return df.select("source_key", _one_line("text").alias("text"), "chunk_type", T.mentions_clbg(F.col("text")).alias("clbg"))


@expect("query_id, citations, categories_hit, found", [(1, "Bee,Ay", "FAQ,Forms", True), (2, "Ay", "FAQ", True)])
def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and categories of the sources, each once, as they first appear; unknown sources aren't cited."""
    ranked = spark.createDataFrame([(1, 1, "b"), (1, 2, "c"), (1, 3, "a"), (1, 4, "b"), (2, 1, "a"), (2, 2, "gone")], "query_id int, rank int, source_key string")
    s = spark.createDataFrame([("a", "Ay", "FAQ"), ("b", "Bee", "FAQ"), ("c", "Ay", "Forms")], "key string, name string, category string")
    return search.summary(ranked, s).select("query_id", F.array_join("citations", ",").alias("citations"), F.array_join("categories_hit", ",").alias("categories_hit"), "found")


@expect("kind, query_id, source_key, chunk_no, score", [
    ("plain", 2, "s", 1, 0.4), ("plain", 2, "s", 2, 0.8), ("plain", 2, "t", 1, 0.8), ("plain", 3, "s", 1, 1.0), ("plain", 3, "s", 2, 0.64), ("plain", 3, "t", 1, 0.64),
    ("boosted", 2, "s", 1, 0.4), ("boosted", 2, "s", 2, 0.95), ("boosted", 2, "t", 1, 0.8), ("boosted", 3, "s", 1, 1.0), ("boosted", 3, "s", 2, 0.64), ("boosted", 3, "t", 1, 0.64),
], score="DOUBLE", chunk_no="BIGINT")
def hybrid_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malay queries count no words; chunks on companies by guarantee count 0.4 unless the query asks for them; a zero vector scores 0; a stored boost adds."""
    rows = [("s", 1, "clbg costs of it", "5", [1.0, 0.0]), ("s", 2, "costs", "6", [0.8, 0.6]), ("s", 3, "costs", "6", [0.0, 0.0]), ("s", 4, "others", "6", [0.0, 1.0]), ("s", 5, "more", "6", [0.0, 1.0]), ("t", 1, "costs", "8", [0.8, 0.6])]
    chunks = spark.createDataFrame(rows, "source_key string, chunk_no long, text string, section string, embedding array<double>")
    q = spark.createDataFrame([(2, "costs", "ms", [1.0, 0.0]), (3, "clbg", "en", [1.0, 0.0])], "query_id int, text string, lang string, embedding array<double>")
    boosts = q.where("query_id = 2").select(T.query_hash(F.col("text")).alias("query_hash"), F.lit("section 6").alias("section_parent"), F.lit(0.15).alias("delta"))
    shown = lambda df, kind: df.select(F.lit(kind).alias("kind"), "query_id", "source_key", "chunk_no", F.round("score", 6).alias("score"))
    return shown(search.hybrid(q, chunks), "plain").unionByName(shown(search.hybrid(q, chunks, boosts=boosts), "boosted"))


@expect("key, status, state", [("a", "ready", "sound"), ("b", "cached", "sound"), ("c", "not_indexed", "stale"), ("d", "not_indexed", "torn"), ("e", "needs_preprocess", "without_terms")])
def index_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only a sound index of this version counts; chunks and vectors must be as many."""
    s = spark.createDataFrame([(k, k != "off") for k in ("a", "b", "c", "d", "e", "off")], "key string, enabled boolean")
    indexed = spark.createDataFrame([("a", 3, 5, 5, 9), ("b", 3, 5, 5, 9), ("c", 2, 5, 5, 9), ("d", 3, 5, 4, 9), ("e", 3, 5, 5, None)], "key string, version int, n_chunks long, n_vectors long, n_terms long")
    state = search.sound(indexed)
    done = spark.createDataFrame([(k,) for k in "abcd"], "key string")
    status = search.index_status(s, indexed.join(state.where("state = 'sound'"), "key", "left_semi"), done, done.where("key = 'a'"))
    return status.join(state, "key")


@expect("source_key, term", [("s1", "new"), ("s1", "words"), ("s2", "another"), ("s2", "text")])
def index_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of two sources, of which one is built again: the other one's files stay."""
    path = scratch(spark)
    chunks = spark.createDataFrame([("s1", 1, "the fee"), ("s2", 1, "another text")], "source_key string, chunk_no long, text string")
    search.build_index(chunks, path)
    search.build_index(chunks.where("source_key = 's1'").withColumn("text", F.lit("new words")), path)
    return search.load_index(spark, path)["postings"].select("source_key", "term")


@expect("id, x, y", [(0, 0.6, 0.8), (1, 0.0, 0.0), (2, -1.0, 0.0)], x="DOUBLE", y="DOUBLE")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [-2.0, 0.0])], "id int, v array<double>").withColumn("u", unit(F.col("v")))
    return df.select("id", F.round(F.get("u", F.lit(0)), 9).alias("x"), F.round(F.get("u", F.lit(1)), 9).alias("y"))


# ---- memory and sessions ----


@expect("query_id, rank, memory_id, score", [(1, 1, "c", 0.4), (1, 2, "a", 0.2), (2, 1, "b", None), (2, 2, "a", None), (2, 3, "c", None)], score="DOUBLE")
def memory_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a vector a memory counts by the words that it shares, at most 0.4; without a query vector long-term ones come first, in order."""
    r = spark.createDataFrame([("u", "a", "midterm", 1, "annual fees", None), ("u", "b", "longterm", 2, "nothing", None), ("u", "c", "midterm", 3, "the annual return", None)], "user string, memory_id string, tier string, seq int, content string, embedding array<double>")
    q = spark.createDataFrame([(1, "u", "Annual return", [1.0]), (2, "u", "annual", None)], "query_id int, user string, text string, embedding array<double>")
    return memory.rank(r, q, 0.2).select("query_id", "rank", "memory_id", F.round("score", 6).alias("score"))


@expect("id, block", [(1, "  Your preference: a/  Your correction: b/  Note: c"), (2, "  Your instruction: " + "x" * (500 - len(C.MEMORY_HEAD) - 41 - 20))])
def memory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled lines in rank order; a block of over 500 characters is cut and says so."""
    chosen = spark.createDataFrame([(1, 2, "correction", "b"), (1, 1, "preference", "a"), (1, 3, "other", "c"), (2, 1, "instruction", "x" * 600)], "query_id int, rank int, memory_type string, content string")
    block = memory.memory_block(chosen)
    lines = F.filter(F.split("block", "\n"), lambda x: x.startswith("  "))
    fits = F.when(F.col("query_id") == 2, F.col("block").endswith("\n[memory truncated]\n\n") & (F.length("block") == 500 + 21)).otherwise(F.length("block") <= 500)
    return block.where(fits).select(F.col("query_id").alias("id"), F.array_join(lines, "/").alias("block"))


@expect("step, tier, n", [("all", "longterm", 2), ("all", "midterm", 1), ("cleared", "longterm", 2)], n="BIGINT")
def memory_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.createDataFrame([("longterm",), ("midterm",), ("longterm",)], "tier string")
    shown = lambda df, step: memory.tier_counts(df).select(F.lit(step).alias("step"), "tier", "n")
    return shown(r, "all").unionByName(shown(memory.clear_tier(r, "midterm"), "cleared"))


@sql("SELECT memory_type, tier, left(md5(content || '2024-01-01 00:00:00'), 12) AS memory_id, expires FROM (VALUES ('preference', 'longterm', 'Language preference: Please answer in Malay', NULL), ('correction', 'midterm', 'User correction: that''s wrong, it is section 5', '2024-01-08')) AS v(memory_type, tier, content, expires)")
def memory_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of twelve digits from content and time; mid-term records end after seven days."""
    df = memory.detect(spark.createDataFrame([("a", AT, "Please answer in Malay."), ("b", AT, "that's wrong, it is section 5")], "user string, ts timestamp, text string"))
    return df.select("memory_type", "tier", "memory_id", F.date_format("expires_at", "yyyy-MM-dd").alias("expires"))


@expect("user, content, expires", [("a", "Recent session topics: " + "q" * 80, "2024-01-08"), ("b", "Recent session topics: t1, t2, t3, t4, t5, t6, t7, t8", "2024-01-08")])
def session_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What evicted turns were about, for seven days: 80 characters of a question, eight topics at most."""
    one = memory.session_summary(spark.createDataFrame([("a", AT, "q" * 90)], "user string, ts timestamp, query string"))
    many = spark.createDataFrame([("b", AT, [f"t{i}" for i in range(1, 11)])], "user string, ts timestamp, names array<string>")
    many = many.select("user", memory.topics(F.col("names")).alias("content"), (F.col("ts") + F.expr(f"INTERVAL {memory.TTL_DAYS} DAYS")).alias("expires_at"))
    return one.select("user", "content", "expires_at").unionByName(many).select("user", "content", F.date_format("expires_at", "yyyy-MM-dd").alias("expires"))


@expect("session, text", [("s", "User: q1/Assistant: r1//User: q2/Assistant: r2"), ("t", "User: q/Assistant: r")])
def conversation_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = spark.createDataFrame([("s", 2, "q2", "r2"), ("s", 1, "q1", "r1"), ("t", 1, "q", "r")], "session string, seq int, query string, response string")
    return memory.conversation_text(chat).select("session", _one_line("text").alias("text"))


# ---- forms ----


@expect("form_id, form_number, url, link_type, resource_type", [("f1", "S28", "http://f/1", "pdf", "form"), ("f2", "S58", "http://f/2", "portal", "form"), ("f3", "", "", "pdf", "form"), ("f4", "", "", "pdf", "form"), ("f5", "", "", "pdf", "form")])
def shown_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pdf, portal or platform link; a video is none of them."""
    return forms.output_forms(_forms(spark)).select("form_id", "form_number", "url", "link_type", "resource_type")


@expect("block", [("- first/- second",)])
def classifier_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.createDataFrame([("b", "intent_direction_correction", "second"), ("a", "intent_direction_correction", "first"), ("c", "other", "third")], "key string, type string, patch_text string")
    return forms.classifier_patches(p).select(_one_line("block").alias("block"))


def _asked(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "query_id int, text string, lang string, user string, seq int")


_RESOLVED = "cache_key string, path string, form_id string, seq int"


@expect("cache_key, path, form_id, seq", [("b", "agent", "f9", 2), ("c", "none", None, 3), ("d", "agent", "f4", 4)])
def kept_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three are kept: a new one drives out the oldest, one that is there already is replaced in its place."""
    kept = spark.createDataFrame([("a", "agent", "f1", 1), ("b", "agent", "f2", 2), ("c", "none", None, 3)], _RESOLVED)
    return forms.remember(kept, spark.createDataFrame([("d", "agent", "f4", 4), ("b", "agent", "f9", 5)], _RESOLVED), 3)


@expect("what, query_id", [("kept", 2), ("flag", 1), ("flag", 3), ("flag after", 3)])
def rated_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries 1 and 3 are rated down: the kept result of 1 goes, both are flagged; then 1 is rated up. Another user's query 2 stays."""
    q = _asked(spark, [(1, "strike off", "en", "u", 1), (2, "strike off", "en", "v", 2), (3, "other", "ms", "u", 3)])
    key = q.withColumn("cache_key", forms.cache_key(F.col("text"), F.col("lang"), F.col("user")))
    kept = key.where("query_id < 3").select("cache_key", F.lit("agent").alias("path"), F.lit("f1").alias("form_id"), "seq")
    none = spark.createDataFrame([], "cache_key string")
    kept, flags = forms.invalidate(kept, none, q.where("query_id <> 2").unionByName(q.where("query_id = 1")))
    after = forms.clear_negative(flags, q.where("query_id = 1"))
    shown = lambda df, what: df.select("cache_key").join(key, "cache_key").select(F.lit(what).alias("what"), "query_id")
    return shown(kept, "kept").unionByName(shown(flags, "flag")).unionByName(shown(after, "flag after"))


@expect("query_id, was_kept, path, form_id, flagged", [(1, True, "agent", "f5", False), (2, False, "agent", "f1", False), (3, False, "none", None, False), (4, False, "none", None, True), (5, False, "none", None, False)])
def resolve_with_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 is kept; 2 is kept but flagged, and its stored correction leads to a form; 3 is new; 4 is flagged without a correction; 5 has a correction but no flag."""
    q = _asked(spark, [(1, "appoint someone", "en", "u", 1), (2, "rename it", "en", "u", 2), (3, "hello", "en", "u", 3), (4, "odd", "en", "u", 4), (5, "even", "en", "u", 5)])
    key = q.withColumn("cache_key", forms.cache_key(F.col("text"), F.col("lang"), F.col("user")))
    kept = key.where("query_id <= 2").select("cache_key", F.lit("agent").alias("path"), F.lit("f5").alias("form_id"), "seq")
    flags = key.where("query_id IN (2, 4)").select("cache_key")
    none = spark.createDataFrame([], "query_id int, action string, confidence double, is_actionable boolean, ambiguous boolean, reasoning string, legal_procedure string")
    freq = spark.createDataFrame([], "query_id int, parent string, child string, chunks int")
    over = spark.createDataFrame([], "intent_action string, form_id string, form_name string, confidence double, locked boolean")
    fixes = q.where("query_id IN (2, 5)").select(T.query_hash(F.col("text")).alias("query_hash"), F.lit("change_company_name").alias("action"))
    out, left = forms.resolve_kept(q, kept, flags, none, freq, _forms(spark), over, fixes)
    return out.join(left.withColumn("flagged", F.lit(True)), "cache_key", "left").select("query_id", "was_kept", "path", "form_id", F.coalesce("flagged", F.lit(False)).alias("flagged"))


# ---- feedback and learning ----


@expect("qa_id, query, response_snippet, rating, failure_type, comment, form_ids, form_correct", [("a", "q", "r" * 300, 5, "", "c", "f1", True), ("b", "", "", 0, "", "", "", None), ("c", "q", "r", 1, "other", "", "", False)])
def feedback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback as it is kept: snippets, blanks for what is missing, three states of form_correct."""
    rows = [("a", AT, "q", "r" * 310, 5, None, "c", ["f1"], True), ("b", AT, None, None, None, None, None, None, None), ("c", AT, "q", "r", 1, "other", "", [], False)]
    df = feedback.record(spark.createDataFrame(rows, "qa_id string, ts timestamp, query string, response string, rating int, failure_type string, comment string, form_ids array<string>, form_correct boolean"))
    return df.select("qa_id", "query", "response_snippet", "rating", "failure_type", "comment", F.array_join("form_ids", ",").alias("form_ids"), "form_correct")


@expect("qa_id, day, failure_type, auto_diagnosed", [("a", 1, "incomplete", True), ("a", 2, "", False), ("b", 1, "other", False), ("c", 1, "", False), ("d", 1, "incorrect", True)])
def failure_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A found type goes into the first row of its id only, and only where there is none; missing counts as none."""
    fb = spark.createDataFrame([("a", AT + timedelta(1), ""), ("a", AT, ""), ("b", AT, "other"), ("c", AT, ""), ("d", AT, None)], "qa_id string, ts timestamp, failure_type string")
    back = feedback.write_back(fb, spark.createDataFrame([("a", "incomplete"), ("b", "incorrect"), ("d", "incorrect")], "qa_id string, failure_type string"))
    return back.select("qa_id", F.dayofmonth("ts").alias("day"), F.coalesce("failure_type", F.lit("")).alias("failure_type"), "auto_diagnosed")


@expect("total, without_issue, counts, recent", [(7, 1, "missing_form 4 0.571429,truncation 3 0.428571", "q6 unknown,q5 retrieval missing_form,q4 retrieval missing_form,q3 retrieval missing_form truncation,q2 retrieval missing_form")], total="BIGINT", without_issue="BIGINT")
def learning_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and shares of the issues of seven failures, and the last five, newest first."""
    issues = [["truncation"], ["truncation"], ["missing_form"], ["missing_form", "truncation"], ["missing_form"], ["missing_form"], []]
    rows = [(f"h{i}", f"q{i}", "unknown" if i == 6 else "retrieval", [(x,) for x in names], AT + timedelta(i)) for i, names in enumerate(issues)]
    s = feedback.stats(spark.createDataFrame(rows, "query_hash string, query string, root_agent string, auto_issues array<struct<type:string>>, ts timestamp"))
    counts = F.transform("counts", lambda c: F.concat_ws(" ", c["type"], c["n"], F.round(c["share"], 6)))
    recent = F.transform("recent", lambda r: F.concat_ws(" ", r["query"], r["root_agent"], r["issues"]))
    return s.select("total", "without_issue", F.array_join(counts, ",").alias("counts"), F.array_join(recent, ",").alias("recent"))


@expect("agent, route", [("form_mapping", "mapping"), ("retrieval", "retrieval"), ("generation", "prompt"), ("unknown", "none"), (None, "none")])
def correction_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame([(a,) for a in ("form_mapping", "retrieval", "generation", "unknown", None)], "agent string")
    return df.select("agent", feedback.correction_route(F.col("agent")).alias("route"))


@expect("what, key, value", [
    ("override", "hold_agm", "f1 F 1 False"), ("override", "register_company", " [flagged: register_company] 0 False"), ("correction", "how to hold it", "hold_agm"), ("correction", "add it", "strike_off_company"), ("override", "strike_off_company", "f7 [flagged: strike_off_company] 0 False"),
    ("patch", "intent_correction_hold_agm", "how to hold it?"), ("patch", "intent_correction_register_company", "add it"), ("patch", "intent_correction_strike_off_company", "add it"),
])
def mapping_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures put right: a wrongly shown form counts against its override, known actions get one flagged override and one note each, a query keeps its latest action."""
    over = spark.createDataFrame([("hold_agm", "f1", "F", 0.5, False, 1, 0, AT)], "intent_action string, form_id string, form_name string, confidence double, locked boolean, confirmed_positive long, confirmed_negative long, ts timestamp")
    fixes, notes = spark.createDataFrame([], "query_hash string, action string, ts timestamp"), spark.createDataFrame([], "key string, type string, correct_intent string, example_query string, patch_text string, ts timestamp")
    rows = [("How to hold it?", "hold_agm", "f1", 0), ("add it", "register_company", None, 1), ("Add  it", "strike_off_company", "f7", 2), ("x", "no_such_action", "f", 3)]
    bad = spark.createDataFrame([(q, a, f, AT + timedelta(d)) for q, a, f, d in rows], "query string, suggested_intent string, form_id string, ts timestamp")
    o, c, n = feedback.correct_mapping(feedback.count_negatives(over, bad.select("form_id").na.fill("")), fixes, notes, bad)
    flag = F.when(F.col("locked"), "True").otherwise("False")
    named = spark.createDataFrame([("how to hold it",), ("add it",)], "q string").withColumn("query_hash", T.query_hash(F.col("q")))
    out = o.select(F.lit("override").alias("what"), F.col("intent_action").alias("key"), F.concat_ws(" ", "form_id", "form_name", "confirmed_negative", flag).alias("value"))
    out = out.unionByName(c.join(named, "query_hash").select(F.lit("correction").alias("what"), F.col("q").alias("key"), F.col("action").alias("value")))
    return out.unionByName(n.select(F.lit("patch").alias("what"), "key", F.col("example_query").alias("value")))


@expect("query, section_parent, delta", [("q", "46", 0.15), ("q", "58", 0.2), ("r", "46", 0.15)], delta="DOUBLE")
def retrieval_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boost for each suggested section that the query has none for; blank sections give none."""
    q = spark.createDataFrame([("q",), ("r",)], "query string").withColumn("query_hash", T.query_hash(F.col("query")))
    boosts = q.where("query = 'q'").select("query_hash", F.lit("58").alias("section_parent"), F.lit("").alias("reason"), F.lit(AT).alias("ts"), F.lit(0.2).alias("delta"), F.lit(None).cast("string").alias("section_child"))
    bad = spark.createDataFrame([("q", ["Section 46", "s. 46", "58", " "], AT), ("r", ["seksyen 46"], AT)], "query string, suggested_sections array<string>, ts timestamp")
    return feedback.correct_retrieval(boosts, bad).join(q, "query_hash").select("query", "section_parent", "delta")


@expect("qa_id, root_agent, suggested_intent, failure_type", [("cut", "form_mapping", "strike_off_company", "incomplete"), ("plain", "unknown", "", "other"), ("fast", "generation", "", "incomplete"), ("model", "retrieval", "hold_agm", "wrong_source"), ("form", "retrieval", "", "wrong_form")])
def negative_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sure issue decides without the model unless it is a form's; a keyword's action stands in where none is suggested."""
    rows = [("cut", "strike off my company", "It was cut off before completion", []), ("plain", "hello", "Yes.", []), ("fast", "what is it", "It was cut off before completion", []), ("model", "what is it", "No.", []), ("form", "what is it", "See [Other](https://x/1).", [])]
    turns = spark.createDataFrame(rows, "qa_id string, query string, response string, shown array<string>")
    said = spark.createDataFrame([("fast", "retrieval", ""), ("model", "retrieval", "hold_agm"), ("form", "retrieval", "")], "qa_id string, root_agent string, suggested_intent string")
    return feedback.negative_pipeline(turns, said).select("qa_id", "root_agent", "suggested_intent", "failure_type")


# ---- streams, run to the end of what is there ----


@expect("qa_id, failure_type", [("a", "wrong_form"), ("b", ""), ("c", "incomplete")])
def feedback_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negative feedback is diagnosed as it comes in, and kept with its failure type."""
    rows = [("a", AT, "how to register", "You can.", 1), ("b", AT + timedelta(1), "what is it", "It is so.", 5), ("c", AT, "what is it", "It was cut off before completion", 0)]
    df = spark.createDataFrame(rows, "qa_id string, ts timestamp, query string, response string, rating int").withColumns({"failure_type": F.lit(""), "comment": F.lit(""), "form_ids": F.array().cast("array<string>")})
    came, kept, state = scratch(spark), scratch(spark), scratch(spark)
    df.coalesce(1).write.parquet(came)
    jobs.feedback_loop(spark.readStream.schema(df.schema).parquet(came), kept, state).awaitTermination()
    found = store.UpsertTable(kept, ["qa_id"]).read(spark, jobs.FEEDBACK_SCHEMA)
    return found.select("qa_id", F.coalesce("failure_type", F.lit("")).alias("failure_type"))


@expect("name, length", [("a.txt", 2), ("b.txt", 4)], length="BIGINT")
def ingested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a folder, each once: the first is taken by one run, the second by the next."""
    root, out, state = scratch(spark), scratch(spark), scratch(spark)
    for i, (name, text) in enumerate((("a.txt", "x"), ("b.txt", "xyz"))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{root}/{name}")
        files = jobs.new_files(spark, f"{root}/*/part-*").select(F.element_at(F.split("path", "/"), -2).alias("name"), "length")
        files.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)

