"""Queries over small invented tables that the input tables have no cases for, with the results worked out by hand."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import responses as R
from tessera.functions import text as T
from tessera.operators import chunking, forms, memory, search
from tessera.sources import registry as sources

QUERIES: list[tuple] = []


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def expected_sql(columns: str, rows: list[tuple], **types: str) -> str:
    """SQL that lists the rows; types: of columns whose literals have another."""
    swap = f" REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in types.items())})" if types else ""
    return f"SELECT *{swap} FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") AS t({columns})"


def expect(columns: str, rows: list[tuple], **types: str):
    """Registers a query with its expected rows."""

    def mark(f):
        QUERIES.append((f, expected_sql(columns, rows, **types)))
        return f

    return mark


def _texts(spark: SparkSession, rows: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string")


@expect("id, lang", [(0, "en"), (1, "ms"), (2, "mixed"), (3, "en"), (4, "ms"), (5, "en")])
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ["What is the fee for an annual return?", "Apakah yuran untuk pendaftaran syarikat?", "please explain the yuran for a new company here", "123 ?!", "syarikat sdn. bhd. baru", ""]
    return _texts(spark, rows).select("id", T.detect_language(F.col("text")).alias("lang"))


@expect("id, text", [
    (0, "when is the annual general meeting"), (1, "extension of time for annual general meeting"), (2, "notification change registered address section 46 companies act section 46"),
    (3, "notification change registered address section 46 please"), (4, "the registered address section 46 companies act"), (5, "stagmatic cosecant"),
])
def expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ["when is the AGM", "eot for Agm", "change my company address", "change my registered address please", "the registered office address", "stagmatic cosecant"]
    return _texts(spark, rows).select("id", T.expand_query(F.col("text")).alias("text"))


@expect("id, act", [(0, "Companies Act 2016"), (1, "LLP Act 2012"), (2, "Companies Act 2016"), (3, "Registration of Businesses Act 1956"), (4, "Companies Act 2016"), (5, None), (6, "LLP Act 2012"), (7, "Companies Act 2016")])
def detect_act(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        "What does the Companies Act say?", "llp act deadlines", "is the company under the llp act", "close my sole proprietorship",
        "can a director be a shareholder", "a single director", "limited liability of a partnership", "company director in an llp partnership",
    ]
    return _texts(spark, rows).select("id", T.detect_act(F.col("text")).alias("act"))


@expect("id, greeting", [(0, True), (1, True), (2, True), (3, False), (4, True), (5, False)])
def greeting_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ["Hiii!", "good  morning", "Selamat petang :)", "hello, what is the fee", "apa khabar?", "high"]
    return _texts(spark, rows).select("id", T.is_greeting(F.col("text")).alias("greeting"))


@expect("id, followup", [(0, True), (1, False), (2, True), (3, False), (4, True), (5, False)])
def followup_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ["what about private companies", "fees of annual returns", "is it due", "what is the fee for lodging it late", "tell me more", "how to wind up"]
    return _texts(spark, rows).select("id", T.is_followup(F.col("text"), F.lit(1)).alias("followup"))


@expect("query_id, parent, child, chunks", [(1, "46", None, 2), (1, "41", "2", 1), (1, "60a", None, 1), (1, "8", None, 1), (2, "46", None, 1)], chunks="BIGINT")
def section_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "Under section 46 and Section 46, see section 41(2)."), (1, "Seksyen 46 and Section 60A; subsection 99 is not one, section 8,"), (2, "SECTION  46"), (2, "no reference")]
    return search.section_frequency(spark.createDataFrame(rows, "query_id int, text string"))


_SOURCES = [
    ("pn_1", "pn 1", "Practice Notes", "pdf", "general", True, [], None, "a/pn 1.pdf"),
    ("act", "act", "Legislations", "pdf", "act", True, ["Companies Act 2016"], None, "a/act.pdf"),
    ("off", "off", "FAQ", "csv", "faq", True, [], None, "a/off.csv"),
]
_OVERRIDES = [
    ("pn_1", "pn_1", None, None, "general", None, None, "http://x", None),
    ("act", "The Act", "Legislations", "csv", None, None, [], None, ""),
    ("off", "off", "", "csv", "faq", False, None, None, None),
    ("web", None, "Circular", None, None, None, ["LLP Act 2012"], "http://w", None),
]


@expect("key, name, category, type, doc_type, acts, url, local_path", [
    ("pn_1", "pn 1", "Practice Notes", "pdf", "general", "", "http://x", "a/pn 1.pdf"),
    ("act", "The Act", "Legislations", "csv", "act", "Companies Act 2016", None, "a/act.pdf"),
    ("web", "web", "Circular", "pdf", "act", "LLP Act 2012", "http://w", None),
])
def source_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = sources.merge(spark.createDataFrame(_SOURCES, sources.SOURCE_SCHEMA), sources.override_defaults(spark.createDataFrame(_OVERRIDES, sources.SOURCE_SCHEMA)))
    return sources.enabled(merged).select("key", "name", "category", "type", "doc_type", F.array_join("relates_to_acts", ",").alias("acts"), "url", "local_path")


@expect("key, category, type, local_path", [
    ("pn_no_3_2018", "Guidelines", "pdf", "/r/Guidelines/general/PN No. 3-2018.pdf"), ("deck", "FAQ", "pptx", "/r/FAQ/slide/Deck.PPTM"), ("scan", "Forms", "image", "/r/Forms/others/scan.webp"),
])
def source_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = ["/r/Guidelines/general/PN No. 3-2018.pdf", "/r/FAQ/general/pn no 3 2018.csv", "/r/FAQ/slide/Deck.PPTM", "/r/Forms/others/scan.webp", "/r/Other/act/x.pdf", "/r/FAQ/faq/x.doc", "/r/FAQ/notes/y.pdf"]
    return sources.from_paths(spark.createDataFrame([(p,) for p in paths], "path string")).select("key", "category", "type", "local_path")


_P = "This paragraph is long enough to be kept as a chunk of its own, with words."


def _docs(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([("k", "n", text)], "source_key string, source_name string, text string")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("chunk_no", "part", "section", F.replace("content", F.lit("\n"), F.lit("/")).alias("content"))


@expect("chunk_no, part, section, content", [
    (1, "", "", f"{_P}"), (2, "OBJECTIVE", "OBJECTIVE", f"2. {_P}/{_P}"), (3, "OBJECTIVE", "A. Initial Application", f"{_P}/HEADLINE,"), (4, "OBJECTIVE", "Appendix 1", f"(a) {_P}"), (5, "FEES", "Para 3 on fees", _P),
], chunk_no="BIGINT")
def general_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [_P, "", "1 PN 3/2018 26 July 2018", "OBJECTIVE", f"2. {_P}", "12", _P, "A. Initial Application", _P, "HEADLINE,", "Contents ..... 4", "Appendix 1", "[TABLE]", f"(a) {_P}", "FEES", "short", "Para 3 on fees", _P]
    return _shown(chunking.parse_general(_docs(spark, "\n".join(lines))))


@expect("chunk_no, part, section, content", [
    (1, "Citation and commencement", "Citation and commencement", f"1. {_P}"), (2, "Lodgement of documents", "Lodgement of documents", f"2. {_P}"),
    (3, "SCHEDULE", "SCHEDULE - PART B FEES", f"(Regulation 3)/{_P}/Item | 1,000.00/{_P}"),
], chunk_no="BIGINT")
def gazette_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [
        "WARTA KERAJAAN", "PADA menjalankan kuasa", "Nama dan permulaan kuasa", f"1. {_P}", "IN exercise of the powers", "Citation and commencement", f"1. {_P}",
        "Peraturan ini hendaklah dibaca dengan Akta", "P.U. (A) 37", "Lodgement of documents", f"2. {_P}", "Made 2 January", "SCHEDULE", "(Regulation 3)", _P, "PART B FEES", "Item | 1,000.00", "Fees of the schedule", _P,
    ]
    lines[17] = ""
    return _shown(chunking.parse_gazette(_docs(spark, "\n".join(lines))))


@expect("chunk_no, part, division, section, section_title, content", [
    (1, "PART I: Preliminary", "", "Section 1", "Short title", _P), (2, "PART I: Preliminary", "", "Section 2", "Interpretation of words", f"(1) {_P}/part in the management of it"),
    (3, "PART II: Companies", "Division 1: Formation", "Section 14A", "Forming a company", _P), (4, "PART II: Companies", "Division 1: Formation", "Section 16", "A title before it", _P),
], chunk_no="BIGINT")
def act_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [
        "Laws of Malaysia ACT 777", "PART I", "", "Preliminary", "1. Short title", _P, "Interpretation of words", "2.", f"(1) {_P}", "part in the management of it", "Arrangement .... 12",
        "PART II", "Companies", "Division 1", "Formation", "Section 14A. Forming a company", _P, "15. Too short", "short", "A title before it", "16.", "7", _P,
    ]
    df = chunking.parse_act(_docs(spark, "\n".join(lines)))
    return df.select("chunk_no", "part", "division", "section", "section_title", F.replace("content", F.lit("\n"), F.lit("/")).alias("content"))


@expect("chunk_no, part, section, content", [
    (1, "Transitional Provisions Relating", "Transitional Provisions Relating", "Q: What is it?//A: An answer/that goes on"), (2, "Transitional Provisions Relating", "Transitional Provisions Relating", "Q: Why so?//A: Because."),
    (3, "GENERAL FEES", "GENERAL FEES", "Q: Is there a fee?//A: Yes."), (4, "GENERAL FEES", "GENERAL FEES", "Q: Is it plain?//A: It is."), (5, "GENERAL FEES", "GENERAL FEES", "Q: Later?//A: loose/Known."),
], chunk_no="BIGINT")
def faq_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [
        "Transitional Provisions Relating", "Q: What is it?", "A: An answer", "that goes on", "1. Why so?", "Answer: Because.", "PART A_amended 100323", "GENERAL FEES", "Question 2: Is there a fee?", "Answer: Yes.",
        "SECOND PART", "GENERAL FEES", "Is it plain?", "Answer: It is.", "GENERAL FEES", "Answer: loose", "Q: Later?", "A: Known.",
    ]
    return _shown(chunking.parse_faq(_docs(spark, "\n".join(lines))))


@expect("chunk_no, part, section, content", [
    (1, "Intro", "Slide 1: Intro", _P), (2, "Intro", "Slide 2 (Intro – cont.)", f"{_P}//a | b"), (3, "End", "Slide 4: End", f"Thank you//[SPEAKER NOTES]/{_P}"),
], chunk_no="BIGINT")
def slide_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("k", "n", 1, "Intro", _P, "", "Click to add notes"), ("k", "n", 2, " ", _P, "a | b", None), ("k", "n", 3, "Blank", "", "", ""), ("k", "n", 4, "End", "Thank you", None, _P)]
    return _shown(chunking.parse_slides(spark.createDataFrame(rows, "source_key string, source_name string, slide_number int, title string, body string, tables string, notes string")))


_FORMS = [
    (1, "f1", "Change of name form", "S28", ["Section 28 of Companies Act 2016"], [("pdf", "http://f/1")]),
    (2, "f2", "Officer form", "S58", ["Section 58", "section 201"], [("portal", "http://f/2")]),
    (3, "f3", "Partnership form", None, ["section 58 LLP Act 2012"], [("video", "http://v")]),
    (4, "f4", "Checklist for CLBG", None, ["s. 14", "section 58"], []),
    (5, "f5", "Second officer form", None, ["Section 201"], []),
]


def _forms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_FORMS, "form_no int, form_id string, name string, form_number string, related_sections array<string>, links array<struct<type:string,url:string>>").withColumn("resource_type", F.lit("form"))


@expect("query_id, rank, form_id, score", [(1, 1, "f2", 4), (1, 2, "f5", 1), (2, 1, "f2", 4), (2, 2, "f3", 3), (2, 3, "f5", 1), (3, 1, "f4", 3), (4, 1, "f1", 3)], score="BIGINT")
def form_scores_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "appoint_director", "", "", "Companies Act 2016"), (2, "appoint_director", "", "", None), (3, "incorporate_company", "", "a guarantee company", None), (4, "change_company_name", None, None, "LLP Act 2012"), (5, "unknown", "", "", None)]
    intents = spark.createDataFrame(rows, "query_id int, action string, reasoning string, legal_procedure string, act string")
    return forms.forms_for_intents(intents, _forms(spark)).select("query_id", "rank", "form_id", "score")


@expect("query_id, rank, form_id, score", [(1, 1, "f2", 0.8), (1, 2, "f3", 0.6), (1, 3, "f4", 0.6), (2, 1, "f1", 0.75)], score="DOUBLE")
def form_scores_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "58", None, 3), (1, "201", None, 1), (1, "46", "1", 1), (2, "28", None, 3), (2, "201", None, 1)]
    df = forms.forms_for_sections(spark.createDataFrame(rows, "query_id int, parent string, child string, chunks int"), _forms(spark))
    return df.select("query_id", "rank", "form_id", F.round("score", 6).alias("score"))


@expect("query_id, path, form_id", [(1, "locked_override", "f9"), (2, "agent", "f1"), (3, "section_match", "f1"), (4, "none", None), (5, "agent", "f1")])
def intent_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.createDataFrame([(1, "appoint a director"), (2, "rename it"), (3, "what about section 28"), (4, "hello"), (5, "Rename  my company?")], "query_id int, text string")
    rows = [(1, "appoint_director", 0.9, True, False), (2, "change_company_name", 0.8, True, False), (3, "change_company_name", 0.4, True, False), (4, "unknown", 0.9, True, False), (5, "remove_director", 0.9, True, False)]
    intents = spark.createDataFrame(rows, "query_id int, action string, confidence double, is_actionable boolean, ambiguous boolean").withColumns({"reasoning": F.lit(""), "legal_procedure": F.lit("")})
    freq = spark.createDataFrame([(3, "28", None, 2)], "query_id int, parent string, child string, chunks int")
    over = spark.createDataFrame([("appoint_director", "f9", "Locked form", 0.7, True), ("change_company_name", "f8", "Not locked", 0.7, False), ("unknown", "", "x", 0.7, True)], "intent_action string, form_id string, form_name string, confidence double, locked boolean")
    fixes = q.where("query_id = 5").select(T.query_hash(F.lit("rename my company")).alias("query_hash"), F.lit("change_company_name").alias("action"))
    return forms.resolve(q, intents, freq, _forms(spark), over, fixes).where("rank IS NULL OR rank = 1").select("query_id", "path", "form_id")


_LONG = "This answer has more than a hundred and twenty characters, so that it counts as substantive, and goes on for a while without a source."


@expect("id, issues, failure_type", [
    (0, "form_hallucination:other form", "wrong_form"), (1, "missing_form", "wrong_form"), (2, "uncited_answer", "hallucination"), (3, "truncation", "incomplete"), (4, "", "wrong_source"), (5, "missing_form,uncited_answer", "wrong_form"), (6, "", "other"),
])
def auto_diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        (0, "form?", "See [Other Form](https://x/1) and [form A](https://x/2).", ["Form A"], "unknown"), (1, "how to register", "You can.", [], "unknown"), (2, "what is it", _LONG, [], "unknown"),
        (3, "what is it", "It was cut off before completion", [], "unknown"), (4, "what is it", f"{_LONG} **(Section 4)**", [], "retrieval"), (5, "how do I lodge", _LONG, [], "retrieval"), (6, "register", "I couldn't find this. " + _LONG, [], "unknown"),
    ]
    df = spark.createDataFrame(rows, "id int, query string, response string, shown array<string>, agent string").withColumn("i", R.diagnose(F.col("query"), F.col("response"), F.col("shown")))
    named = F.array_join(F.transform("i", lambda x: F.when(x["type"] == "form_hallucination", F.concat_ws(":", x["type"], x["detail"])).otherwise(x["type"])), ",")
    return df.select("id", named.alias("issues"), R.failure_type(F.col("i"), F.col("agent")).alias("failure_type"))


@expect("id, intent", [(0, "convert_public_to_private"), (1, "convert_private_to_public"), (2, "strike_off_company"), (3, "appoint_secretary"), (4, "lodge_annual_return"), (5, ""), (6, "incorporate_company")])
def keyword_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ["convert to a private company", "how to convert into a public one", "Strike-off my company", "appoint a new secretary", "annual  return due", "incorporate a company", "an incorporat form"]
    return _texts(spark, rows).select("id", R.keyword_intent(F.col("text")).alias("intent"))


@expect("id, issues", [(0, ""), (1, "Form 'A' not hyperlinked"), (2, "Response appears truncated"), (3, "Wrong SSM name used"), (4, "OOS response contains form links — inconsistent"), (5, "response_too_short")])
def validate_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, ok = [("A", "http://a")], "Use [A](http://a) to do so, as it is set out there."
    rows = [(0, ok, a), (1, "Use form A to do so, as it is set out there.", a), (2, "A complete sentence that breaks off here,", []), (3, "Ask the Jabatan Pendaftaran Syarikat about the matter.", []), (4, f"I couldn't find this in my knowledge base. {ok}", a), (5, "Yes.", [])]
    df = spark.createDataFrame(rows, "id int, text string, forms array<struct<name:string,url:string>>")
    return df.select("id", F.array_join(R.validation_issues(F.col("text"), F.col("forms")), ",").alias("issues"))


_NOTICE = "\n\n---\n⚠️ *The response was cut off before completion. Try asking a more specific question, or break it into smaller parts.*"


@expect("id, text", [
    (0, "As my knowledge base says, in my knowledge base."), (1, "❌ the CONTEXT"), (2, "Shown."), (3, f"It breaks off,{_NOTICE}"), (4, "I couldn't find this in my knowledge base. Ask SSM."),
    (5, "Saya tidak menemui maklumat ini dalam pangkalan pengetahuan saya."), (6, "Suruhanjaya Syarikat Malaysia (SSM)"), (7, "One\n\nTwo."),
])
def postprocess_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [
        ("As the CONTEXT provided says, in what I have access to.", "en"), ("❌ the CONTEXT", "en"), ("Shown.<think>hidden</think> gone", "en"), ("It breaks off,", "en"),
        ("I couldn't find this in my knowledge base. Ask SSM. More text follows. End.", "en"), ("I couldn't find this in my knowledge base.", "ms"), ("Jabatan Syarikat (SSM)", "en"), ("One\n\n\n\nTwo.", "en"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, text string, lang string")
    return df.select("id", R.postprocess(F.col("text"), F.col("lang")).alias("text"))


@expect("id, text", [
    (0, "Use [Form A](http://a) and Form A."), (1, "Use [S1](http://a) now."), (2, "Nothing here.\n\nYou can access the relevant form here: [Form A](http://a)"), (3, "See [x](http://a)."), (4, "Tiada.\n\nBorang berkaitan boleh diakses di sini: [Form A](http://a)"), (5, "Use [Form B](http://b)."),
])
def inject_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = ("Form A", "S1", "http://a"), ("Form B", "", "http://b")
    rows = [(0, "Use form a and Form A.", [a], "en"), (1, "Use s1 now.", [a], "en"), (2, "Nothing here. ", [a], "en"), (3, "See [x](http://a).", [a], "en"), (4, "Tiada.", [a], "ms"), (5, "Use form b.", [b, a], "en")]
    df = spark.createDataFrame(rows, "id int, text string, forms array<struct<name:string,number:string,url:string>>, lang string")
    return df.select("id", R.inject_links("text", "forms", "lang").alias("text"))


@expect("id, fixed, whole", [(0, '{"a": 1}', "[]"), (1, '{"a": "x\\ny"}', "[]"), (2, '{"a": "c:\\\\dir"}', "[]"), (3, None, '[{"content": "' + _P + '"}]'), (4, None, "[]"), (5, '{"a": "xy"}', "[]")])
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ['{"a": 1}', '{"a": "x\ny"}', '{"a": "c:\\dir"}', '[{"content": "' + _P + '"}, {"content": "cut o', "nothing", '{"a": "x\x01y"}']
    return _texts(spark, rows).select("id", R.repair_json_column("text").alias("fixed"), R.complete_objects_column("text").alias("whole"))


@expect("id, action, sections, confidence, actionable", [(0, "appoint_director", "58,201", 0.9, True), (1, "unknown", "41(1)", 0.5, False), (2, "hold_agm", "", 0.0, False), (3, None, None, None, None)], confidence="DOUBLE")
def intent_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ['{"action": "appoint_director", "likely_sections": ["58", "201"], "confidence": 0.9, "is_actionable": true}', '{"action": "do_magic", "likely_sections": [41(1)], "confidence": 0.5}', '{"action": "hold_agm", "reasoning": "it stops he', "not json"]
    rows[2] = '{"action": "hold_agm", "legal_procedure": "a meeting", "reasoning": "it stops he'
    df = _texts(spark, rows).withColumn("i", R.intent_column(F.col("text")))
    return df.select("id", "i.action", F.array_join("i.likely_sections", ",").alias("sections"), "i.confidence", F.col("i.is_actionable").alias("actionable"))


@expect("user, memory_type, tier, content", [
    ("a", "preference", "longterm", "Language preference: Please answer in Malay"), ("a", "preference", "longterm", "User role: I am a director"), ("b", "instruction", "longterm", "Formatting instruction: always cite section numbers"),
    ("b", "correction", "midterm", "User correction: that's wrong, it is section 5"),
])
def memory_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = datetime(2024, 1, 1)
    rows = [("a", "Please answer in Malay. I am a director"), ("a", "please answer in malay"), ("b", "always cite section numbers"), ("b", "that's wrong, it is section 5"), ("b", "hi"), ("b", "nothing to keep here")]
    df = spark.createDataFrame([(u, at + timedelta(minutes=i), t) for i, (u, t) in enumerate(rows)], "user string, ts timestamp, text string")
    return memory.suppress_repeats(memory.detect(df)).select("user", "memory_type", "tier", "content")


@expect("id, summary", [
    (0, "Under Section 68 you pay RM 150.00. Do so within 30 days. [Section 68, RM 150.00, 30 days] | Late fees apply."), (1, "One sentence only."), (2, ""), (3, "First. Second. | Second."),
])
def turn_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ["Under Section 68 you pay RM 150.00. Do so within 30 days. More. Late fees apply.", "One sentence only.", "", "First. Second."]
    return _texts(spark, rows).select("id", T.compress_turn(F.col("text")).alias("summary"))


@expect("seq, accepted", [*[(i, i <= 20 or i > 25) for i in range(1, 28)]])
def rate_limit_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty hits a minute: 25 hits in 25 seconds, then two when the first ones are 60 seconds old."""
    at = datetime(2024, 1, 1)
    rows = [(1, i, at + timedelta(seconds=i)) for i in range(1, 26)] + [(1, 26, at + timedelta(seconds=61)), (1, 27, at + timedelta(seconds=62))]
    return memory.accepted_hits(spark.createDataFrame(rows, "user long, seq int, ts timestamp")).select("seq", "accepted")


@expect('"user", ts', [("a", 3), ("a", 9)])
def malay_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", i + 1, x) for i, x in enumerate(["ms", "ms", "ms", "ms", "en", "en", "mixed", "mixed", "mixed"])] + [("b", i, "en") for i in range(5)] + [("c", 1, "ms"), ("c", 2, "mixed"), ("c", 3, "ms")]
    return memory.streaks(spark.createDataFrame(rows, "user string, ts int, lang string"), ["ms", "mixed"]).select("user", "ts")


@expect("id, text", [(0, "short"), (1, "row1\nrow2"), (2, "A sentence that is long enough to be kept in the passage as it stands. "), (3, "xxxxxxxxxx")])
def context_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ["short", "row1\nrow2\n[TABLE] and a row that is cut", "A sentence that is long enough to be kept in the passage as it stands. Then more text", "x" * 100]
    cut = lambda most: T.truncate_context(F.col("text"), most, 12)
    return _texts(spark, rows).select("id", F.when(F.col("id") == 1, cut(12)).when(F.col("id") == 3, cut(10)).otherwise(cut(72)).alias("text"))
