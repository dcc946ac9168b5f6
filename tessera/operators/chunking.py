"""Documents to chunks: one parser a document type.

Input: (source_key, source_name, text) rows, a document each. Output: the eight chunk columns
and chunk_no, the chunk's place in its document. The heading-driven types are window
programs over the exploded lines; the types whose rules depend on what was consumed before
are walked line by line inside Arrow batches, a document at a time, without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from tessera.functions import constants as C
from tessera.functions import text as T

LEAST, MOST = 60, 1500
CHUNK_COLUMNS = ["source_key", "source_name", "part", "division", "subdivision", "section", "section_title", "content"]
CHUNK_SCHEMA = ", ".join(f"{c} string" for c in CHUNK_COLUMNS) + ", chunk_no long"
CAPS = r"^[A-Z][A-Z\s/&\-\(\)\d]{3,}$"
LETTERED = r"^[A-Z]\.\s+\S"
PATTERNS = C.LINE_PATTERNS | {"caps": CAPS, "lettered": LETTERED}
_RE = {name: re.compile(p) for name, p in PATTERNS.items()}


def is_line(line: Column, *names: str) -> Column:
    """Whether a line is of one of the named kinds."""
    out = F.lit(False)
    for n in names:
        out = out | line.rlike(PATTERNS[n])
    return out


def line_class(line: Column) -> Column:
    """The first kind of noise or heading that a line is, in this order, or text."""
    order = ["toc", "page", "pu", "laws", "note", "pn", "faq_footer", "reg_toc", "gazette_header", "signing", "table_tag", "part", "division", "subdivision", "section", "caps", "lettered", "appendix", "para"]
    return F.coalesce(F.when(line == "", "blank"), *[F.when(is_line(line, n), n) for n in order], F.lit("text"))


# ---- splitting long text ----


def split_long(text: str, most: int = MOST) -> list[str]:
    """Pieces of up to `most` characters: cut at the last sentence end outside a table row, else the last blank, else hard. Tables stay whole."""
    if len(text) <= most or "[TABLE]" in text or text.count("|") > 3:
        return [text]
    out = []
    while len(text) > most:
        window = text[:most]
        ends = [m.end() for m in re.finditer(r"[.!?]\s+", window)]
        clear = [e for e in ends if window.rfind("|", 0, e) < 0 or window.rfind("\n", 0, e) > window.rfind("|", 0, e)]
        cut = clear[-1] if clear else window.rfind(" ")
        cut = cut if cut > 0 else most
        out.append(text[:cut].strip())
        text = text[cut:].strip()
    return [*out, text] if text else out


@F.udf(ArrayType(StringType()), useArrow=False)  # a hundred rows at a time; Arrow would hold thousands of texts and their pieces at once
def split_long_column(text: str) -> list[str]:
    return [p for p in (x.strip() for x in split_long(text or "")) if len(p) >= LEAST]


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Chunk columns and chunk_no, from rows that have those columns and an order within the document."""
    w = Window.partitionBy("source_key").orderBy(*order)
    return df.withColumn("chunk_no", F.row_number().over(w).cast("long")).select(*CHUNK_COLUMNS, "chunk_no")


def _pieces(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with `content` of LEAST characters or more, long ones split, as chunks."""
    df = df.withColumn("content", T.strip(F.col("content"))).where(F.length("content") >= LEAST)
    df = df.select("*", F.posexplode(split_long_column("content")).alias("piece", "text")).drop("content").withColumnRenamed("text", "content")
    return _numbered(df, [*order, "piece"])


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("source_key", "source_name", F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("pos", "line"))


# ---- heading-driven types, as windows ----


def parse_general(docs: DataFrame) -> DataFrame:
    """Practice notes, guidelines, circulars: headings begin chunks, ALL-CAPS ones name the part too."""
    noise = is_line(F.col("line"), "toc", "page", "pu", "laws", "note", "pn", "table_tag")
    df = _lines(docs).where((F.col("line") != "") & ~noise)
    line = F.col("line")
    opens = (F.length(line) >= 2) & ~line.rlike("[,;]$") & is_line(line, "caps", "lettered", "appendix", "para")
    w = Window.partitionBy("source_key").orderBy("pos")
    df = df.withColumn("opens", opens)
    df = df.withColumn("grp", F.sum(F.col("opens").cast("int")).over(w)).withColumn("part", F.last(F.when(F.col("opens") & is_line(line, "caps"), line), True).over(w))
    rows = F.array_sort(F.collect_list(F.when(~F.col("opens"), F.struct("pos", "line"))))
    g = df.groupBy("source_key", "source_name", "grp").agg(F.max(F.when(F.col("opens"), line)).alias("section"), F.max("part").alias("part"), rows.alias("rows"))
    g = g.select("source_key", "source_name", "grp", F.coalesce("part", F.lit("")).alias("part"), F.lit("").alias("division"), F.lit("").alias("subdivision"), F.coalesce("section", F.lit("")).alias("section"), F.coalesce("section", F.lit("")).alias("section_title"), F.array_join("rows.line", "\n").alias("content"))
    return _pieces(g, ["grp"])


def is_malay_line(line: Column) -> Column:
    """More Malay words than English ones, and fewer than three English ones."""
    count = lambda words: F.regexp_count(line, F.lit("(?iU)" + words))
    malay, english = count(C.MALAY_LINE_WORDS), count(C.ENGLISH_LINE_WORDS)
    return (malay > english) & (english < 3)


def is_gazette_heading(line: Column) -> Column:
    words = F.size(F.filter(F.split(line, r"\s+"), lambda x: x != ""))
    plain = ~is_line(line, "gazette_body", "prose") & ~line.rlike("[,;]$") & ~(line.endswith(".") & (F.length(line) > 40))
    return line.rlike("^[A-Z][a-z]") & (F.length(line) >= 3) & (F.length(line) <= 100) & (words <= 12) & plain & is_line(line, "gazette_heading")


def parse_gazette(docs: DataFrame) -> DataFrame:
    """Subsidiary legislation: the English body only, headings and schedules begin chunks."""
    w = Window.partitionBy("source_key").orderBy("pos")
    line = F.col("line")
    body = F.when(is_line(line, "malay_start"), "malay").when(is_line(line, "english_start"), "english")
    df = _lines(docs).withColumn("start", body).withColumn("body", F.last("start", True).over(w))
    noise = is_line(line, "toc", "page", "pu_header", "gazette_header", "reg_toc", "table_tag", "laws", "note", "signing")
    begins = F.coalesce(F.col("start") == "english", F.lit(False))
    in_malay = F.coalesce(F.col("body") == "malay", F.lit(False))
    df = df.where(begins | (~in_malay & (line != "") & ~noise & ~is_malay_line(line)))
    schedule = ~begins & F.coalesce(F.col("body") == "english", F.lit(False)) & is_line(line, "schedule")
    df = df.withColumns({"begins": begins, "schedule": schedule})
    df = df.withColumns({"in_schedule": F.max("schedule").over(w), "name": F.last(F.when(F.col("schedule"), line), True).over(w)})
    free = ~F.col("begins") & ~F.col("schedule")
    caps = free & F.col("in_schedule") & is_line(line, "caps") & ~is_line(line, "schedule_column")
    head = free & ~F.col("in_schedule") & is_gazette_heading(line)
    df = df.withColumns({"caps": caps, "head": head})
    short = F.size(F.filter(F.split(line, r"\s+"), lambda x: x != "")) <= 8
    heading = F.when(F.col("schedule") | F.col("head"), line).when(F.col("caps"), F.concat("name", F.lit(" - "), line))
    df = df.withColumns({
        "heading": F.last(heading, True).over(w),
        "part": F.last(F.when(F.col("schedule") | (F.col("head") & short), line), True).over(w),
        "grp": F.sum((F.col("begins") | F.col("schedule") | F.col("head")).cast("int")).over(w),
        "content_line": ~(F.col("begins") | F.col("schedule") | F.col("caps") | F.col("head")),
    })
    last = lambda c: F.max_by(c, "pos")
    g = df.groupBy("source_key", "source_name", "grp").agg(last("heading").alias("section"), last("part").alias("part"), F.array_sort(F.collect_list(F.when(F.col("content_line"), F.struct("pos", "line")))).alias("rows"))
    g = g.select("source_key", "source_name", "grp", F.coalesce("part", F.lit("")).alias("part"), F.lit("").alias("division"), F.lit("").alias("subdivision"), F.coalesce("section", F.lit("")).alias("section"), F.coalesce("section", F.lit("")).alias("section_title"), F.array_join("rows.line", "\n").alias("content"))
    return _pieces(g, ["grp"])


def parse_slides(slides: DataFrame) -> DataFrame:
    """(source_key, source_name, slide_number, title, body, tables, notes) rows: a chunk a slide, untitled ones carry the last title on."""
    clean = lambda c: T.strip(F.coalesce(c, F.lit("")))
    notes = clean("notes")
    notes = F.when(notes.rlike(PATTERNS["slide_notes"]), "").otherwise(notes)
    parts = F.filter(F.array(clean("body"), clean("tables"), F.when(notes != "", F.concat(F.lit("[SPEAKER NOTES]\n"), notes)).otherwise("")), lambda x: x != "")
    df = slides.select("source_key", "source_name", "slide_number", clean("title").alias("title"), T.strip(F.array_join(parts, "\n\n")).alias("content")).where(F.length("content") >= LEAST)
    last = F.coalesce(F.last(F.nullif("title", F.lit("")), True).over(Window.partitionBy("source_key").orderBy("slide_number")), F.lit(""))
    df = df.withColumn("last", last)
    number = F.concat(F.lit("Slide "), F.col("slide_number").cast("string"))
    label = F.when(F.col("title") != "", F.concat(number, F.lit(": "), "title")).when(F.col("last") != "", F.concat(number, F.lit(" ("), "last", F.lit(" – cont.)"))).otherwise(number)
    df = df.withColumn("label", label).select("*", F.posexplode(split_long_column("content")).alias("piece", "text"))
    section = F.when(F.col("piece") == 0, F.col("label")).otherwise(F.concat("label", F.lit(" (part "), (F.col("piece") + 1).cast("string"), F.lit(")")))
    out = df.select("source_key", "source_name", "slide_number", "piece", F.col("last").alias("part"), F.lit("").alias("division"), F.lit("").alias("subdivision"), section.alias("section"), F.col("title").alias("section_title"), F.col("text").alias("content"))
    return _numbered(out, ["slide_number", "piece"])


# ---- types whose rules depend on what came before, a document at a time ----


def _is(line: str, *names: str) -> bool:
    return any((_RE[n].search if n == "toc" else _RE[n].match)(line) for n in names)


#: Heading levels, with the kinds of a following line that is not their title.
LEVELS = {
    "part": ("part", "section", "toc", "page", "laws"),
    "division": ("part", "division", "section", "toc"),
    "subdivision": ("part", "division", "subdivision", "section", "toc"),
}
_STRUCTURE = (*LEVELS, "section", "toc", "page")


def marginal_note(line: str) -> bool:
    return _is(line, "marginal") and not _is(line, "starter", *_STRUCTURE)


def act_sections(text: str) -> Iterator[dict]:
    """Sections of an act under their part, division and subdivision.

    A heading's title is the next line that isn't blank, unless that is structure. A
    marginal note at a section's end is the title of the next one.
    """
    todo = [x for x in map(str.strip, reversed(text.splitlines())) if x]  # a stack, next line last
    place = {"part": "General", "division": "", "subdivision": ""}
    section, title, body, waiting, before = "", "", [], "", ""

    def finish() -> Iterator[dict]:
        nonlocal waiting
        if not section:
            return
        note = body.pop() if body and marginal_note(body[-1]) else ""
        waiting = note or waiting
        content = "\n".join(body).strip()
        if len(content) >= LEAST:
            yield {**place, "section": section, "section_title": title, "content": content}

    while todo:
        line = todo.pop()
        if _is(line, "toc", "page", "pu", "laws", "note", "table_tag"):
            continue
        level = next((x for x in LEVELS if _is(line, x)), None)
        if level:
            yield from finish()
            section, body = "", []
            for lower in list(LEVELS)[list(LEVELS).index(level) :]:
                place[lower] = ""
            named = todo and not _is(todo[-1], *LEVELS[level])
            place[level] = f"{line}: {todo.pop()}" if named else line
        elif m := _RE["section"].match(line):
            yield from finish()
            section, body, inline = f"Section {m[1].strip()}", [], m[2].strip()
            guess = before if before and not _is(before, "laws", *_STRUCTURE) else ""
            title = inline or waiting or guess
            waiting = "" if inline or waiting else waiting
        else:
            if section:
                body.append(line)
            before = line
    yield from finish()


def faq_heading(line: str) -> bool:
    if len(line) < 4 or line[-1] in "?.:":
        return False
    title = _is(line, "faq_title") and not any(map(str.isdigit, line)) and len(line.split()) >= 3
    return (_is(line, "caps") and not _is(line, "page")) or title


def faq_pairs(text: str) -> Iterator[dict]:
    """Questions with their answers, in four styles, under the last heading; long lines elsewhere stand alone."""
    heading, question, answer, state, before = "", "", [], "between", ""

    def row(title: str, content: str) -> dict:
        return {"part": heading, "section": heading, "section_title": title, "content": content}

    def finish() -> Iterator[dict]:
        # without a question nothing is settled: loose answer lines go to the next pair
        nonlocal question, state
        if question:
            said = "\n".join(answer).strip()
            if said:
                yield row(question[:120], f"Q: {question}\n\nA: {said}")
            elif len(question) >= LEAST:
                yield row(question[:120], question)
            question, state = "", "between"
            answer.clear()

    for line in map(str.strip, text.splitlines()):
        if not line or _is(line, "toc", "page", "pu", "laws", "note", "pn", "faq_footer", "table_tag"):
            continue
        asked = next(((n, m) for n in ("question_colon", "question_word", "question_number") if (m := _RE[n].match(line))), None)
        told = next((m for n in ("answer_colon", "answer_word") if (m := _RE[n].match(line))), None)
        if faq_heading(line) and not _RE["question_number"].match(line):
            yield from finish()
            heading, state = line, "between"
        elif asked:
            yield from finish()
            question = (asked[1][2 if asked[0] == "question_number" else 1] or "").strip()
            state = "question"
        elif told:
            if state == "between" and before.endswith("?"):
                yield from finish()
                question = before
            if first := (told[1] or "").strip():
                answer.append(first)
            state = "answer"
        elif state == "question":
            question = f"{question} {line}".strip()
        elif state == "answer":
            answer.append(line)
        elif len(line) >= LEAST:
            yield row("", line)
        before = line
    yield from finish()


_VISUAL = re.compile(r"\[VISUAL DESCRIPTION\](.*?)\[/VISUAL DESCRIPTION\]", re.S)
_BREAK = re.compile(r"(?<=[.!?])\s+|\n{2,}")


def _windows(text: str, most: int) -> Iterator[str]:
    """text in pieces of up to `most` characters, each as long as it can be to end at a break, else of `most`."""
    breaks = [m.end() for m in _BREAK.finditer(text)]
    begin = 0
    while begin < len(text):
        i = bisect_right(breaks, begin + most)
        end = breaks[i - 1] if i and breaks[i - 1] > begin else begin + most
        yield text[begin:end]
        begin = end


def other_chunks(text: str, most: int = 1200) -> Iterator[dict]:
    """Visual descriptions whole, the text between them in windows that end at a sentence's end or a blank line."""
    number = 0
    for i, part in enumerate(_VISUAL.split(text)):  # every second part is a description
        for piece in [part] if i % 2 else _windows(part, most):
            if len(piece := piece.strip()) >= LEAST:
                number += 1
                yield {"section": f"{'Visual' if i % 2 else 'Section'} {number}", "content": piece}


#: Characters of chunks after which a task hands them on.
HANDED_ON = 1 << 20


def _walk(docs: DataFrame, parser: Callable[[str], Iterator[dict]]) -> DataFrame:
    """The chunks of all documents: a text at a time is a Python string, and few chunks wait."""
    schema = pa.schema([(c, pa.string()) for c in CHUNK_COLUMNS] + [("chunk_no", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for batch in batches:
            for doc in range(len(batch)):
                key, name, text = (batch.column(c)[doc].as_py() for c in range(3))
                for i, r in enumerate(parser(text or ""), 1):
                    rows.append((key, name, *(r.get(c, "") for c in CHUNK_COLUMNS[2:]), i))
                    chars += len(r["content"])
                    if chars >= HANDED_ON:
                        yield _batch(rows, schema)
                        rows, chars = [], 0
        if rows:
            yield _batch(rows, schema)

    return docs.select(*(F.col(c).cast("string") for c in ("source_key", "source_name", "text"))).mapInArrow(run, CHUNK_SCHEMA)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def parse_act(docs: DataFrame) -> DataFrame:
    return _walk(docs, act_sections)


def parse_faq(docs: DataFrame) -> DataFrame:
    return _walk(docs, faq_pairs)


def parse_others(docs: DataFrame) -> DataFrame:
    return _walk(docs, other_chunks)


PARSERS = {"act": parse_act, "general": parse_general, "faq": parse_faq, "gazette": parse_gazette, "slide": parse_others, "others": parse_others}


def parse(docs: DataFrame) -> DataFrame:
    """Documents with doc_type, each by the parser of its type; unknown types give no chunks, as sources without any do."""
    out = None
    cleaned = docs.withColumn("text", T.clean_text(F.col("text")))
    for kind, parser in PARSERS.items():
        part = parser(cleaned.where(F.col("doc_type") == kind))
        out = part if out is None else out.unionByName(part)
    return out


def register(spark) -> None:
    """SQL names for the parsers as table functions, and for the splitter."""
    from pyspark.sql.functions import udtf

    spark.udf.register("split_long", split_long_column)
    for name, parser in (("parse_act", act_sections), ("parse_faq", faq_pairs), ("chunk_text", other_chunks)):

        class Parser:
            _parser = staticmethod(parser)

            def eval(self, text: str):
                for i, r in enumerate(self._parser(text or ""), 1):
                    yield (i, *(r.get(c, "") for c in CHUNK_COLUMNS[2:]))

        spark.udtf.register(name, udtf(Parser, returnType="chunk_no int, " + ", ".join(f"{c} string" for c in CHUNK_COLUMNS[2:])))

    class RunningSizes:
        """Over TABLE(...) PARTITION BY key ORDER BY place: the key, the place, the running size of the texts, and the size of the one before."""

        @staticmethod
        def analyze(rows):
            from pyspark.sql.types import LongType, StructType
            from pyspark.sql.udtf import AnalyzeResult

            if not rows.isTable or len(rows.dataType.fields) != 3:
                raise ValueError("a table of a key, a place and a text")
            key, place, _ = rows.dataType.fields
            return AnalyzeResult(StructType().add(key.name, key.dataType).add(place.name, place.dataType).add("chars", LongType()).add("before", LongType()))

        def __init__(self):
            self.chars, self.last = 0, 0

        def eval(self, row):
            size = len(row[2] or "")
            self.chars += size
            yield row[0], row[1], self.chars, self.last
            self.last = size

    spark.udtf.register("running_sizes", udtf(RunningSizes))
