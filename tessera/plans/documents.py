"""Queries over documents and vectors as sources, files, pages and chunks, with their SQL.

The tables' prose has no headings, questions or schedules; where a parser needs them, lines
are made headed by a rule on their numbers, the same in both forms, over all lines of all
documents. Bars are made slashes, so that no line is taken for a table's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import text as T
from tessera.functions.vectors import unit
from tessera.operators import chunking, search, store
from tessera.plans.tables import _INDEX, WINDOWS_SQL, _chunks, _questions
from tessera.plans.turns import _pick, _pick_sql, _q
from tessera.session import scratch, table
from tessera.session import store as store_table
from tessera.sources import registry as sources
from tessera.streaming import jobs

QUERIES: list[tuple] = []
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def sql(text: str):
    def mark(f):
        QUERIES.append((f, text))
        return f

    return mark


# ---- sources ----

_EXT = [".pdf", ".CSV", ".pptx", ".png", ".txt", ".PDF"]


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path a document: category, type and extension by its number, some of unknown ones; two documents may share a name."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    return d.select(F.concat(F.lit("/data/"), _pick([*C.CATEGORIES, "Drafts"], n), F.lit("/"), _pick([*C.DOC_TYPES, "memo"], n), F.lit("/"), "source", F.lit(" No. "), F.floor(n / 3).cast("string"), _pick(_EXT, n)).alias("path"))


_RANK = "CASE category " + " ".join(f"WHEN {_q(c)} THEN {i}" for i, c in enumerate(C.CATEGORIES)) + " END"
_FOUND = rf"""pa AS (SELECT {_pick_sql([*C.CATEGORIES, 'Drafts'], 'doc_id')} AS category, {_pick_sql([*C.DOC_TYPES, 'memo'], 'doc_id')} AS doc_type, source || ' No. ' || (doc_id // 3) AS name, {_pick_sql(_EXT, 'doc_id')} AS ext FROM documents),
pb AS (SELECT *, regexp_replace(regexp_replace(lower(name || ext), '\.[^.]*$', ''), '[^a-z0-9]+', '_', 'g') AS key0, '/data/' || category || '/' || doc_type || '/' || name || ext AS path FROM pa WHERE category <> 'Drafts' AND doc_type <> 'memo' AND ext <> '.txt'),
found AS (SELECT regexp_replace(key0, '^_+|_+$', '', 'g') AS key, name, category, CASE lower(ext) WHEN '.csv' THEN 'csv' WHEN '.pptx' THEN 'pptx' WHEN '.png' THEN 'image' ELSE 'pdf' END AS type, doc_type, path FROM pb
  QUALIFY row_number() OVER (PARTITION BY key0 ORDER BY {_RANK}, doc_type, path) = 1)"""


@sql(f"""WITH {_FOUND} SELECT key, name, category, type, doc_type, CASE WHEN type = 'csv' THEN 'csv' WHEN type = 'image' THEN 'image' WHEN type = 'pptx' THEN 'slides' WHEN doc_type = 'slide' THEN 'others' ELSE doc_type END AS route FROM found""")
def found_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.route(sources.from_paths(_paths(spark, sf_dir))).select("key", "name", "category", "type", "doc_type", "route")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An override for every second document's name, with some fields missing, and some for sources that no folder has."""
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents").where("doc_id % 6 = 0")
    key = F.concat(F.regexp_replace(F.lower("source"), "[^a-z0-9]+", "_"), F.lit("_no_"), F.floor(n / 3).cast("string"), F.when(n % 12 == 0, "").otherwise("_x"))
    none = F.lit(None).cast("string")
    return d.select(key.alias("key"), F.when(n % 4 == 0, F.concat(F.lit("Named "), n.cast("string"))).alias("name"), F.when(n % 18 == 0, "Forms").alias("category"), F.when(n % 30 == 0, "csv").alias("type"), F.when(n % 24 == 0, "faq").alias("doc_type"), F.when(n % 60 == 0, False).alias("enabled"), F.when(n % 36 == 0, F.array(F.lit("LLP Act 2012"))).alias("relates_to_acts"), none.alias("url"), none.alias("local_path"))


@sql(rf"""WITH {_FOUND}, j AS (SELECT regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g') || '_no_' || (n // 3) || CASE WHEN n % 12 = 0 THEN '' ELSE '_x' END AS key, CASE WHEN n % 4 = 0 THEN 'Named ' || n END AS name, CASE WHEN n % 18 = 0 THEN 'Forms' ELSE '' END AS category, CASE WHEN n % 30 = 0 THEN 'csv' ELSE 'pdf' END AS type, CASE WHEN n % 24 = 0 THEN 'faq' ELSE 'act' END AS doc_type, n % 60 <> 0 AS enabled, CASE WHEN n % 36 = 0 THEN 'LLP Act 2012' ELSE '' END AS acts FROM (SELECT source, doc_id AS n FROM documents WHERE doc_id % 6 = 0))
SELECT coalesce(f.key, j.key) AS key, coalesce(j.name, f.name, j.key) AS name, coalesce(nullif(j.category, ''), f.category, '') AS category, coalesce(j.type, f.type) AS type, coalesce(j.doc_type, f.doc_type) AS doc_type, coalesce(j.enabled, true) AS enabled, coalesce(j.acts, '') AS acts FROM found f FULL JOIN j ON f.key = j.key""")
def merged_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sources.merge(sources.from_paths(_paths(spark, sf_dir)), sources.override_defaults(_entries(spark, sf_dir)))
    return m.select("key", "name", "category", "type", "doc_type", "enabled", F.array_join("relates_to_acts", ",").alias("acts"))


@sql(f"""WITH {_FOUND}, k AS (SELECT unnest([{', '.join(map(_q, C.CATEGORIES))}]) AS category) SELECT k.category, coalesce(string_agg(name, ';' ORDER BY encode(name)), '') AS names FROM k LEFT JOIN found USING (category) GROUP BY 1""")
def sources_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.by_category(sources.from_paths(_paths(spark, sf_dir))).select("category", F.array_join("names", ";").alias("names"))


_BY_ACT = ["what does the companies act say ", "an llp partner ", "a sole proprietorship ", "nothing of it "]


@sql(f"""WITH s AS (SELECT source AS key, any_value(regexp_extract(source, '[0-9]+')::INT) AS n FROM documents GROUP BY 1), q AS (SELECT conv_id, turn, [{_q(C.COMPANIES)}, {_q(C.LLP)}, {_q(C.BUSINESSES)}, NULL][(conv_id + turn) % 4 + 1] AS act FROM conversations WHERE role = 'user')
SELECT conv_id || '-' || turn AS query_id, key AS source_key FROM q JOIN s ON n % 5 <> 4 AND (act IS NULL OR n % 3 = 0 OR CASE n % 3 WHEN 1 THEN {_q(C.COMPANIES)} ELSE {_q(C.LLP)} END = act)""")
def pruned_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources each question may search: sources have acts by their numbers, questions name one."""
    s = table(spark, sf_dir, "documents").select(F.col("source").alias("key")).distinct()
    n = F.regexp_extract("key", "[0-9]+", 0).cast("int")
    acts = F.when(n % 3 == 0, F.array().cast("array<string>")).when(n % 3 == 1, F.array(F.lit(C.COMPANIES))).otherwise(F.array(F.lit(C.LLP)))
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    q = c.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.concat(_pick(_BY_ACT, F.col("conv_id") + F.col("turn")), "text").alias("text"))
    return search.prune_sources(q, s.withColumns({"enabled": n % 5 != 4, "relates_to_acts": acts}))


@sql(r"""SELECT source AS source_key, doc_id, 'Title ' || doc_id AS section_title, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS part, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 60""")
def foreign_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a foreign table with its own column names."""
    d = table(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("Part"), F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("Title"), F.col("doc_id").cast("string").alias("section"), F.col("text").alias("Body"))
    out = sources.external_chunks(d, "x", "Foreign").withColumn("doc_id", F.col("section").cast("long"))
    of = d.select(F.col("section").cast("long").alias("doc_id"), F.col("source").alias("source_key"))
    return out.drop("source_key").join(of, "doc_id").select("source_key", "doc_id", "section_title", "part", F.md5(F.col("content").cast("binary")).alias("digest"))


@sql(WINDOWS_SQL)
def chunk_files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of all documents written as chunk files by source, and read again."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_key"), F.col("source").alias("source_name"), "text")
    at = scratch(spark)
    sources.write_chunks(chunking.parse_others(d).withColumn("id", F.col("source_key")).withColumn("source_key", F.col("source_name")), at)
    return spark.read.parquet(at).withColumn("source_key", F.col("id")).select(*chunking.CHUNK_COLUMNS, "chunk_no")


@sql(f"""WITH w AS (SELECT source_key AS key, count(*) AS n FROM ({WINDOWS_SQL}) GROUP BY 1) SELECT doc_id::VARCHAR AS key, CASE WHEN n > 0 AND doc_id % 9 <> 8 THEN 'ok' ELSE 'failed' END AS status, CASE WHEN doc_id % 9 = 8 THEN 0 ELSE coalesce(n, 0) END AS n FROM (SELECT * REPLACE (replace(text, 'x', 'x') AS text) FROM documents) LEFT JOIN w ON key = doc_id::VARCHAR""")
def processed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sources of slides as PDF, some of an unknown type, through the reader of their route."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string").alias("key")
    s = d.select(key, F.col("source").alias("name"), F.lit("pdf").alias("type"), F.when(F.col("doc_id") % 9 == 8, "memo").otherwise("slide").alias("doc_type"))
    return sources.process(s, d.select(key, "text"))[1]


@sql("SELECT source, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source saved as two versions; the later one counts."""
    at, d = scratch(spark), table(spark, sf_dir, "documents")
    for version, rows in ((9, d), (10, d.where("doc_id % 2 = 0"))):
        store.save_state(rows.groupBy("source").agg(F.count("*").alias("n")), at, version)
    return store.load_state(spark, at, "source string, n long")


@sql("SELECT strlen(text) AS length, count(*) AS n FROM documents GROUP BY 1")
def ingested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files that come in two runs, each file once."""
    d, root, out, state = table(spark, sf_dir, "documents"), scratch(spark), scratch(spark), scratch(spark)
    for i in range(2):
        d.where(F.col("doc_id") % 2 == i).select("text").write.option("lineSep", "\x00").text(f"{root}/run={i}")
        files = jobs.new_files(spark, f"{root}/*/part-*").select(F.explode(F.split(F.col("content").cast("string"), "\x00")).alias("text")).where("text <> ''")
        files.select(F.octet_length("text").alias("length")).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy(F.col("length").cast("long").alias("length")).agg(F.count("*").alias("n"))


# ---- text ----

_PLAIN = "replace(text, '|', '/')"


def _pieces_sql(content: str = "content", most: int = 1500) -> str:
    """CTEs that cut the rows of `whole` (k, content) into `piece` (k, i, content)."""
    return rf"""cutting AS (SELECT k, 0 AS i, NULL::VARCHAR AS content, content AS rest FROM whole
  UNION ALL SELECT k, i + 1, CASE WHEN length(rest) <= {most} THEN rest ELSE {_STRIP.format('left(rest, cut)')} END, CASE WHEN length(rest) <= {most} THEN '' ELSE {_STRIP.format('substr(rest, cut + 1)')} END
  FROM (SELECT *, CASE WHEN length(ends) > 0 THEN length(ends) WHEN blank > 0 THEN blank ELSE {most} END AS cut FROM (SELECT *, regexp_extract(left(rest, {most}), '(?s)^(.*[.!?]\s+)', 1) AS ends, length(regexp_extract(left(rest, {most}), '(?s)^(.*) ', 1)) AS blank FROM cutting WHERE rest <> ''))),
piece AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS i, {_STRIP.format('content')} AS content FROM cutting WHERE i > 0 AND length({_STRIP.format('content')}) >= 60)"""


@sql(f"WITH RECURSIVE whole AS (SELECT doc_id AS k, {_PLAIN} AS content FROM documents), {_pieces_sql()} SELECT k AS doc_id, i::INT AS pos, md5(content) AS digest FROM piece")
def document_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.split_long_column(F.replace("text", F.lit("|"), F.lit("/")))).alias("pos", "piece"))
    return d.select("doc_id", "pos", F.md5(F.col("piece").cast("binary")).alias("digest"))


@sql(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text || ' x', '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def sanitized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with tags around it and private-use characters in it."""
    t = F.concat(F.lit("[OCR PAGE 3]\n"), "text", F.lit(" [/TABLE]x[/IMAGE TEXT]"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.sanitize(t).cast("binary")).alias("digest"))


@sql(r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM (SELECT doc_id, substr(text, 1 + (doc_id % 3) * 7) AS text FROM documents))
SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 30 OR list_sum(list_transform(w, lambda x: length(x))) / greatest(len(w), 1) < 2.5 OR length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) / greatest(length(text), 1) < 0.4 OR (len(w) > 30 AND len(regexp_extract_all(text, '[.!?]\s')) = 0) AS diagram FROM w""")
def diagram_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.substr(F.col("text"), (F.col("doc_id") % 3 * 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", T.looks_like_diagram(t).alias("diagram"))


# ---- parsers: lines made headed by a rule ----

_LINE = rf"""line AS (SELECT doc_id, n, {_STRIP.format('x')} AS x FROM (SELECT doc_id, unnest(range(len(ls))) AS n, unnest(ls) AS x FROM (SELECT doc_id, string_split(replace({_PLAIN}, chr(13), ' '), chr(10)) AS ls FROM documents)))"""


def _headed(spark: SparkSession, sf_dir: str, before) -> DataFrame:
    """Documents with `before` put as lines of its own before lines; it takes a line's number."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.split(F.translate("text", "|\r", "/ "), "\n").alias("ls"))
    made = F.transform("ls", lambda x, n: F.concat(before(n), F.lit("… "), T.strip(x)))
    return d.select(F.col("doc_id").cast("string").alias("source_key"), F.col("source").alias("source_name"), F.array_join(made, "\n").alias("text"))


def _at(n, every: int, at: int):
    return F.pmod(n, F.lit(every)) == at


def _text(n, head: str, tail: str, value=None):
    return F.concat(F.lit(head), (n if value is None else value).cast("string"), F.lit(tail))


@sql(rf"""WITH RECURSIVE {_LINE}, s AS (SELECT doc_id, n // 3 AS sec, min(n) AS first, string_agg('… ' || x, chr(10) ORDER BY n) AS content FROM line GROUP BY 1, 2),
t AS (SELECT *, 'PART ' || (1 + first // 12) || ': Part title ' || (first // 12) AS part, CASE WHEN first % 12 >= 6 THEN 'Division ' || (1 + first // 6) || ': Division title' ELSE '' END AS division FROM s)
SELECT doc_id::VARCHAR AS source_key, part, division, 'Section ' || (first + 1) || 'A' AS section, 'Title of ' || first AS section_title, md5({_STRIP.format('content')}) AS digest, (row_number() OVER (PARTITION BY doc_id ORDER BY first)) AS chunk_no FROM t WHERE length({_STRIP.format('content')}) >= 60""")
def act_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part every twelve lines, a division amid it, a section every three lines."""

    def before(n):
        part = F.when(_at(n, 12, 0), F.concat(_text(n, "PART ", "\n", F.floor(n / 12) + 1), _text(n, "Part title ", "\n", F.floor(n / 12)))).otherwise("")
        division = F.when(_at(n, 12, 6), _text(n, "Division ", "\nDivision title\n", F.floor(n / 6) + 1)).otherwise("")
        return F.concat(part, division, F.when(_at(n, 3, 0), F.concat(_text(n, "Section ", "A. ", n + 1), _text(n, "Title of ", "\n"))).otherwise(""))

    out = chunking.parse_act(_headed(spark, sf_dir, before))
    return out.select("source_key", "part", "division", "section", "section_title", F.md5(F.col("content").cast("binary")).alias("digest"), "chunk_no")


@sql(rf"""WITH RECURSIVE {_LINE}, g AS (SELECT doc_id, n // 4 AS g, min(n) AS first, {_STRIP.format("string_agg('… ' || x, chr(10) ORDER BY n)")} AS content FROM line GROUP BY 1, 2),
whole AS (SELECT (doc_id, first) AS k, content FROM g WHERE length(content) >= 60), {_pieces_sql()}
SELECT k[1]::VARCHAR AS source_key, 'GENERAL MATTERS ' || chr((65 + k[2] // 12 % 20)::INT) AS part, CASE WHEN k[2] % 12 = 0 THEN 'GENERAL MATTERS ' || chr((65 + k[2] // 12 % 20)::INT) ELSE chr((65 + k[2] % 12 // 4)::INT) || '. Matter ' || k[2] END AS section, md5(content) AS digest, row_number() OVER (PARTITION BY k[1] ORDER BY k[2], i) AS chunk_no FROM piece""")
def general_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading in capitals every twelve lines, a lettered one at every fourth between, page numbers and notes as noise."""
    letter = lambda v: F.chr((v + 65).cast("int"))

    def before(n):
        noise = F.when(_at(n, 5, 2), F.lit("12\nNOTE- left out\n")).otherwise("")
        caps = F.concat(F.lit("GENERAL MATTERS "), letter(F.pmod(F.floor(n / 12), F.lit(20))), F.lit("\n"))
        lettered = F.concat(letter(F.floor(F.pmod(n, F.lit(12)) / 4)), _text(n, ". Matter ", "\n"))
        return F.concat(noise, F.when(_at(n, 12, 0), caps).when(_at(n, 4, 0), lettered).otherwise(""))

    out = chunking.parse_general(_headed(spark, sf_dir, before))
    return out.select("source_key", "part", "section", F.md5(F.col("content").cast("binary")).alias("digest"), "chunk_no")


@sql(rf"""WITH {_LINE}, p AS (SELECT doc_id, n // 3 AS pair, min(n) AS first, string_agg('… ' || x, chr(10) ORDER BY n) FILTER (n % 3 > 0) AS answer, any_value('… ' || x) FILTER (n % 3 = 0) AS rest FROM line GROUP BY 1, 2),
q AS (SELECT *, 'What of ' || first || '? ' || rest AS question FROM p),
r AS (SELECT *, {_STRIP.format("answer")} AS said FROM q),
z AS (SELECT doc_id, first, left({_STRIP.format('question')}, 120) AS section_title, CASE WHEN said IS NOT NULL THEN 'Q: ' || {_STRIP.format('question')} || chr(10) || chr(10) || 'A: ' || said WHEN length({_STRIP.format('question')}) >= 60 THEN {_STRIP.format('question')} END AS content FROM r)
SELECT doc_id::VARCHAR AS source_key, 'ASKED OFTEN ' || chr((65 + first // 9 % 20)::INT) AS section, section_title, md5(content) AS digest, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS chunk_no FROM z WHERE content IS NOT NULL""")
def faq_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question every three lines, by turns as `Q:` and as `Question:`, whose answer is the other two; a heading every nine."""

    def before(n):
        head = F.when(_at(n, 9, 0), F.concat(F.lit("ASKED OFTEN "), F.chr((F.pmod(F.floor(n / 9), F.lit(20)) + 65).cast("int")), F.lit("\n"))).otherwise("")
        asked = F.concat(F.when(_at(n, 2, 0), "Q: ").otherwise("Question: "), _text(n, "What of ", "? "))
        return F.concat(head, F.when(_at(n, 3, 0), asked).when(_at(n, 3, 1), F.when(_at(n, 2, 0), "A: ").otherwise("Answer: ")).otherwise(""))

    out = chunking.parse_faq(_headed(spark, sf_dir, before))
    return out.select("source_key", "section", "section_title", F.md5(F.col("content").cast("binary")).alias("digest"), "chunk_no")


@sql(rf"""WITH RECURSIVE {_LINE}, body AS (SELECT doc_id, n // 6 AS g, min(n) AS first, {_STRIP.format("string_agg('… ' || x, chr(10) ORDER BY n)")} AS content FROM line WHERE n >= 6 GROUP BY 1, 2),
whole AS (SELECT (doc_id, first) AS k, content FROM body WHERE length(content) >= 60), {_pieces_sql()}
SELECT k[1]::VARCHAR AS source_key, CASE WHEN k[2] % 12 = 0 THEN 'Electronic filing rules ' ELSE 'Keeping of registers ' END || k[2] AS section, md5(content) AS digest, row_number() OVER (PARTITION BY k[1] ORDER BY k[2], i) AS chunk_no FROM piece""")
def gazette_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six lines as the Malay body, then the English one with a heading every six lines."""

    def before(n):
        malay = F.when(n == 0, F.lit("PADA menjalankan kuasa\n")).otherwise("")
        head = F.concat(F.when(_at(n, 12, 0), "Electronic filing rules ").otherwise("Keeping of registers "), n.cast("string"), F.lit("\n"))
        start = F.when(n == 6, F.lit("IN exercise of the powers\n")).otherwise("")
        return F.concat(malay, start, F.when((n >= 6) & _at(n, 6, 0), head).otherwise(""))

    out = chunking.parse_gazette(_headed(spark, sf_dir, before))
    return out.select("source_key", "section", F.md5(F.col("content").cast("binary")).alias("digest"), "chunk_no")


@sql(rf"""WITH RECURSIVE d AS (SELECT source, doc_id, CASE WHEN doc_id % 60 < 20 THEN 'Topic ' || doc_id ELSE '' END AS title, {_STRIP.format(f"{_STRIP.format(_PLAIN)} || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '[SPEAKER NOTES]' || chr(10) || 'say it slowly' ELSE '' END")} AS content FROM documents),
whole AS (SELECT doc_id AS k, content FROM d WHERE length(content) >= 60), {_pieces_sql()},
l AS (SELECT d.*, coalesce(last_value(nullif(title, '') IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING), '') AS last FROM d JOIN whole ON k = doc_id),
n AS (SELECT *, 'Slide ' || doc_id || CASE WHEN title <> '' THEN ': ' || title WHEN last <> '' THEN ' (' || last || ' – cont.)' ELSE '' END AS label FROM l)
SELECT source AS source_key, last AS part, label || CASE WHEN i > 0 THEN ' (part ' || (i + 1) || ')' ELSE '' END AS section, md5(piece.content) AS digest, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS chunk_no FROM n JOIN piece ON k = doc_id""")
def slide_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as slides of their source: a third has a title, every second one has notes."""
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("source_key"), F.col("source").alias("source_name"), n.cast("int").alias("slide_number"), F.when(n % 60 < 20, F.concat(F.lit("Topic "), n.cast("string"))).alias("title"), F.replace("text", F.lit("|"), F.lit("/")).alias("body"), F.lit("").alias("tables"), F.when(n % 2 == 0, "say it slowly").when(n % 3 == 0, "Click to add notes").alias("notes"))
    return chunking.parse_slides(d).select("source_key", "part", "section", F.md5(F.col("content").cast("binary")).alias("digest"), "chunk_no")


def _classes_sql() -> str:
    made = ["PART II", "Division 3", "Subdivision 2", "12A. Fees", "Appendix B", "Paragraph 4", "SCHEDULE OF FEES", "A. First", "NOTE-see", "P.U. (A) 12", "77", "Laws of Malaysia", "[TABLE]", "Made 3 May", "FEES", "PART A_1", "3 PN 4/2020", "Regulation 5.", "Chapter ..... 9"]
    kind = ["part", "division", "subdivision", "section", "appendix", "para", "caps", "lettered", "note", "pu", "page", "laws", "table_tag", "signing", "gazette_header", "faq_footer", "pn", "reg_toc", "toc"]
    return made, f"""SELECT {_pick_sql(kind, 'page_id')} AS "class", count(*) AS n FROM pages GROUP BY 1"""


_MADE, _KIND_SQL = _classes_sql()


@sql(_KIND_SQL)
def page_line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading or a line of noise a page, by its number: every kind there is."""
    p = table(spark, sf_dir, "pages")
    return p.groupBy(chunking.line_class(_pick(_MADE, F.col("page_id"))).alias("class")).agg(F.count("*").alias("n"))


# ---- index and search ----


@sql(r"""WITH d AS (SELECT *, regexp_replace(text || CASE doc_id % 5 WHEN 1 THEN ' [TABLE]' WHEN 2 THEN ' [VISUAL DESCRIPTION][TABLE]' ELSE '' END, '^\s+|\s+$', '', 'g') AS content FROM documents)
SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN content ELSE 'Section ' || (doc_id % 9) || CASE WHEN doc_id % 2 = 0 THEN ' (' || lang || ')' ELSE '' END || CASE WHEN doc_id % 4 = 0 THEN '' ELSE ': T' || doc_id END || chr(10) || chr(10) || content END) AS digest,
  CASE doc_id % 5 WHEN 1 THEN 'table' WHEN 2 THEN 'visual' ELSE 'text' END AS chunk_type FROM d WHERE length(content) >= 40""")
def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    some = lambda c, v: F.when(c, F.lit("")).otherwise(v)
    d = table(spark, sf_dir, "documents").select("doc_id", some(n % 7 == 0, F.concat(F.lit("Section "), (n % 9).cast("string"))).alias("section"), some((n % 7 == 0) | (n % 4 == 0), F.concat(F.lit("T"), n.cast("string"))).alias("section_title"), some((n % 7 == 0) | (n % 2 == 1), F.col("lang")).alias("part"), F.concat("text", F.when(n % 5 == 1, " [TABLE]").when(n % 5 == 2, " [VISUAL DESCRIPTION][TABLE]").otherwise("")).alias("content"))
    return search.index_chunks(d).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "chunk_type")


@sql(f"""WITH {_INDEX.replace("SELECT source AS s, doc_id AS c, text,", "SELECT source AS s, doc_id AS c, text || CASE WHEN doc_id % 3 = 0 THEN ' CLBG' ELSE '' END AS text,").replace("regexp_extract_all(lower(text)", "regexp_extract_all(lower(text || CASE WHEN doc_id % 3 = 0 THEN ' CLBG' ELSE '' END)").replace("SELECT item_id AS q, text AS qt", "SELECT item_id AS q, text || CASE WHEN item_id % 4 = 0 THEN ' clbg' ELSE '' END AS qt")},
best AS (SELECT q, s, max(b) AS m FROM bm GROUP BY ALL),
sc AS (SELECT q.q, doc.s, doc.c, CASE WHEN q.q % 2 = 1 THEN 0.0 ELSE 0.2 END AS w, list_dot_product(v, qv) AS cosine, coalesce(CASE WHEN m > 0 THEN b / m ELSE b END, 0) AS lex, CASE WHEN q.q % 4 <> 0 AND doc.c % 3 = 0 THEN 0.4 ELSE 1 END AS penalty, CASE WHEN q.q % 5 = 0 AND doc.c % 10 = 7 THEN 0.15 ELSE 0 END AS boost
  FROM q CROSS JOIN doc LEFT JOIN bm ON bm.q = q.q AND bm.s = doc.s AND bm.c = doc.c LEFT JOIN best ON best.q = q.q AND best.s = doc.s)
SELECT q AS query_id, s AS source_key, c AS chunk_no, round(((1 - w) * cosine + w * lex) * penalty + boost, 6) AS score FROM sc WHERE ((1 - w) * cosine + w * lex) * penalty + boost >= 0.3""")
def hybrid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores over a bound: odd questions are Malay, some chunks and questions are about companies by guarantee, some sections are boosted."""
    chunks = _chunks(spark, sf_dir).withColumn("text", F.concat("text", F.when(F.col("chunk_no") % 3 == 0, " CLBG").otherwise(""))).withColumn("section", F.concat(F.lit("Section "), (F.col("chunk_no") % 10).cast("string")))
    q = _questions(spark, sf_dir)
    q = q.withColumns({"lang": F.when(F.col("query_id") % 2 == 1, "ms").otherwise("en"), "text": F.concat("text", F.when(F.col("query_id") % 4 == 0, " clbg").otherwise(""))})
    boosts = q.where("query_id % 5 = 0").select(T.query_hash(F.col("text")).alias("query_hash"), F.lit("7").alias("section_parent"), F.lit(0.15).alias("delta")).distinct()
    return search.hybrid(q, store_table(chunks), 0.3, boosts=boosts).select("query_id", "source_key", "chunk_no", F.round("score", 6).alias("score"))


@sql("""WITH r AS (SELECT label AS query_id, vec_id AS rank, source FROM embeddings JOIN documents ON doc_id = vec_id), s AS (SELECT query_id, source, min(rank) AS p FROM r GROUP BY ALL),
k AS (SELECT query_id, ['Forms', 'FAQ', 'Circular'][length(source) % 3 + 1] AS category, min(p) AS p FROM s GROUP BY ALL)
SELECT query_id, (SELECT string_agg(upper(source), ',' ORDER BY p) FROM s WHERE s.query_id = q.query_id) AS citations, (SELECT string_agg(category, ',' ORDER BY p) FROM k WHERE k.query_id = q.query_id) AS categories_hit, true AS found FROM (SELECT DISTINCT query_id FROM r) AS q""")
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's vectors in order as what a question found: its sources and their categories, as they first come."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    r = e.join(d, e["vec_id"] == d["doc_id"]).select(F.col("label").alias("query_id"), F.col("vec_id").alias("rank"), F.col("source").alias("source_key"))
    s = d.select(F.col("source").alias("key")).distinct().withColumns({"name": F.upper("key"), "category": _pick(["Forms", "FAQ", "Circular"], F.length("key"))})
    return search.summary(r, s).select("query_id", F.array_join("citations", ",").alias("citations"), F.array_join("categories_hit", ",").alias("categories_hit"), "found")


@sql("""WITH s AS (SELECT source AS key, regexp_extract(source, '[0-9]+')::INT AS n, count(*) AS docs FROM documents GROUP BY ALL)
SELECT key, CASE WHEN n % 4 = 0 THEN 'ready' WHEN n % 4 = 1 THEN 'cached' WHEN n % 4 = 2 OR n % 8 = 3 THEN 'not_indexed' ELSE 'needs_preprocess' END AS status, CASE WHEN n % 3 = 2 THEN 'stale' WHEN n % 5 = 1 THEN 'torn' ELSE 'sound' END AS state FROM s""")
def source_index_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each source's index stands, by its number, and whether it is sound."""
    s = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("key")).agg(F.count("*").alias("docs")).withColumn("n", F.regexp_extract("key", "[0-9]+", 0).cast("int"))
    indexed = s.where("n % 4 IN (0, 1)").withColumn("version", F.lit(3)).unionByName(s.where("n % 4 = 2").withColumn("version", F.lit(2)))
    status = search.index_status(s.withColumn("enabled", F.lit(True)), indexed, s.where("n % 4 = 2 OR n % 8 = 3"), s.where("n % 4 = 0"))
    state = search.sound(s.select("key", F.when(F.col("n") % 3 == 2, 2).otherwise(3).alias("version"), F.col("docs").alias("n_chunks"), (F.col("docs") + F.when(F.col("n") % 5 == 1, 1).otherwise(0)).alias("n_vectors"), F.lit(7).alias("n_terms")))
    return status.join(state, "key")


@sql("SELECT vec_id, round(list_aggregate(list_transform(embedding::DOUBLE[], lambda x: 3 * x / sqrt(9 * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 'sum'), 5) AS total FROM embeddings")
def unit_vector_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of three times their length, made unit ones again: the sum of their parts."""
    v = F.transform("embedding", lambda x: x.cast("double") * 3)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(unit(v), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@sql("""WITH l AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM conversations) SELECT conv_id, turn::INT AS turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS chars, length(before)::BIGINT AS before FROM l""")
def conversation_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table function over a table: each conversation's rows in order, with the running size of its texts."""
    chunking.register(spark)
    table(spark, sf_dir, "conversations").createOrReplaceTempView("tessera_turns")
    return spark.sql("SELECT * FROM running_sizes(TABLE(SELECT conv_id, turn, text FROM tessera_turns) PARTITION BY conv_id ORDER BY turn)")
