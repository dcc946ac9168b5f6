"""Queries over the input tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import responses as R
from tessera.functions import text as T
from tessera.functions.vectors import dot, nearest
from tessera.operators import chunking, feedback, memory, rules, search, store
from tessera.operators.live_index import LiveIndex
from tessera.session import scratch, table
from tessera.session import store as store_table
from tessera.sources import registry as sources


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a vector as chunks: the document's source and id as source and chunk number."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return d.join(e, d["doc_id"] == e["vec_id"]).where(F.length(T.strip(F.col("text"))) >= search.LEAST_CHARS).select(F.col("source").alias("source_key"), F.col("doc_id").alias("chunk_no"), "text", "embedding")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items with a vector of the same number, as questions."""
    b, e = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    return b.join(e, b["item_id"] == e["vec_id"]).select(F.col("item_id").alias("query_id"), "text", F.lit("en").alias("lang"), "embedding")


def hybrid_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(_questions(spark, sf_dir), store_table(_chunks(spark, sf_dir)), threshold=0.2)  # read four times
    return found.select("query_id", "rank", "source_key", "chunk_no", F.round("score", 6).alias("score"))


_INDEX = r"""
doc AS (SELECT source AS s, doc_id AS c, text, embedding::DOUBLE[] AS v, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents JOIN embeddings ON doc_id = vec_id WHERE length(trim(text)) >= 40),
size AS (SELECT s, count(*) AS n, avg(len(t)) AS avgdl FROM doc GROUP BY s),
post AS (SELECT s, c, dl, term, count(*) AS tf FROM (SELECT s, c, len(t) AS dl, unnest(t) AS term FROM doc) GROUP BY ALL),
df AS (SELECT s, term, count(*) AS df FROM post GROUP BY ALL),
raw AS (SELECT s, term, df, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df JOIN size USING (s)),
stat AS (SELECT s, term, df, n, avgdl, CASE WHEN r < 0 THEN 0.25 * avg(r) OVER (PARTITION BY s) ELSE r END AS idf FROM raw),
q AS (SELECT item_id AS q, text AS qt, embedding::DOUBLE[] AS qv FROM benchmark JOIN embeddings ON item_id = vec_id),
qt AS (SELECT q, term, count(*) AS qtf FROM (SELECT q, unnest(regexp_extract_all(lower(qt), '[a-z0-9]+')) AS term FROM q) GROUP BY ALL),
bm AS (SELECT q, s, c, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS b FROM post JOIN qt USING (term) JOIN stat USING (s, term) GROUP BY ALL)"""

HYBRID_SQL = f"""WITH {_INDEX},
best AS (SELECT q, s, max(b) AS m FROM bm GROUP BY ALL),
sc AS (SELECT q.q, doc.s, doc.c, doc.text, 0.8 * list_dot_product(v, qv) + 0.2 * coalesce(CASE WHEN m > 0 THEN b / m ELSE b END, 0) AS score
  FROM q CROSS JOIN doc LEFT JOIN bm ON bm.q = q.q AND bm.s = doc.s AND bm.c = doc.c LEFT JOIN best ON best.q = q.q AND best.s = doc.s),
a AS (SELECT * FROM sc WHERE score >= 0.2 QUALIFY row_number() OVER (PARTITION BY q, s ORDER BY score DESC, c) <= 4),
d AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY q, md5(text) ORDER BY score DESC, s, c) = 1)
SELECT q AS query_id, (row_number() OVER (PARTITION BY q ORDER BY score DESC, s, c))::INTEGER AS rank, s AS source_key, c AS chunk_no, round(score, 6) AS score
FROM d QUALIFY rank <= 12"""


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = search.bm25_best(_questions(spark, sf_dir), _chunks(spark, sf_dir), search.PER_SOURCE).withColumn("bm25", F.round("bm25", 6))
    return search._top(scored, ["query_id", "source_key"], [F.desc("bm25"), "chunk_no"], 4).select("query_id", "source_key", "rank", "chunk_no", "bm25")


BM25_SQL = f"""WITH {_INDEX}, b AS (SELECT q AS query_id, s AS source_key, c AS chunk_no, round(b, 6) AS bm25 FROM bm)
SELECT query_id, source_key, (row_number() OVER (PARTITION BY query_id, source_key ORDER BY bm25 DESC, chunk_no))::INTEGER AS rank, chunk_no, bm25 FROM b QUALIFY rank <= 4"""


def bm25_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return search.term_stats(chunks, search.postings(chunks)).select("source_key", "term", "df", "n_chunks", F.round("avgdl", 6).alias("avgdl"), F.round("idf", 6).alias("idf"))


STATS_SQL = f"WITH {_INDEX} SELECT s AS source_key, term, df, n AS n_chunks, round(avgdl, 6) AS avgdl, round(idf, 6) AS idf FROM stat"


def index_after_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The even chunks indexed, the odd ones added, then a tenth of all removed: statistics by signed counts."""
    chunks = _chunks(spark, sf_dir).select("source_key", "chunk_no", "text")
    index = LiveIndex(scratch(spark), "source_key string, chunk_no long, text string")
    index.apply(spark, 0, chunks.where("chunk_no % 2 = 0"))
    index.apply(spark, 1, chunks.where("chunk_no % 2 = 1"))
    index.apply(spark, 2, removed=chunks.where("chunk_no % 10 = 3"))
    return index.stats(spark).select("source_key", "term", "df", "n_chunks", F.round("avgdl", 6).alias("avgdl"), F.round("idf", 6).alias("idf"))


UPDATES_SQL = STATS_SQL.replace("length(trim(text)) >= 40", "length(trim(text)) >= 40 AND doc_id % 10 <> 3", 1)


def vector_topk_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four nearest vectors of each label for every vector with a number divisible by 50."""
    return _nearest(spark, sf_dir, ["query_id", "label"], 4).select("query_id", "label", "rank", "vec_id", "score")


def vector_topk_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir, ["query_id"], 12).select("query_id", "rank", "vec_id", "score")


def _nearest(spark: SparkSession, sf_dir: str, by: list[str], k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")  # the stated query set
    group = "label" if "label" in by else None
    found = nearest(asked, e.withColumnRenamed("vec_id", "row_id"), k, group).withColumnRenamed("row_id", "vec_id")
    return search._top(found.withColumn("score", F.round("cosine", 6)), by, [F.desc("score"), "vec_id"], k)


def _nearest_sql(by: str, k: int, columns: str) -> str:
    return f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)
SELECT {columns}, (row_number() OVER (PARTITION BY {by} ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= {k}"""


def self_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's length, by the expression form."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(dot(F.col("embedding"), F.col("embedding"))), 6).alias("length"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_text(F.col("text")).cast("binary")).alias("digest"))


CLEAN_SQL = r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(replace(replace(replace(translate(text, '–—‒“”‘’‚‛', '---""'''''''''), '-LRB-', '('), '-RRB-', ')'), '-LSB-', '['), '-RSB-', ']'),
  '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), '\r\n?', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents"""


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return d.select("doc_id", "pos", F.md5(F.col("sentence").cast("binary")).alias("digest"))


SENTENCE_SQL = r"""SELECT doc_id, (unnest(range(len(s))))::INTEGER AS pos, md5(unnest(s)) AS digest FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)"""


def sentence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.pack_sentences(F.col("text"))).alias("pos", "page")).select("doc_id", "pos", F.length("page").alias("n_chars"), "page")


_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
PACK_SQL = rf"""WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+|\n{{2,}}', '\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP.format('x')} <> '') AS parts FROM documents),
f AS (SELECT doc_id, list_reduce(list_concat([{{'done': []::VARCHAR[], 'cur': ''}}], list_transform(parts, lambda p: {{'done': []::VARCHAR[], 'cur': p}})), lambda a, x:
  CASE WHEN length(a.cur) + length(x.cur) + 1 > 1000 AND a.cur <> '' THEN {{'done': list_append(a.done, {_STRIP.format('a.cur')}), 'cur': x.cur}}
  ELSE {{'done': a.done, 'cur': CASE WHEN a.cur = '' THEN x.cur ELSE {_STRIP.format("a.cur || ' ' || x.cur")} END}} END) AS r FROM d),
p AS (SELECT doc_id, CASE WHEN {_STRIP.format('r.cur')} <> '' THEN list_append(r.done, {_STRIP.format('r.cur')}) ELSE r.done END AS pages FROM f),
u AS (SELECT doc_id, (unnest(range(len(pages))))::INTEGER AS pos, unnest(pages) AS page FROM p)
SELECT doc_id, pos, length(page)::INTEGER AS n_chars, page FROM u"""


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_key"), F.col("source").alias("source_name"), "text")
    return chunking.parse_others(d)


WINDOWS_SQL = rf"""WITH RECURSIVE p AS (SELECT doc_id, source, text, string_split(regexp_replace(text, '([.!?]\s+|\n{{2,}})', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents),
n AS (SELECT doc_id, i, sum(k) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM (SELECT doc_id, unnest(range(len(parts) - 1)) AS i, unnest(list_transform(parts[:-2], lambda x: length(x))) AS k FROM p)),
d AS (SELECT p.doc_id, source, text, coalesce(list(e) FILTER (e IS NOT NULL), []) AS ends FROM p LEFT JOIN n ON p.doc_id = n.doc_id GROUP BY ALL),
w AS (SELECT doc_id, 0 AS no, 0::BIGINT AS a, 0::BIGINT AS b FROM d WHERE length(text) > 0
  UNION ALL SELECT w.doc_id, no + 1, w.b, coalesce(list_max(list_filter(ends, lambda x: x > w.b AND x <= w.b + 1200)), least(w.b + 1200, length(text)))::BIGINT FROM w JOIN d USING (doc_id) WHERE w.b < length(text)),
c AS (SELECT doc_id, source, no, {_STRIP.format('substr(text, a + 1, b - a)')} AS content FROM w JOIN d USING (doc_id) WHERE no > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS chunk_no FROM c WHERE length(content) >= 60)
SELECT doc_id::VARCHAR AS source_key, source AS source_name, '' AS part, '' AS division, '' AS subdivision, 'Section ' || chunk_no AS section, '' AS section_title, content, chunk_no FROM r"""


def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.explode(T.lines(F.col("text"))).alias("line"))
    return d.groupBy(chunking.line_class(F.col("line")).alias("class")).agg(F.count("*").alias("n"))


def _line_sql() -> str:
    rules = [("toc", r"\.{3,}\s*\d+\s*$"), ("page", r"^\s*\d+\s*$"), ("pu", r"(?i)^P\.U\.\s*\([AB]\)\s*\d+"), ("laws", r"(?i)^Laws of Malaysia\b"), ("note", "(?i)^NOTE[-–]"), ("pn", r"(?i)^\d*\s*PN\s+\d+/\d{4}"), ("faq_footer", r"(?i)^PART\s+[A-Z]_"), ("reg_toc", r"(?i)^(Peraturan|Regulation)\s+\d+\."), ("gazette_header", "^(WARTA KERAJAAN|FEDERAL GOVERNMENT GAZETTE|PERATURAN-PERATURAN|SUSUNAN PERATURAN|AKTA SYARIKAT|FI$|FEES$|DISIARKAN|PUBLISHED BY|JABATAN PEGUAM|ATTORNEY GENERAL)"), ("signing", r"(?i)^(Dibuat|Made\s+\d|DATO|Yang\s+Berhormat)"), ("section", r"(?i)^(Section\s+)?\d+[A-Z]?\."), ("caps", r"^[A-Z][A-Z\s/&\-\(\)\d]{3,}$"), ("lettered", r"^[A-Z]\.\s+\S"), ("appendix", r"(?i)^(Appendix|Annex|Schedule|Attachment)\s+\S+"), ("para", r"(?i)^Para(graph)?\s+\d+")]
    when = " ".join("WHEN regexp_matches(line, '{}') THEN '{}'".format(p.replace("'", "''"), n) for n, p in rules)
    return rf"""WITH l AS (SELECT regexp_replace(unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))), '^\s+|\s+$', '', 'g') AS line FROM documents)
SELECT CASE WHEN line = '' THEN 'blank' {when} ELSE 'text' END AS "class", count(*) AS n FROM l GROUP BY 1"""


def registry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source, the sources as a registry with categories dealt by name."""
    s = table(spark, sf_dir, "documents").select(F.col("source").alias("key")).distinct()
    s = s.withColumn("category", F.element_at(F.array(*[F.lit(c) for c in ("Guidelines", "Circular", "FAQ")]), (F.length("key") % 3 + 1).cast("int"))).withColumn("enabled", F.col("key") != "src0")
    return sources.counts(s)


REGISTRY_SQL = """WITH s AS (SELECT DISTINCT source AS key FROM documents), k AS (SELECT unnest(['Legislations', 'Practice Notes', 'Practice Directives', 'Guidelines', 'Circular', 'FAQ', 'Forms']) AS category),
c AS (SELECT ['Guidelines', 'Circular', 'FAQ'][length(key) % 3 + 1] AS category FROM s WHERE key <> 'src0')
SELECT k.category, count(c.category) AS n FROM k LEFT JOIN c USING (category) GROUP BY 1"""


def incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of documents that have no document numbered below 15 yet."""
    d = table(spark, sf_dir, "documents")
    s = d.select(F.col("source").alias("key"), F.lit(True).alias("enabled")).distinct()
    return sources.unprocessed(s, d.where("doc_id < 15").select(F.col("source").alias("key"))).select("key")


INCREMENTAL_SQL = "SELECT DISTINCT source AS key FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id < 15)"


def dedupe_exact_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.dedupe_exact(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "digest", "copies")


DEDUPE_SQL = "SELECT min(doc_id) AS doc_id, md5(coalesce(text, '')) AS digest, count(*) AS copies FROM documents GROUP BY 2"


def near_dup_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.near_duplicates(table(spark, sf_dir, "documents")).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


JACCARD_SQL = r"""WITH s AS (SELECT min(doc_id) AS k, t FROM (SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS t FROM documents) WHERE len(t) > 0 GROUP BY t),
w AS (SELECT k, len(t) AS n, unnest(t) AS term FROM s),
p AS (SELECT a.k AS a, b.k AS b, a.n AS na, b.n AS nb, count(*) AS c FROM w a JOIN w b ON a.term = b.term AND a.k < b.k GROUP BY ALL)
SELECT a, b, round(c / (na + nb - c), 6) AS jaccard FROM p WHERE c / (na + nb - c) > 0.8"""


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").withColumn("digest", F.md5(F.col("text").cast("binary")))
    return d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0")


def _asked_and_cached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The odd documents, and the digests of the even ones as a table bucketed by digest."""
    asked, cached = _halves(spark, sf_dir)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return asked, store.save_bucketed(cached.select("digest").distinct(), f"tessera_cache_{uuid.uuid4().hex}", scratch(spark), ["digest"], buckets)


def embedding_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cache_hits(*_asked_and_cached(spark, sf_dir)).select("doc_id", "digest")


def embedding_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cache_misses(*_asked_and_cached(spark, sf_dir)).select("doc_id", "digest")


def _cache_sql(word: str) -> str:
    return f"SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id % 2 = 1 AND md5(text) {word} (SELECT md5(text) FROM documents WHERE doc_id % 2 = 0)"


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as feedback: rating 5 or 1 by quality, 3 where toxic; a failure type by id where not positive."""
    rating = F.when(F.col("toxic") == 1, 3).when(F.col("quality") == 1, 5).otherwise(1)
    kind = F.element_at(F.array(F.lit("hallucination"), F.lit("wrong_form"), F.lit("hallucination"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("qa_id"), rating.alias("rating"), F.when(rating < 4, kind).otherwise("").alias("failure_type"))


_FEEDBACK = "f AS (SELECT doc_id AS qa_id, CASE WHEN toxic = 1 THEN 3 WHEN quality = 1 THEN 5 ELSE 1 END AS rating, CASE WHEN toxic = 1 OR quality = 0 THEN ['hallucination', 'wrong_form', 'hallucination', ''][doc_id % 4 + 1] ELSE '' END AS failure_type FROM labels)"


def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.summary(_feedback(spark, sf_dir))


def failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.failure_counts(_feedback(spark, sf_dir))


def patch_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.active_patches(_feedback(spark, sf_dir)).select("failure_type", F.round("share", 6).alias("share"))


SUMMARY_SQL = f"WITH {_FEEDBACK} SELECT count(*) AS total, count_if(rating >= 4)::BIGINT AS positive, count_if(rating = 3)::BIGINT AS neutral, count_if(rating <= 2)::BIGINT AS negative FROM f"
COUNTS_SQL = f"WITH {_FEEDBACK}, k AS (SELECT unnest(['wrong_source', 'hallucination', 'incorrect', 'incomplete', 'out_of_scope', 'wrong_form', 'other']) AS failure_type) SELECT failure_type, count(qa_id) AS n FROM k LEFT JOIN f USING (failure_type) GROUP BY 1"
PATCH_SQL = f"WITH {_FEEDBACK} SELECT failure_type, round(count(*) / any_value(n), 6) AS share FROM f, (SELECT count(*) AS n FROM f WHERE rating <= 2) WHERE n >= 3 AND failure_type IN ('wrong_source', 'hallucination', 'incorrect', 'incomplete', 'out_of_scope', 'wrong_form') GROUP BY 1 HAVING count(*) / any_value(n) >= 0.25"


def failure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _feedback(spark, sf_dir).where("failure_type <> ''").select(F.array(F.struct(F.col("failure_type").alias("type")), F.struct(F.lit("any").alias("type"))).alias("auto_issues"))
    return feedback.failure_rates(f)


RATES_SQL = f"WITH {_FEEDBACK} SELECT unnest([failure_type, 'any']) AS type, count(*) AS n FROM f WHERE failure_type <> '' GROUP BY 1"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns: a user's message and the answer after it."""
    c = table(spark, sf_dir, "conversations").alias("c")
    return c.where("role = 'user'").join(c.where("role = 'assistant'").alias("r"), (F.col("c.conv_id") == F.col("r.conv_id")) & (F.col("r.turn") == F.col("c.turn") + 1)).select(F.col("c.conv_id").alias("session"), F.col("c.turn").alias("turn"), F.col("c.text").alias("query"), F.col("r.text").alias("response"))


def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.bounded(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")], memory.TURNS).select("conv_id", "turn", "role")


def evicted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.evicted(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")], memory.TURNS).select("conv_id", "turn", "role")


def _history_sql(op: str) -> str:
    return f"SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) {op} 6"


def history_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.history_block(_turns(spark, sf_dir)).select("session", "kept", F.length("block").alias("n_chars"))


def _history_budget_sql() -> str:
    frame = len(C.HISTORY_HEAD) + 2 * (len(memory.RULE) + 1) + 2
    facts = [(r"[Ss]ection\s+\d+[A-Za-z]?(?:\(\d+\))?", 3), (r"RM\s?[\d,]+(?:\.\d{2})?", 2), (r"\d+\s+(?:days?|months?|years?)", 2)]
    found = "list_concat(list_concat(" + "), ".join(", ".join(f"regexp_extract_all(r, '{p}')[1:{n}]" for p, n in part) for part in (facts[:2], facts[2:])) + ")"
    return rf"""WITH t AS (SELECT c.conv_id AS session, c.turn, c.text AS q, a.text AS r FROM conversations c JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 WHERE c.role = 'user' AND a.role = 'assistant'),
b AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn DESC) AS back, list_filter(list_transform(string_split(regexp_replace(r, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS s, {found} AS f FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn) AS no, array_to_string(list_transform(s[1:2], lambda x: left(x, 120)), ' ') AS head, CASE WHEN len(s) > 1 THEN left(s[-1], 150) ELSE '' END AS tail FROM b WHERE back <= 6),
l AS (SELECT session, back, length('[Turn ' || no || ']' || chr(10) || 'User: ' || q || chr(10) || 'Assistant: ' || CASE WHEN back = 1 THEN left(r, 500) || '…'
  ELSE left(head || CASE WHEN len(f) > 0 THEN ' [' || array_to_string(f, ', ') || ']' ELSE '' END || CASE WHEN tail <> '' AND tail <> head THEN ' | ' || tail ELSE '' END, 600) END) AS n FROM k),
z AS (SELECT *, sum(n + 2) OVER (PARTITION BY session ORDER BY back) - 2 + {frame} AS size FROM l)
SELECT session, count(*) AS kept, (sum(n + 2) - 2 + {frame})::INTEGER AS n_chars FROM z WHERE back = 1 OR size <= 2400 GROUP BY 1"""


def language_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return memory.streaks(e, None, 3, "user_id", "event_type", ("ts", "event_id")).select("user_id", "event_id", "event_type")


STREAK_SQL = """WITH a AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)
SELECT user_id, event_id, event_type FROM b QUALIFY row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) = 3"""


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five accepted events a user and day."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return memory.accepted_hits(e, 5, 86_400, "user_id", "ts", "event_id").select("user_id", "event_id", "accepted")


RATE_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT user_id, event_id, i, true AS accepted, [ts] AS held FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, len(list_filter(r.held, lambda h: e.ts - h < INTERVAL 86400 SECONDS)) < 5,
    CASE WHEN len(list_filter(r.held, lambda h: e.ts - h < INTERVAL 86400 SECONDS)) < 5 THEN list_append(list_filter(r.held, lambda h: e.ts - h < INTERVAL 86400 SECONDS), e.ts) ELSE list_filter(r.held, lambda h: e.ts - h < INTERVAL 86400 SECONDS) END
  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id, accepted FROM r"""


def memory_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as memories of seven days, half of them without an end, seven days after the first."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"), "ts")
    now = e.agg((F.min("ts") + F.expr("INTERVAL 14 DAYS")).alias("now"))
    return memory.alive(e.join(F.broadcast(now)), F.col("now")).select("event_id")


TTL_SQL = "SELECT event_id FROM events, (SELECT min(ts) + INTERVAL 14 DAYS AS now FROM events) WHERE event_id % 2 = 1 OR ts + INTERVAL 7 DAYS >= now"


def memory_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's vectors as a user's memories, each user's first one as the query, at a lowered threshold."""
    e = table(spark, sf_dir, "embeddings")
    r = e.select(F.col("label").alias("user"), F.col("vec_id").alias("memory_id"), F.when(F.col("vec_id") % 2 == 0, "longterm").otherwise("midterm").alias("tier"), F.col("vec_id").alias("seq"), F.lit("").alias("content"), "embedding")
    q = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(F.col("label").alias("query_id"), F.col("label").alias("user"), F.lit("").alias("text"), "embedding")
    return memory.rank(r, q, 0.2).select("query_id", "rank", "memory_id", F.round("score", 6).alias("score"))


MEMORY_SQL = """WITH q AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY 1),
s AS (SELECT label AS query_id, vec_id AS memory_id, list_dot_product(embedding::DOUBLE[], v) AS score FROM embeddings JOIN q USING (label))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id % 2, memory_id))::INTEGER AS rank, memory_id, round(score, 6) AS score FROM s WHERE score >= 0.2 QUALIFY rank <= 3"""


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("qa_id"), F.col("conv_id").cast("string").alias("session_id"), F.lit("u").alias("user_id"), F.col("text").alias("query"), F.col("turn").alias("created_at"))


def message_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three turns are stored; all turns come in again, every fifth one without an id."""
    m = _messages(spark, sf_dir)
    new = m.withColumn("qa_id", F.when(F.col("created_at") % 5 == 4, "").otherwise(F.col("qa_id")))
    return store.append_messages(m.where("created_at < 3"), new).groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("qa_id") == "").alias("n_unnamed"))


UPSERT_SQL = """WITH m AS (SELECT conv_id::VARCHAR AS session_id, turn FROM conversations), a AS (SELECT session_id, false AS u FROM m WHERE turn < 3 UNION ALL SELECT session_id, turn % 5 = 4 FROM m WHERE turn >= 3)
SELECT session_id, count(*) AS n, count_if(u)::BIGINT AS n_unnamed FROM a GROUP BY 1"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    s = m.select(F.col("session_id").alias("id"), F.when(F.col("session_id").cast("int") % 2 == 0, "u").otherwise("v").alias("user_id"), F.lit("").alias("title"), F.lit(-1).cast("long").alias("updated_at")).distinct()
    return store.touch_sessions(s, m)


def sessions_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.list_sessions(_sessions(spark, sf_dir), "u").select("id", "title", "updated_at")


SESSIONS_SQL = """SELECT conv_id::VARCHAR AS id, CASE WHEN length(q) > 52 THEN left(q, 52) || '…' WHEN q = '' THEN 'New Chat' ELSE q END AS title, last AS updated_at
FROM (SELECT conv_id, arg_min(text, turn) AS q, max(turn) AS last FROM conversations GROUP BY 1) WHERE conv_id % 2 = 0"""


def session_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User u deletes session 0, and tries to delete session 1, which is v's."""
    s, m = _sessions(spark, sf_dir), _messages(spark, sf_dir)
    s, m = store.delete_session(s, m, "u", "0")
    s, m = store.delete_session(s, m, "u", "1")
    return m.groupBy("session_id").agg(F.count("*").alias("n")).join(s.select(F.col("id").alias("session_id")), "session_id")


DELETE_SQL = "SELECT conv_id::VARCHAR AS session_id, count(*) AS n FROM conversations WHERE conv_id <> 0 GROUP BY 1"


def confirm_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as confirmations of overrides, one an event type and user group."""
    e = table(spark, sf_dir, "events")
    over = e.select(F.concat_ws("-", "event_type", F.col("user_id") % 7).alias("intent_action")).distinct().select("intent_action", F.lit("f").alias("form_id"), F.lit("F").alias("form_name"), F.lit(0.5).alias("confidence"), F.lit(False).alias("locked"), F.lit(0).cast("long").alias("confirmed_positive"), F.lit(0).cast("long").alias("confirmed_negative"))
    fixes = over.select(F.md5(F.col("intent_action").cast("binary")).alias("query_hash"), F.col("intent_action").alias("action"))
    up = e.where("value > 50").select(F.md5(F.concat_ws("-", "event_type", F.col("user_id") % 7).cast("binary")).alias("query_hash"))
    return feedback.reinforce(over, fixes, up).select("intent_action", "confirmed_positive", "locked")


LOCK_SQL = "SELECT event_type || '-' || (user_id % 7) AS intent_action, count_if(value > 50)::BIGINT AS confirmed_positive, count_if(value > 50) >= 2 AS locked FROM events GROUP BY 1"


def correction_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of a user as the action stored for it."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("query_hash"), F.col("event_type").alias("action"), F.col("ts"), "event_id")
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    latest = lambda d: feedback.upsert(d.limit(0), d.withColumn("order", F.struct("ts", "event_id")), ["query_hash"], "order").drop("order")
    out = feedback.upsert(latest(old).withColumn("order", F.struct("ts", "event_id")), latest(new).withColumn("order", F.struct("ts", "event_id")), ["query_hash"], "order")
    return out.select("query_hash", "action", "event_id")


CORRECTION_SQL = "SELECT user_id::VARCHAR AS query_hash, event_type AS action, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


def section_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosts for the event types a user began with, asked for all event types of all users."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("query_hash"), F.col("event_type").alias("section_parent"), "ts", "event_id")
    boosts = e.where("event_id % 10 = 0").select("query_hash", "section_parent", "ts", F.lit(feedback.BOOST).alias("delta"))
    return feedback.section_boost(e.select("query_hash", "section_parent").distinct(), boosts)


BOOST_SQL = "SELECT user_id::VARCHAR AS query_hash, event_type AS section_parent, CASE WHEN bool_or(event_id % 10 = 0) THEN 0.15 ELSE 0.0 END::DOUBLE AS delta FROM events GROUP BY 1, 2"

def query_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as a query: greeting, follow-up, act, language, guarantee companies, and its expansion."""
    c, text = table(spark, sf_dir, "conversations"), F.col("text")
    return c.select("conv_id", "turn", T.is_greeting(text).alias("greeting"), T.is_followup(text, F.col("turn")).alias("followup"), T.detect_act(text).alias("act"), T.detect_language(text).alias("lang"), T.mentions_clbg(text).alias("clbg"), F.md5(T.expand_query(text).cast("binary")).alias("expanded"))


def _analysis_sql() -> str:
    q = lambda p: "'" + p.replace("'", "''") + "'"
    strong = " ".join(rf"WHEN regexp_matches(low, '\b{p}\b') THEN {q(act)}" for act, phrases in C.STRONG_PHRASES for p in phrases)
    hits = [" + ".join(rf"regexp_matches(low, '\b{w}\b')::INT" for w in words) for _, words in C.WEAK_WORDS]
    weak = " ".join(f"WHEN greatest(w0, w1, w2) >= 2 AND w{i} = greatest(w0, w1, w2) THEN {q(act)}" for i, (act, _) in enumerate(C.WEAK_WORDS))
    expanded = "text"
    for pattern, new in C.SYNONYMS:
        expanded = f"regexp_replace({expanded}, {q('(?i)' + pattern)}, {q(new)}, 'g')"
    return rf"""WITH t AS (SELECT conv_id, turn, text, lower(text) AS low, lower({_STRIP.format('text')}) AS s, {", ".join(f"{h} AS w{i}" for i, h in enumerate(hits))} FROM (SELECT *, lower(text) AS low FROM conversations)),
n AS (SELECT *, len(regexp_extract_all(s, '[a-zA-Z'']+')) AS words, len(regexp_extract_all(s, {q('(?i)' + C.MALAY_MARKERS)})) AS malay FROM t)
SELECT conv_id, turn, regexp_matches(text, {q('(?i)' + C.GREETINGS)}) AS greeting,
  turn > 0 AND len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) <= 5 AND (regexp_matches(text, {q('(?i)' + C.BACK_REFERENCES)}) OR regexp_matches({_STRIP.format('text')}, {q('(?i)' + C.CONTINUATIONS)})) AS followup,
  CASE {strong} {weak} END AS act, CASE WHEN words = 0 THEN 'en' WHEN malay / words >= 0.25 THEN 'ms' WHEN malay / words >= 0.10 THEN 'mixed' ELSE 'en' END AS lang,
  regexp_matches(text, '(?i)\bCLBG\b|company limited by guarantee|Checklist for CLBG') AS clbg, md5({expanded}) AS expanded FROM n"""


def labels_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's label by the acts' rules and, as weak ones, the opening two words of all answers, which stand for seven topics."""
    c = table(spark, sf_dir, "conversations")
    topic, pair = F.col("conv_id") % 7, F.regexp_extract(F.lower("text"), r"(?U)^\W*(\w+\W+\w+)", 1)
    openings = c.where("role = 'assistant'").select(pair.alias("phrase"), F.concat(F.lit("topic "), topic.cast("string")).alias("label"), F.lit(False).alias("strong"), (topic + 1000).alias("place")).where("phrase <> ''")
    return rules.labels(c, rules.act_rules(spark).unionByName(openings), ["conv_id", "turn"])


def _rules_sql() -> str:
    q = lambda p: "'" + p.replace("'", "''") + "'"
    fixed = [(p, act, strong) for strong, sets in ((True, C.STRONG_PHRASES), (False, C.WEAK_WORDS)) for act, phrases in sets for p in phrases]
    values = ", ".join(f"({q(p)}, {q(act)}, {strong}, {i})" for i, (p, act, strong) in enumerate(fixed))
    word = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}"
    runs = " UNION ".join(f"SELECT conv_id, turn, unnest(list_transform(range(1, len(words) - {n} + 2), lambda i: array_to_string(pieces[i:i + {n} - 2], '') || words[i + {n} - 1])) AS phrase FROM w" for n in range(1, 5))
    return rf"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[{word}]+[^{word}]*') AS pieces, regexp_extract_all(lower(text), '[{word}]+') AS words FROM conversations),
run AS ({runs}),
r AS (SELECT * FROM (VALUES {values}) AS v(phrase, label, strong, place) UNION SELECT regexp_extract(lower(text), '^[^{word}]*([{word}]+[^{word}]+[{word}]+)', 1) AS p, 'topic ' || (conv_id % 7), false, 1000 + conv_id % 7 FROM conversations WHERE role = 'assistant' AND p <> ''),
per AS (SELECT conv_id, turn, label, min(place) FILTER (strong) AS first, count(*) FILTER (NOT strong) AS n, min(place) FILTER (NOT strong) AS weak FROM run JOIN r USING (phrase) GROUP BY ALL)
SELECT conv_id, turn, label FROM per WHERE first IS NOT NULL OR n >= 2 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY first NULLS LAST, n DESC, weak) = 1"""


def response_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer of every conversation, with no form shown: diagnosed issues, the failure that they mean, and the checks that it fails."""
    t = _turns(spark, sf_dir).withColumn("i", R.diagnose(F.col("query"), F.col("response"), F.array().cast("array<string>")))
    checks = R.validation_issues(F.col("response"), F.array().cast("array<struct<name:string,url:string>>"))
    return t.select("session", "turn", F.array_join(F.transform("i", lambda x: x["type"]), ",").alias("issues"), R.failure_type(F.col("i"), F.lit("retrieval")).alias("failure"), F.array_join(checks, ",").alias("checks"))


def _checks_sql() -> str:
    q = lambda p: "'(?i)" + p.replace("'", "''") + "'"
    return rf"""WITH t AS (SELECT c.conv_id AS session, c.turn, c.text AS q, a.text AS r, {_STRIP.format('a.text')} AS s FROM conversations c JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 WHERE c.role = 'user' AND a.role = 'assistant'),
f AS (SELECT *, len(regexp_extract_all(r, '(?i)\[([^\]]+)\]\(https?://[^\)]+\)')) > 0 AS links, regexp_matches(r, {q(C.NOT_FOUND)}) AS unknown FROM t),
k AS (SELECT *, links AS a, regexp_matches(q, {q(C.PROCEDURAL)}) AND NOT links AND NOT unknown AS b, length(s) > 120 AND NOT regexp_matches(r, {q(C.CITATION)}) AND NOT unknown AS c, regexp_matches(r, {q(C.CUT_OFF)}) AS d FROM f)
SELECT session, turn, concat_ws(',', CASE WHEN a THEN 'form_hallucination' END, CASE WHEN b THEN 'missing_form' END, CASE WHEN c THEN 'uncited_answer' END, CASE WHEN d THEN 'truncation' END) AS issues,
  CASE WHEN d THEN 'incomplete' WHEN a OR b THEN 'wrong_form' WHEN c THEN 'hallucination' ELSE 'wrong_source' END AS failure,
  concat_ws(',', CASE WHEN s <> '' AND NOT regexp_matches(r, '[.!?)\]`*|\-\w]\s*$') THEN 'Response appears truncated' END, CASE WHEN regexp_matches(r, {q(C.WRONG_AGENCY_CHECKED)}) THEN 'Wrong SSM name used' END, CASE WHEN length(s) < 30 THEN 'response_too_short' END) AS checks FROM k"""


def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's messages of one session; another user's are not seen."""
    m = _messages(spark, sf_dir)
    return store.load_session(m, "u", "3").unionByName(store.load_session(m, "v", "3")).select("qa_id", "query", "created_at")


MESSAGES_SQL = "SELECT conv_id || '-' || turn AS qa_id, text AS query, turn AS created_at FROM conversations WHERE conv_id = 3"

QUERIES = [
    (hybrid_search_topk, HYBRID_SQL), (bm25_topk, BM25_SQL), (bm25_term_stats, STATS_SQL), (index_after_updates, UPDATES_SQL),
    (vector_topk_per_label, _nearest_sql("query_id, label", 4, "query_id, label")), (vector_topk_global, _nearest_sql("query_id", 12, "query_id")),
    (self_similarity, "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length FROM embeddings"),
    (clean_text, CLEAN_SQL), (sentence_split, SENTENCE_SQL), (sentence_pack, PACK_SQL), (chunk_windows, WINDOWS_SQL), (line_classes, _line_sql()),
    (registry_stats, REGISTRY_SQL), (incremental_skip, INCREMENTAL_SQL), (dedupe_exact_md5, DEDUPE_SQL), (near_dup_jaccard, JACCARD_SQL),
    (embedding_cache_hits, _cache_sql("IN")), (embedding_cache_misses, _cache_sql("NOT IN")),
    (feedback_summary, SUMMARY_SQL), (failure_counts, COUNTS_SQL), (patch_activation, PATCH_SQL), (failure_rates, RATES_SQL),
    (bounded_history, _history_sql("<=")), (evicted_turns, _history_sql(">")), (history_budget, _history_budget_sql()), (language_streak, STREAK_SQL),
    (rate_limit, RATE_SQL), (memory_ttl, TTL_SQL), (memory_rank, MEMORY_SQL), (message_upsert, UPSERT_SQL), (sessions_list, SESSIONS_SQL),
    (session_delete, DELETE_SQL), (confirm_lock, LOCK_SQL), (correction_upsert, CORRECTION_SQL), (section_boost, BOOST_SQL),
    (query_analysis, _analysis_sql()), (labels_by_rules, _rules_sql()), (response_checks, _checks_sql()), (session_messages, MESSAGES_SQL),
]
