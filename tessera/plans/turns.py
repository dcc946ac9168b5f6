"""Queries over conversations, labels, events and forms, with their SQL.

What the tables' prose lacks (references, states, ratings) is put to it by a rule, the same in
both forms: it depends on a row's numbers only, and every row of the table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import responses as R
from tessera.functions import text as T
from tessera.operators import feedback, forms, memory, search, store
from tessera.operators import generation as G
from tessera.plans.tables import RATE_SQL, STREAK_SQL, _turns
from tessera.session import scratch, table
from tessera.streaming import jobs

QUERIES: list[tuple] = []
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_T = "t AS (SELECT c.conv_id AS session, c.turn, c.text AS q, a.text AS r FROM conversations c JOIN conversations a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1 WHERE c.role = 'user' AND a.role = 'assistant')"
_NORMAL = rf"regexp_replace(regexp_replace(lower({_STRIP.format('{}')}), '\s+', ' ', 'g'), '[?.! ]+$', '')"


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


def _hash(c: str) -> str:
    return f"left(md5({_NORMAL.format(c)}), 8)"


def sql(text: str):
    """Registers a query with its SQL."""

    def mark(f):
        QUERIES.append((f, text))
        return f

    return mark


def _pick(values: list[str], n) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], n: str) -> str:
    return "[" + ", ".join(map(_q, values)) + f"][({n}) % {len(values)} + 1]"


# ---- sections and forms ----


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a passage that cites sections by its numbers; a conversation's passages answer its query."""
    c = table(spark, sf_dir, "conversations")
    cite = F.concat(F.lit(" See Section "), (F.col("turn") % 5 + 14).cast("string"), F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("("), (F.col("turn") % 2 + 1).cast("string"), F.lit(")"))).otherwise(""), F.lit(" and seksyen "), (F.col("conv_id") % 4 * 100 + 58).cast("string"), F.lit("."))
    return c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.concat("text", cite).alias("text"))


_CITED = r"""cited AS (SELECT conv_id AS query_id, turn, lower(text || ' See Section ' || (turn % 5 + 14) || CASE WHEN conv_id % 3 = 0 THEN '(' || (turn % 2 + 1) || ')' ELSE '' END || ' and seksyen ' || (conv_id % 4 * 100 + 58) || '.') AS low FROM conversations),
ref AS (SELECT DISTINCT query_id, turn, unnest(regexp_extract_all(low, '\b(?:section|seksyen)\s+(\d+[a-z]?)(?:\((\d+[a-z]?)\))?', 1)) AS parent, nullif(unnest(regexp_extract_all(low, '\b(?:section|seksyen)\s+(\d+[a-z]?)(?:\((\d+[a-z]?)\))?', 2)), '') AS child FROM cited),
freq AS (SELECT query_id, parent, child, count(*) AS chunks FROM ref GROUP BY ALL)"""


@sql(f"WITH {_CITED} SELECT * FROM freq")
def cited_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.section_frequency(_cited(spark, sf_dir))


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as a catalogue of forms: two sections each by number, some for companies by guarantee, some of another act."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    second = F.concat(F.lit("s. "), (k % 4 * 100 + 58).cast("string"))
    refs = F.array_compact(F.array(F.concat(F.lit("Section "), (k % 7 + 14).cast("string"), F.when(k % 5 == 0, "(1)").otherwise("")), second, F.when(k % 6 == 1, "LLP Act"), F.when(k % 8 == 3, "for CLBG")))
    link = lambda kind: F.struct(F.lit(kind).alias("type"), F.concat(F.lit(f"https://forms.example/{kind}/"), k.cast("string")).alias("url"))
    links = F.array_compact(F.array(F.when(k % 4 == 1, link("video")), F.when(k % 3 == 0, link("portal")), F.when(k % 2 == 0, link("pdf"))))
    return n.select(k.cast("int").alias("form_no"), F.concat(F.lit("F"), k.cast("string")).alias("form_id"), F.col("n_name").alias("name"), refs.alias("related_sections"), links.alias("links"), F.when(k % 3 == 0, F.concat(F.lit("No. "), k.cast("string"))).alias("form_number"), F.lit(None).cast("string").alias("resource_type"))


_FORMS = """form AS (SELECT n_nationkey::INT AS form_no, 'F' || n_nationkey AS form_id, n_name AS name, n_nationkey AS k, CASE WHEN n_nationkey % 6 = 1 THEN 'LLP Act 2012' ELSE 'Companies Act 2016' END AS act, n_nationkey % 8 = 3 AS clbg FROM nation),
offer AS (SELECT form_no, form_id, name, (k % 7 + 14)::VARCHAR || CASE WHEN k % 5 = 0 THEN '(1)' ELSE '' END AS sec FROM form UNION ALL SELECT form_no, form_id, name, (k % 4 * 100 + 58)::VARCHAR FROM form)"""
_ACTS = ["Companies Act 2016", "LLP Act 2012", ""]
_ABOUT = ["to form a guarantee company", "plain", "a change"]


def _intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's turn with an action by its numbers, an act or none, and what it is about."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    n = F.col("conv_id") * 3 + F.col("turn")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "conv_id", "turn", "text", _pick(feedback.ACTIONS, n).alias("action"), _pick(_ABOUT, F.col("conv_id")).alias("reasoning"), F.lit("").alias("legal_procedure"), F.nullif(_pick(_ACTS, F.col("turn")), F.lit("")).alias("act"), (F.col("conv_id") % 4 != 2).alias("is_actionable"), (F.col("turn") % 5 == 4).alias("ambiguous"), (F.lit(0.5) + F.col("conv_id") % 3 * 0.1).alias("confidence"))


_TAXONOMY = "tax AS (SELECT * FROM (VALUES " + ", ".join(f"({_q(a)}, {i}, {_q(s.lower().replace(' ', ''))})" for a, ss in C.TAXONOMY for i, s in enumerate(ss)) + ") AS v(action, pos, sec))"
_INTENTS = f"""it AS (SELECT conv_id || '-' || turn AS query_id, conv_id, turn, text, {_pick_sql(feedback.ACTIONS, 'conv_id * 3 + turn')} AS action, conv_id % 3 = 0 AS clbg_query, nullif({_pick_sql(_ACTS, 'turn')}, '') AS act, conv_id % 4 <> 2 AND turn % 5 <> 4 AND 0.5 + conv_id % 3 * 0.1 >= 0.55 AS sure FROM conversations WHERE role = 'user')"""


def _intent_forms_sql(asked: str) -> str:
    return f"""ps AS (SELECT query_id, form_no, sum(CASE WHEN pos = 0 THEN 3 ELSE 1 END) AS score, any_value(a.act) AS act, any_value(clbg_query) AS cq FROM {asked} AS a JOIN tax USING (action) JOIN offer USING (sec) GROUP BY query_id, form_no),
pa AS (SELECT ps.*, form_id, name, clbg, (ps.act IS NULL OR form.act = ps.act) AS fits FROM ps JOIN form USING (form_no)),
pb AS (SELECT * FROM pa QUALIFY fits OR NOT bool_or(fits) OVER (PARTITION BY query_id)),
pc AS (SELECT * FROM pb QUALIFY (cq OR NOT clbg) OR NOT bool_or(cq OR NOT clbg) OVER (PARTITION BY query_id)),
by_intent AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, form_no))::INT AS rank, form_id, name, score::BIGINT AS score FROM pc QUALIFY rank <= 3)"""


@sql(f"WITH {_FORMS}, {_TAXONOMY}, {_INTENTS}, {_intent_forms_sql('it')} SELECT * FROM by_intent")
def forms_by_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.forms_for_intents(_intents(spark, sf_dir), _forms(spark, sf_dir))


_BY_SECTION = """fq AS (SELECT query_id, parent || CASE WHEN child IS NOT NULL THEN '(' || child || ')' ELSE '' END AS sec, chunks, sum(chunks) OVER (PARTITION BY query_id) AS total, max(chunks) OVER (PARTITION BY query_id) AS most FROM freq),
fs AS (SELECT query_id, form_no, form_id, name, most, sum(chunks / total) AS score, max(chunks) AS best FROM fq JOIN offer USING (sec) GROUP BY ALL),
by_section AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, form_no))::INT AS rank, form_id, name, score FROM fs WHERE score >= 0.3 AND best >= most * 0.6 QUALIFY rank <= 3)"""


@sql(f"WITH {_CITED}, {_FORMS}, {_BY_SECTION} SELECT * REPLACE (round(score, 6) AS score) FROM by_section")
def forms_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.forms_for_sections(search.section_frequency(_cited(spark, sf_dir)), _forms(spark, sf_dir)).withColumn("score", F.round("score", 6))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First questions of conversations through all paths: some actions have a locked form, some questions a stored action."""
    first = _intents(spark, sf_dir).where("turn = 0")
    freq = search.section_frequency(_cited(spark, sf_dir).where("query_id % 2 = 0")).withColumn("query_id", F.concat(F.col("query_id").cast("string"), F.lit("-0")))
    k = F.col("n_nationkey")
    over = table(spark, sf_dir, "nation").select(_pick(feedback.ACTIONS, k * 5).alias("intent_action"), F.concat(F.lit("L"), k.cast("string")).alias("form_id"), F.col("n_name").alias("form_name"), F.lit(1.0).alias("confidence"), (k % 2 == 0).alias("locked")).where(F.col("form_id").isin(*[f"L{i}" for i in range(9)]))
    fixes = first.where("conv_id % 7 = 3").select(T.query_hash(F.col("text")).alias("query_hash"), _pick(feedback.ACTIONS, F.col("conv_id")).alias("action")).dropDuplicates(["query_hash"])
    return forms.resolve(first.select("query_id", "text"), first.drop("text", "conv_id", "turn"), freq, _forms(spark, sf_dir), over, fixes)


@sql(f"""WITH {_CITED.replace('FROM conversations)', 'FROM conversations WHERE conv_id % 2 = 0)')}, {_FORMS}, {_TAXONOMY}, {_INTENTS}, {_BY_SECTION},
fix AS (SELECT {_hash('text')} AS h, any_value({_pick_sql(feedback.ACTIONS, 'conv_id')}) AS fixed FROM it WHERE turn = 0 AND conv_id % 7 = 3 GROUP BY 1),
a AS (SELECT it.* REPLACE (coalesce(fixed, action) AS action, fixed IS NOT NULL OR sure AS sure) FROM it LEFT JOIN fix ON fix.h = {_hash('it.text')} WHERE turn = 0),
asked AS (SELECT * FROM a WHERE sure), {_intent_forms_sql('asked')},
over AS (SELECT {_pick_sql(feedback.ACTIONS, 'n_nationkey * 5')} AS action, 'L' || n_nationkey AS form_id, n_name AS name FROM nation WHERE n_nationkey < 9 AND n_nationkey % 2 = 0),
every AS (SELECT query_id, 0 AS o, 'locked_override' AS path, 1 AS rank, form_id, name, 1.0::DOUBLE AS score FROM a JOIN over USING (action)
  UNION ALL SELECT query_id, 1, 'agent', rank, form_id, name, score::DOUBLE FROM by_intent UNION ALL SELECT query_id || '-0', 2, 'section_match', rank, form_id, name, score FROM by_section),
best AS (SELECT * FROM every QUALIFY o = min(o) OVER (PARTITION BY query_id))
SELECT a.query_id, coalesce(path, 'none') AS path, coalesce(rank, 0)::INT AS rank, form_id, name, round(score, 6) AS score FROM a LEFT JOIN best USING (query_id)""")
def resolved_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("query_id", "path", F.coalesce("rank", F.lit(0)).alias("rank"), "form_id", "name", F.round("score", 6).alias("score"))


@sql("""WITH l AS (SELECT n_nationkey AS k, n_name AS name FROM nation)
SELECT 'F' || k AS form_id, name, CASE WHEN k % 3 = 0 THEN 'No. ' || k ELSE '' END AS form_number,
  CASE WHEN k % 3 = 0 THEN 'https://forms.example/portal/' || k WHEN k % 2 = 0 THEN 'https://forms.example/pdf/' || k ELSE '' END AS url,
  CASE WHEN k % 3 = 0 THEN 'portal' ELSE 'pdf' END AS link_type, 'form' AS resource_type FROM l""")
def forms_to_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.output_forms(_forms(spark, sf_dir))


_KEY = "md5('u' || (conv_id % 3) || ':' || left(text, 100) || '_en')"


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text", F.lit("en").alias("lang"), F.concat(F.lit("u"), (F.col("conv_id") % 3).cast("string")).alias("user"))


@sql(f"""WITH k AS (SELECT {_KEY} AS cache_key, min(conv_id * 100 + turn) AS seq, bool_or(turn % 4 = 2) AS down, bool_or(turn % 4 = 2 AND conv_id % 2 = 0) AS up FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT cache_key, NOT down AS kept, down AND NOT up AS flagged FROM k WHERE NOT down OR NOT up""")
def rated_down_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept resolutions of all questions after every third turn was rated down, and those of even conversations up again."""
    q = _keyed(spark, sf_dir)
    kept = q.select(forms.cache_key(F.col("text"), F.col("lang"), F.col("user")).alias("cache_key")).distinct().withColumns({"path": F.lit("agent"), "form_id": F.lit("f")})
    down = q.where("turn % 4 = 2")
    kept, flagged = forms.invalidate(kept, kept.select("cache_key").limit(0), down)
    flagged = forms.clear_negative(flagged, down.where("conv_id % 2 = 0"))
    return kept.select("cache_key", F.lit(True).alias("kept"), F.lit(False).alias("flagged")).unionByName(flagged.select("cache_key", F.lit(False).alias("kept"), F.lit(True).alias("flagged")))


@sql(f"""WITH k AS (SELECT {_KEY} AS cache_key, min(conv_id * 100 + turn) AS seq, min(turn) AS turn, min(conv_id) AS conv FROM conversations WHERE role = 'user' GROUP BY 1)
SELECT cache_key, CASE WHEN conv % 2 = 1 THEN 'section_match' ELSE 'agent' END AS path, seq FROM k ORDER BY seq DESC, cache_key LIMIT 200""")
def kept_form_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions' resolutions are kept; those of odd conversations come again by another path; the latest 200 stay."""
    q = _keyed(spark, sf_dir).withColumn("cache_key", forms.cache_key(F.col("text"), F.col("lang"), F.col("user")))
    each = q.groupBy("cache_key").agg(F.min(F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.min("conv_id").alias("conv"))
    new = each.where("conv % 2 = 1").select("cache_key", F.lit("section_match").alias("path"), F.lit("g").alias("form_id"), "seq")
    return forms.remember(each.select("cache_key", F.lit("agent").alias("path"), F.lit("f").alias("form_id"), "seq"), new).select("cache_key", "path", "seq")


@sql(f"SELECT string_agg('- ' || text, chr(10) ORDER BY 'k' || lpad((conv_id * 100 + turn)::VARCHAR, 9, '0')) AS block FROM conversations WHERE turn = 0")
def classifier_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turns as corrections of a classifier, one text."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("turn") == 0, "intent_direction_correction").otherwise("other")
    return forms.classifier_patches(c.select(F.concat(F.lit("k"), F.lpad((F.col("conv_id") * 100 + F.col("turn")).cast("string"), 9, "0")).alias("key"), kind.alias("type"), F.col("text").alias("patch_text")))


# ---- answers ----

_ANSWERS = ["<think>it may be so. ", "Per the CONTEXT provided, ", "I couldn't find this in what I have access to. ", "❌ ", "Jabatan Pendaftaran Syarikat says: ", "As the CONTEXT shows ", ""]
_TAILS = ["", "\n\n\n\nThe end", " —", ". "]


def _postprocess_sql() -> str:
    x = "regexp_replace(raw, '(?is)<(?:think|thinking|reasoning|reflection)>.*$', '')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    for p, new in C.REWRITES:
        x = f"regexp_replace({x}, {_q('(?i)' + p)}, {_q(new)}, 'g')"
    x = _STRIP.format(x)
    malay = "x1"
    for p, new in C.MALAY_REWRITES:
        malay = f"regexp_replace({malay}, {_q('(?i)' + p)}, {_q(new)}, 'g')"
    oos = "(?i)" + C.OUT_OF_SCOPE
    return rf"""WITH a AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 1 THEN 'ms' ELSE 'en' END AS lang, {_pick_sql(_ANSWERS, 'conv_id + turn')} || text || {_pick_sql(_TAILS, 'turn')} AS raw FROM conversations WHERE role = 'assistant'),
b AS (SELECT *, {x} AS x1 FROM a), c AS (SELECT *, regexp_replace(CASE WHEN lang = 'ms' THEN {malay} ELSE x1 END, {_q('(?i)' + C.WRONG_AGENCY)}, {_q(C.AGENCY)}, 'g') AS x2 FROM b),
d AS (SELECT *, regexp_extract(x2, {_q('(?is)^(.*?)(?:' + C.OUT_OF_SCOPE + ')')}, 1) AS before FROM c),
e AS (SELECT *, regexp_extract(substr(x2, length(before) + 1), '(?s)^([^.]*\.(?:[^.]*\.)?)', 1) AS said FROM d),
f AS (SELECT *, CASE WHEN regexp_matches(x2, {_q(oos)}) AND length(before) < 80 AND said <> '' THEN {_STRIP.format('before || said')} ELSE x2 END AS x3 FROM e)
SELECT conv_id, turn, md5(CASE WHEN starts_with(raw, '❌') OR starts_with(raw, 'No relevant sections') OR starts_with(raw, 'This information is not found') THEN raw
  WHEN x3 <> '' AND NOT regexp_matches(x3, '[.!?)\]`*|\-\p{{L}}\p{{N}}_]\s*$') THEN x3 || {_q(C.CUT_OFF_NOTICE)} ELSE x3 END) AS digest FROM f"""


@sql(_postprocess_sql())
def postprocessed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer with a beginning and an end by its numbers, made fit to show."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    raw = F.concat(_pick(_ANSWERS, F.col("conv_id") + F.col("turn")), "text", _pick(_TAILS, F.col("turn")))
    return c.select("conv_id", "turn", F.md5(R.postprocess(raw, F.when(F.col("conv_id") % 3 == 1, "ms").otherwise("en")).cast("binary")).alias("digest"))


_URL = "'https://forms.example/' || conv_id"


@sql(rf"""WITH a AS (SELECT conv_id, turn, CASE WHEN conv_id % 3 = 1 THEN 'ms' ELSE 'en' END AS lang, 'Notice ' || conv_id AS name, 'No. 7' || turn AS number, {_URL} AS url,
  text || CASE turn % 4 WHEN 1 THEN ' File the notice ' || conv_id || ' soon.' WHEN 3 THEN ' Use no. 7' || turn || ' now.' ELSE '' END || CASE WHEN conv_id % 5 = 0 THEN ' [x](' || {_URL} || ')' ELSE '' END AS t FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, md5(CASE WHEN conv_id % 5 = 0 THEN t WHEN turn % 4 = 1 THEN regexp_replace(t, '(?i)notice ' || conv_id, '[' || name || '](' || url || ')') WHEN turn % 4 = 3 THEN regexp_replace(t, '(?i)no\. 7' || turn, '[' || number || '](' || url || ')')
  ELSE regexp_replace(t, '\s+$', '') || CASE lang WHEN 'ms' THEN {_q(C.FORM_NOTES['ms'])} ELSE {_q(C.FORM_NOTES['en'])} END || '[' || name || '](' || url || ')' END) AS digest FROM a""")
def linked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every answer with a form whose name or number it has, or neither, or whose link is there already."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    url = F.concat(F.lit("https://forms.example/"), conv)
    text = F.concat("text", F.when(F.col("turn") % 4 == 1, F.concat(F.lit(" File the notice "), conv, F.lit(" soon."))).when(F.col("turn") % 4 == 3, F.concat(F.lit(" Use no. 7"), turn, F.lit(" now."))).otherwise(""), F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit(" [x]("), url, F.lit(")"))).otherwise(""))
    form = F.array(F.struct(F.concat(F.lit("Notice "), conv).alias("name"), F.concat(F.lit("No. 7"), turn).alias("number"), url.alias("url")))
    return c.select("conv_id", "turn", F.md5(R.inject_links(text, form, F.when(F.col("conv_id") % 3 == 1, "ms").otherwise("en")).cast("binary")).alias("digest"))


_ASKS = ["how to convert a public company ", "strike off my firm ", "please appoint a new director ", "the annual return ", "winding up ", "resign as secretary ", "hello ", "incorporat ion "]


@sql(f"""WITH a AS (SELECT conv_id, turn, {_pick_sql(_ASKS, 'conv_id + turn')} || text AS q FROM conversations) SELECT conv_id, turn, CASE {" ".join(f"WHEN regexp_matches(q, {_q('(?i)' + p)}) THEN {_q(i)}" for p, i in C.KEYWORD_INTENTS)} ELSE '' END AS action FROM a""")
def keyword_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", R.keyword_intent(F.concat(_pick(_ASKS, F.col("conv_id") + F.col("turn")), "text")).alias("action"))


@sql("""SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE md5(replace(replace(text, '"', ''''), chr(92), '/')) END AS digest FROM conversations""")
def repaired_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as the value of an object with raw line ends, every fourth one cut off."""
    plain = F.translate(F.col("text"), '"\\', "'/")
    raw = F.concat(F.lit('{"content": "'), plain, F.when(F.col("turn") % 4 == 3, "").otherwise('"}'))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.get_json_object(R.repair_json_column(raw), "$.content").cast("binary")).alias("digest"))


_SAID = ["hold_agm", "no_such_action", "change_company_name"]


@sql(f"""WITH a AS (SELECT conv_id, turn, {_pick_sql(_SAID, 'conv_id + turn')} AS action, turn % 3 = 2 AS cut FROM conversations)
SELECT conv_id, turn, CASE WHEN action = 'no_such_action' THEN 'unknown' ELSE action END AS action, (conv_id % 10) / 10 AS confidence, '340,' || turn || 'A' AS sections, CASE WHEN cut THEN false ELSE turn % 2 = 0 END AS is_actionable FROM a""")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier's answers by the turns' numbers: sections without quotes, every third one cut off after a whole pair."""
    c = table(spark, sf_dir, "conversations")
    raw = F.concat(F.lit('{"action": "'), _pick(_SAID, F.col("conv_id") + F.col("turn")), F.lit('", "confidence": 0.'), (F.col("conv_id") % 10).cast("string"), F.lit(', "likely_sections": [340, '), F.col("turn").cast("string"), F.lit('A], "reasoning": "so", '), F.when(F.col("turn") % 3 == 2, '"legal_proc').otherwise(F.concat(F.lit('"is_actionable": '), F.when(F.col("turn") % 2 == 0, "true").otherwise("false"), F.lit("}"))))
    i = R.intent_column(raw)
    return c.select("conv_id", "turn", i.alias("i")).select("conv_id", "turn", "i.action", "i.confidence", F.array_join("i.likely_sections", ",").alias("sections"), "i.is_actionable")


@sql(r"""SELECT conv_id, turn, md5(regexp_replace(text || ' end', '^\s+|\s+$', '', 'g')) AS digest, md5(text || ' seen') AS seen FROM conversations""")
def reasoning_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with a block of reasoning in it, as a whole and as a stream of tokens."""
    c = table(spark, sf_dir, "conversations")
    whole = F.concat("text", F.lit("<think>a.\nb</think> end"))
    stream = F.array("text", F.lit(" <thi"), F.lit("nk>no</th"), F.lit("ink>seen<think>open"))
    return c.select("conv_id", "turn", F.md5(T.strip_reasoning(whole).cast("binary")).alias("digest"), F.md5(T.visible_tokens(stream).cast("binary")).alias("seen"))


@sql("SELECT conv_id, turn, left(md5(text || (conv_id * 60 + turn)), 12) AS qa_id, greatest(2048, least(8192, ceil((length(text) * 40 / 4) / 512) * 512))::INT AS window_size FROM conversations")
def turn_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's id by its text and time, and the context window that forty such texts need."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.qa_id(F.col("text"), (F.col("conv_id") * 60 + F.col("turn")).cast("string")).alias("qa_id"), T.context_size(F.length("text") * 40).alias("window_size"))


@sql(rf"""WITH {_T}, p AS (SELECT session, turn, CASE WHEN length(r) <= 1200 THEN r WHEN length(regexp_extract(left(r, 1200), '(?s)^(.*[.!?]\s)', 1)) > 60 THEN regexp_extract(left(r, 1200), '(?s)^(.*[.!?]\s)', 1) ELSE left(r, 1200) END AS cut, CASE WHEN turn % 4 = 2 THEN ' | VISUAL CONTENT' ELSE '' END AS kind FROM t),
c AS (SELECT session, string_agg('[SOURCE: S' || turn || kind || ']' || chr(10) || cut || chr(10) || '[/SOURCE: S' || turn || ']', chr(10) || chr(10) ORDER BY turn) AS context, max(turn) AS last FROM p GROUP BY 1)
SELECT c.session, md5('H' || chr(10) || '<<CONTEXT_BLOCK>>' || chr(10) || '{G.RULE}' || chr(10) || context || chr(10) || '{G.RULE}' || chr(10) || chr(10) || '<<USER_QUESTION>>' || chr(10) || q || chr(10)) AS digest FROM c JOIN t ON t.session = c.session AND t.turn = c.last""")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt a conversation: its answers as passages, and its last question."""
    t = _turns(spark, sf_dir)
    ranked = t.select(F.col("session").alias("query_id"), F.col("turn").alias("rank"), F.concat(F.lit("S"), F.col("turn").cast("string")).alias("source_name"), F.when(F.col("turn") % 4 == 2, "visual").otherwise("text").alias("chunk_type"), F.col("response").alias("text"))
    last = t.groupBy("session").agg(F.max_by("query", "turn").alias("query"))
    df = G.context_block(ranked).join(last, F.col("query_id") == F.col("session"))
    none = F.lit(None).cast("string")
    return df.select("session", F.md5(G.prompt(F.col("query"), F.col("context"), F.lit("H\n"), none, none).cast("binary")).alias("digest"))


# ---- feedback and learned corrections ----

_NAMED = ["", "wrong_form", "incomplete", "", "other"]


@sql(f"""WITH f AS (SELECT doc_id // 2 AS qa_id, doc_id AS row_no, {_pick_sql(_NAMED, 'doc_id')} AS kind, CASE WHEN quality = 0 THEN 'hallucination' END AS found FROM labels),
g AS (SELECT qa_id, min(found) AS found FROM f GROUP BY 1), w AS (SELECT f.qa_id, row_no, kind, g.found, row_number() OVER (PARTITION BY f.qa_id ORDER BY row_no) = 1 AND kind = '' AS empty FROM f JOIN g USING (qa_id))
SELECT qa_id, row_no, CASE WHEN empty THEN coalesce(found, kind) ELSE kind END AS failure_type, empty AND found IS NOT NULL AS auto_diagnosed FROM w""")
def failures_written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as feedback, two to an id; a diagnosis of the bad ones fills an id's first row where that has none."""
    x = table(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 2).alias("qa_id"), F.col("doc_id").alias("ts"), _pick(_NAMED, F.col("doc_id")).alias("failure_type"), "quality")
    found = x.where("quality = 0").select("qa_id", F.lit("hallucination").alias("failure_type"))
    return feedback.write_back(x, found).select("qa_id", F.col("ts").alias("row_no"), "failure_type", "auto_diagnosed")


@sql("""SELECT conv_id, turn, left(coalesce(text, ''), 300) AS response_snippet, CASE WHEN turn % 3 = 0 THEN 0 ELSE turn % 5 END AS rating, '' AS failure_type FROM conversations""")
def feedback_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    f = c.select(F.concat_ws("-", "conv_id", "turn").alias("qa_id"), F.lit(0).alias("ts"), F.lit("").alias("query"), F.col("text").alias("response"), F.when(F.col("turn") % 3 != 0, F.col("turn") % 5).alias("rating"), F.lit(None).cast("string").alias("failure_type"), F.lit(None).cast("string").alias("comment"), F.lit(None).cast("array<string>").alias("form_ids"), F.lit(None).cast("boolean").alias("form_correct"))
    return feedback.record(f).select(F.split("qa_id", "-")[0].cast("long").alias("conv_id"), F.split("qa_id", "-")[1].cast("long").alias("turn"), "response_snippet", "rating", "failure_type")


@sql("""WITH f AS (SELECT doc_id, CASE WHEN toxic = 1 AND quality = 0 THEN ['truncation', 'uncited_answer'] WHEN toxic = 1 THEN ['truncation'] WHEN quality = 0 THEN ['uncited_answer'] ELSE [] END AS issues FROM labels),
n AS (SELECT count(*) AS total, count_if(len(issues) = 0)::BIGINT AS without_issue FROM f), c AS (SELECT type, count(*) AS n FROM (SELECT unnest(issues) AS type FROM f) GROUP BY 1),
l AS (SELECT doc_id FROM f ORDER BY doc_id DESC LIMIT 5)
SELECT total, without_issue, (SELECT string_agg(type || ' ' || n || ' ' || round(n / total, 4), ', ' ORDER BY type) FROM c) AS counts, (SELECT string_agg('q' || doc_id, ', ' ORDER BY doc_id DESC) FROM l) AS recent FROM n""")
def learning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as failures with their issues, newest by id."""
    issue = lambda kind: F.struct(F.lit(kind).alias("type"))
    x = table(spark, sf_dir, "labels")
    f = x.select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("query_hash"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("query"), F.lit("generation").alias("root_agent"), F.array_compact(F.array(F.when(F.col("toxic") == 1, issue("truncation")), F.when(F.col("quality") == 0, issue("uncited_answer")))).alias("auto_issues"), F.col("doc_id").alias("ts"))
    counts = F.transform("counts", lambda c: F.concat_ws(" ", c["type"], c["n"].cast("string"), F.round(c["share"], 4).cast("string")))
    return feedback.stats(f).select("total", "without_issue", F.array_join(counts, ", ").alias("counts"), F.array_join("recent.query", ", ").alias("recent"))


_SUGGEST = ["hold_agm", "no_such", "allot_shares", "hold_agm", "strike_off_company"]


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    n = F.col("session") + F.col("turn")
    return t.select("query", _pick(_SUGGEST, n).alias("suggested_intent"), F.concat(F.lit("f"), (n % 3).cast("string")).alias("form_id"), F.array(F.concat(F.lit("Section "), (n % 9).cast("string"), F.lit("A"))).alias("suggested_sections"), (F.col("session") * 1000 + F.col("turn")).alias("ts"))


@sql(f"""WITH {_T}, f AS (SELECT {_hash('q')} AS h, q, {_pick_sql(_SUGGEST, 'session + turn')} AS action, 'f' || ((session + turn) % 3) AS form, session * 1000 + turn AS ts FROM t),
k AS (SELECT * FROM f WHERE action <> 'no_such'), first AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY action ORDER BY ts) = 1)
SELECT 'override' AS kind, action AS key, form || ' [flagged: ' || action || ']' AS value FROM first
UNION ALL SELECT 'correction', h, action FROM k QUALIFY row_number() OVER (PARTITION BY h ORDER BY ts DESC) = 1
UNION ALL SELECT 'patch', 'intent_correction_' || action, left(regexp_replace(lower(trim(q)), '\\s+', ' ', 'g'), 80) FROM first""")
def learned_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions as failures with suggested actions; none is known before."""
    f = _failures(spark, sf_dir)
    over = "intent_action string, form_id string, form_name string, confidence double, locked boolean, confirmed_positive long, confirmed_negative long, ts long"
    empty = lambda s: spark.createDataFrame([], s)
    o, c, p = feedback.correct_mapping(empty(over), empty("query_hash string, action string, ts long"), empty("key string, type string, correct_intent string, example_query string, patch_text string, ts long"), f)
    row = lambda df, kind, key, value: df.select(F.lit(kind).alias("kind"), F.col(key).alias("key"), value.alias("value"))
    return row(o, "override", "intent_action", F.concat_ws(" ", "form_id", "form_name")).unionByName(row(c, "correction", "query_hash", F.col("action"))).unionByName(row(p, "patch", "key", F.col("example_query")))


@sql(f"""WITH {_T}, f AS (SELECT {_hash('q')} AS query_hash, ((session + turn) % 9) || 'a' AS section_parent, q, session * 1000 + turn AS ts FROM t)
SELECT query_hash, section_parent, 0.15::DOUBLE AS delta, 'suggested by self-reflection: ' || left(q, 60) AS reason FROM f QUALIFY row_number() OVER (PARTITION BY query_hash, section_parent ORDER BY ts) = 1""")
def learned_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], "query_hash string, section_parent string, reason string, ts long, delta double, section_child string")
    return feedback.correct_retrieval(empty, _failures(spark, sf_dir)).select("query_hash", "section_parent", "delta", "reason")


_AGENTS = ["retrieval", "generation", "form_mapping", "unknown"]


def _negative_sql() -> str:
    best = "CASE WHEN d THEN 'incomplete' WHEN a OR b THEN 'wrong_form' WHEN c THEN 'hallucination' END"
    by_agent = " ".join(f"WHEN said = {_q(k)} THEN {_q(v)}" for k, v in C.AGENT_TO_FAILURE)
    i = lambda p: _q("(?i)" + p)
    guess = " ".join(f"WHEN regexp_matches(q, {i(p)}) THEN {_q(v)}" for p, v in C.KEYWORD_INTENTS)
    return rf"""WITH {_T.replace("c.text AS q", _pick_sql(_ASKS, "c.conv_id + c.turn") + " || c.text AS q").replace("a.text AS r", "a.text || CASE WHEN c.turn % 4 = 2 THEN ' It was cut off before completion' ELSE '' END AS r")},
f AS (SELECT *, {_pick_sql(_AGENTS, 'session')} AS said, len(regexp_extract_all(r, '(?i)\[([^\]]+)\]\(https?://[^\)]+\)')) > 0 AS a, regexp_matches(r, {i(C.NOT_FOUND)}) AS unknown, regexp_matches(r, {i(C.CUT_OFF)}) AS d FROM t),
g AS (SELECT *, regexp_matches(q, {i(C.PROCEDURAL)}) AND NOT a AND NOT unknown AS b, length({_STRIP.format('r')}) > 120 AND NOT regexp_matches(r, {i(C.CITATION)}) AND NOT unknown AS c, CASE {guess} ELSE '' END AS guess FROM f),
h AS (SELECT *, CASE WHEN d THEN 'generation' ELSE said END AS agent FROM g)
SELECT session, turn, CASE WHEN guess <> '' THEN 'form_mapping' ELSE agent END AS root_agent, guess AS suggested_intent, coalesce({best}, CASE {by_agent.replace('said', 'agent')} END, 'other') AS failure_type,
  CASE WHEN guess <> '' OR agent = 'form_mapping' THEN 'mapping' WHEN agent = 'retrieval' THEN 'retrieval' WHEN agent = 'generation' THEN 'prompt' ELSE 'none' END AS route FROM h"""


@sql(_negative_sql())
def diagnosed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as rated down, with an agent by a model's view; every second answer breaks off."""
    t = _turns(spark, sf_dir)
    key = F.concat_ws("-", "session", "turn").alias("qa_id")
    turns = t.select(key, F.concat(_pick(_ASKS, F.col("session") + F.col("turn")), "query").alias("query"), F.concat("response", F.when(F.col("turn") % 4 == 2, " It was cut off before completion").otherwise("")).alias("response"), F.array().cast("array<string>").alias("shown"))
    said = t.select(key, _pick(_AGENTS, F.col("session")).alias("root_agent"), F.lit("").alias("suggested_intent"))
    out = feedback.negative_pipeline(turns, said)
    return out.select(F.split("qa_id", "-")[0].cast("long").alias("session"), F.split("qa_id", "-")[1].cast("long").alias("turn"), "root_agent", "suggested_intent", "failure_type", feedback.correction_route(F.col("root_agent")).alias("route"))


# ---- memory ----

_STATES = ["Please always cite section numbers. ", "I am a director. ", "That's wrong. ", "reply in Malay, I work as an auditor. ", ""]


@sql(rf"""WITH m AS (SELECT conv_id % 5 AS user, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (conv_id * 60 + turn) AS ts, {_STRIP.format(_pick_sql(_STATES, 'conv_id + turn') + ' || text')} AS text FROM conversations WHERE role = 'user'),
k AS ({" UNION ALL ".join(rf"SELECT user, ts, {i} AS pos, {_q(k)} AS memory_type, 'longterm' AS tier, {_q(lead)} || {_STRIP.format('regexp_extract(text, ' + _q('(?i)' + p) + ', 0)')} AS content FROM m WHERE regexp_matches(text, {_q('(?i)' + p)})" for i, (p, k, lead) in enumerate(C.MEMORY_PATTERNS))}
  UNION ALL SELECT user, ts, {len(C.MEMORY_PATTERNS)}, 'correction', 'midterm', 'User correction: ' || left(text, 200) FROM m WHERE regexp_matches(text, {_q('(?i)' + C.CORRECTION)}))
SELECT user, ts, pos, memory_type, tier, content, left(md5(content || ts::VARCHAR), 12) AS memory_id, CASE WHEN tier = 'midterm' THEN ts + INTERVAL 7 DAYS END AS expires_at FROM k""")
def detected_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.detect(_messages(spark, sf_dir)).withColumns({"ts": F.col("ts").cast("timestamp_ntz"), "expires_at": F.col("expires_at").cast("timestamp_ntz")})


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns that state something by their numbers, a minute apart."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("conv_id") * 60 + F.col("turn")) * 60)
    return c.select((F.col("conv_id") % 5).alias("user"), ts.alias("ts"), F.concat(_pick(_STATES, F.col("conv_id") + F.col("turn")), "text").alias("text"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as memories of three users: a fact by their numbers, every third one for a week, two hours apart."""
    c = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") * 20 + F.col("turn")
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + n * 7200)
    tier = F.when(n % 3 == 0, "midterm").otherwise("longterm")
    return c.select((F.col("conv_id") % 3).alias("user"), ts.alias("ts"), F.lit(0).alias("pos"), n.alias("n"), tier.alias("tier"), F.concat(F.lit("the fact number "), (n * 7 % 97).cast("string"), F.lit(" of "), (n % 2).cast("string")).alias("content"), F.when(tier == "midterm", ts + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))


@sql("""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY n) AS i FROM (SELECT conv_id % 3 AS u, conv_id * 20 + turn AS n, (conv_id * 20 + turn) * 7200 AS sec, (conv_id * 20 + turn) % 3 = 0 AS mid, ['the', 'fact', 'number', 'of', ((conv_id * 20 + turn) * 7 % 97)::VARCHAR, ((conv_id * 20 + turn) % 2)::VARCHAR] AS w FROM conversations)),
z AS (SELECT * REPLACE (list_distinct(w) AS w) FROM e),
r AS (SELECT u, n, i, true AS kept, [{'w': w, 'mid': mid, 'ends': CASE WHEN mid THEN sec + 604800 END}] AS held FROM z WHERE i = 1
  UNION ALL SELECT u, n, i, ok, CASE WHEN NOT ok THEN alive ELSE
    CASE WHEN len(list_filter(alive, lambda h: h.mid = new.mid)) >= CASE WHEN new.mid THEN 20 ELSE 50 END
      THEN list_append(list_concat(alive[1:list_position(list_transform(alive, lambda h: h.mid), new.mid) - 1], alive[list_position(list_transform(alive, lambda h: h.mid), new.mid) + 1:]), new)
      ELSE list_append(alive, new) END END
  FROM (SELECT z.u, z.n, z.i, {'w': z.w, 'mid': z.mid, 'ends': CASE WHEN z.mid THEN z.sec + 604800 END} AS new, list_filter(r.held, lambda h: h.ends IS NULL OR h.ends >= z.sec) AS alive,
    len(list_filter(r.held, lambda h: (h.ends IS NULL OR h.ends >= z.sec) AND len(list_intersect(h.w, z.w)) > 0.8 * (len(h.w) + len(z.w) - len(list_intersect(h.w, z.w))))) = 0 AS ok FROM r JOIN z ON z.u = r.u AND z.i = r.i + 1))
SELECT u AS user, n FROM r WHERE kept""")
def stored_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user's memories come to, with repeats left out, caps and ends."""
    return memory.suppress_repeats(_records(spark, sf_dir)).select("user", "n")


@sql("""SELECT CASE WHEN (conv_id * 20 + turn) % 3 = 0 THEN 'midterm' ELSE 'longterm' END AS tier, count(*) AS n FROM conversations WHERE (conv_id * 20 + turn) % 3 <> 0 GROUP BY 1""")
def memory_tier_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories by tier after the mid-term ones were cleared."""
    return memory.tier_counts(memory.clear_tier(_records(spark, sf_dir), "midterm"))


@sql(rf"""WITH q AS (SELECT conv_id AS query_id, conv_id % 3 AS u, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations WHERE turn = 0),
m AS (SELECT conv_id % 3 AS u, conv_id * 20 + turn AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w, turn % 2 AS mid FROM conversations),
s AS (SELECT query_id, id, mid, len(list_filter(q.w, lambda x: list_contains(m.w, x))) / greatest(len(q.w), 1) * 0.4 AS score FROM q JOIN m USING (u))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, mid, id))::INT AS rank, id::VARCHAR AS memory_id, round(score, 6) AS score FROM s WHERE score >= 0.1 QUALIFY rank <= 3""")
def memories_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memories, without vectors, whose words a conversation's first question shares most."""
    c = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") * 20 + F.col("turn")
    none = F.lit(None).cast("array<float>")
    r = c.select((F.col("conv_id") % 3).alias("user"), n.cast("string").alias("memory_id"), F.when(F.col("turn") % 2 == 0, "longterm").otherwise("midterm").alias("tier"), n.alias("seq"), F.col("text").alias("content"), none.alias("embedding"))
    q = c.where("turn = 0").select(F.col("conv_id").alias("query_id"), (F.col("conv_id") % 3).alias("user"), "text", F.array(F.lit(1.0)).cast("array<float>").alias("embedding"))
    return memory.rank(r, q, 0.1).select("query_id", "rank", "memory_id", F.round("score", 6).alias("score"))


_KINDS = ["preference", "instruction", "correction", "session_summary", "note"]


@sql(f"""WITH l AS (SELECT conv_id, string_agg('  ' || {_pick_sql(["Your preference", "Your instruction", "Your correction", "Recent topics", "Note"], 'turn')} || ': ' || left(text, 60), chr(10) ORDER BY turn) AS lines FROM conversations WHERE turn < 3 GROUP BY 1),
b AS (SELECT conv_id, {_q(C.MEMORY_HEAD)} || repeat('-', 40) || chr(10) || lines || chr(10) || repeat('-', 40) || chr(10) || chr(10) AS block FROM l)
SELECT conv_id AS query_id, md5(CASE WHEN length(block) > 500 THEN left(block, 500) || chr(10) || '[memory truncated]' || chr(10) || chr(10) ELSE block END) AS digest FROM b""")
def memory_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that three memories a conversation give a prompt."""
    c = table(spark, sf_dir, "conversations").where("turn < 3")
    chosen = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), _pick(_KINDS, F.col("turn")).alias("memory_type"), F.left("text", F.lit(60)).alias("content"))
    return memory.memory_block(chosen).select("query_id", F.md5(F.col("block").cast("binary")).alias("digest"))


@sql("""WITH e AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 2)
SELECT conv_id AS user, 'Recent session topics: ' || left(text, 80) AS content, (TIMESTAMP '2024-01-08' + INTERVAL 1 MINUTE * turn) AS expires_at FROM e""")
def evicted_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the turns that a history of two leaves out were about."""
    gone = feedback.evicted(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")], 2)
    out = memory.session_summary(gone.select(F.col("conv_id").alias("user"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("turn") * 60).alias("ts"), F.col("text").alias("query")))
    return out.select("user", "content", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))


@sql(f"WITH {_T} SELECT session, md5(string_agg('User: ' || q || chr(10) || 'Assistant: ' || r, chr(10) || chr(10) ORDER BY turn)) AS digest FROM t GROUP BY 1")
def exported_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.conversation_text(_turns(spark, sf_dir).withColumnRenamed("turn", "seq")).select("session", F.md5(F.col("text").cast("binary")).alias("digest"))


# ---- streams, run to the end of what is there ----


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as three files out of order, and one event long after them, which moves the watermark past them."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("value"))
    last = e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 900 DAYS")).alias("ts"), F.lit("end").alias("value"))
    at = scratch(spark)
    for part in (e.where("event_id % 2 = 1"), e.where("event_id % 2 = 0"), last):
        part.write.mode("append").parquet(at)
    return spark.readStream.schema(e.schema).parquet(at)


def _drained(stream: DataFrame) -> DataFrame:
    out, state = scratch(stream.sparkSession), scratch(stream.sparkSession)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


@sql(RATE_SQL)
def rate_limit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(jobs.rate_limit(_event_stream(spark, sf_dir), 5, 86_400, "400 days")).where("user_id >= 0")


@sql(STREAK_SQL.replace("event_type FROM b", "event_type AS value FROM b"))
def streak_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(jobs.streaks(_event_stream(spark, sf_dir), 3, "400 days")).where("user_id >= 0")


@sql("SELECT user_id, event_id AS id, (count(*) + count_if(event_id % 2 = 0))::BIGINT AS told FROM events GROUP BY ALL")
def memory_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as memories, every second one for a week: each is told when it comes in, and again when it ends."""
    e = _event_stream(spark, sf_dir).withColumn("expires_at", F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr("INTERVAL 7 DAYS")))
    out = _drained(jobs.memories(e.withColumnRenamed("event_id", "id"), "400 days")).where("user_id >= 0")
    return out.groupBy("user_id", "id").agg(F.count("*").alias("told"))


@sql("SELECT user_id::VARCHAR AS session_id, (count(*) + count_if(event_id % 5 = 0))::BIGINT AS n FROM events GROUP BY 1")
def message_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages that come in twice, every fifth one without an id."""
    e = _event_stream(spark, sf_dir).where("user_id >= 0")
    m = e.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"), F.when(F.col("event_id") % 5 == 0, "").otherwise(F.col("event_id").cast("string")).alias("qa_id"), F.col("user_id").cast("string").alias("session_id"), F.col("ts").alias("created_at"))
    return _drained(jobs.once(m, "400 days")).groupBy("session_id").agg(F.count("*").alias("n"))


@sql("""WITH e AS (SELECT event_id // 2 AS k, event_id, CASE WHEN event_id % 2 = 1 THEN (event_id // 2) % 5 + 1 END AS rating FROM events),
f AS (SELECT k, max(rating) AS rating, bool_or(event_id % 2 = 0) AS asked FROM e GROUP BY 1)
SELECT 'e' || k AS qa_id, rating::INT AS rating, CASE WHEN rating <= 2 THEN CASE WHEN asked THEN 'incomplete' ELSE 'other' END END AS failure_type FROM f""")
def feedback_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feedback in three batches: answers first, their ratings in two later ones, the last batch twice."""
    e = table(spark, sf_dir, "events")
    k = F.floor(F.col("event_id") / 2)
    answer = F.col("event_id") % 2 == 0
    text = lambda v: F.when(answer, F.lit(v))
    f = e.select(F.concat(F.lit("e"), k.cast("string")).alias("qa_id"), F.col("ts").cast("timestamp").alias("ts"), text("what is it").alias("query"), text("It was cut off before completion").alias("response"), F.when(~answer, k % 5 + 1).cast("int").alias("rating"), F.lit(None).cast("string").alias("failure_type"), F.lit(None).cast("string").alias("comment"), F.lit(None).cast("array<string>").alias("form_ids"), F.when(answer, 0).otherwise(1 + k % 2).alias("batch"))
    kept = store.UpsertTable(scratch(spark), ["qa_id"])
    for number in (0, 1, 2, 2):
        jobs.learn_feedback(kept, f.where(F.col("batch") == number), number)
    kept.compact(spark, jobs.FEEDBACK_SCHEMA)
    return kept.read(spark, jobs.FEEDBACK_SCHEMA).select("qa_id", "rating", "failure_type")
