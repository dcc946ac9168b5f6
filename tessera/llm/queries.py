"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), columns=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licences import scan

    return scan(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.language_id import held_out, identify, learn

    docs = table(spark, sf_dir, "documents")
    asked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(asked, learn(docs), ["doc_id", "held_out"])


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substring_dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"), k=35)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
cov AS (SELECT DISTINCT r, i + o AS p FROM (SELECT r, i FROM win JOIN rep USING (h)) AS t, (SELECT unnest(range(35)) AS o) AS s),
w AS (SELECT r, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM w ANTI JOIN cov USING (r, p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.html_extraction import extract

    return extract(table(spark, sf_dir, "pages"))


#: What the method finds on the tables' pages, whose main text is one article element.
OP7_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS b FROM pages),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(b, lambda x:
  trim(regexp_replace(regexp_replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]+>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM a)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash_dedup import hex_fingerprint, near_duplicates

    near = near_duplicates(table(spark, sf_dir, "documents"))
    return near.select(F.col("id").alias("doc_id"), hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import without_lines

    out = without_lines(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH piece AS (SELECT doc_id, unnest(range(len(p))) AS line_no, unnest(p) AS line FROM (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS p FROM documents)),
line AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM piece),
seen AS (SELECT w, min((doc_id, line_no)) AS at FROM line WHERE len(w) > 0 GROUP BY w),
long AS (SELECT * FROM seen WHERE len(w) >= 4),
met AS (
  SELECT a.w AS x, b.w AS y, a.at AS p, b.at AS q FROM long AS a JOIN long AS b ON a.w[1] = b.w[1] AND len(b.w) - len(a.w) IN (0, 1)
  UNION SELECT a.w, b.w, a.at, b.at FROM long AS a JOIN long AS b ON a.w[-1] = b.w[-1] AND len(b.w) - len(a.w) IN (0, 1)),
near AS (SELECT x, y, p, q FROM met WHERE x <> y AND greatest(len(x), len(y)) >= 5 AND CASE WHEN len(x) = len(y)
  THEN len(list_filter(range(1, len(x) + 1), lambda i: x[i] <> y[i])) <= 1
  ELSE len(list_filter(range(0, len(x) + 1), lambda i: x[1:i] = y[1:i] AND x[i + 1:] = y[i + 2:])) > 0 END),
late AS (SELECT x AS w FROM near WHERE q < p UNION SELECT y FROM near WHERE p < q),
mark AS (SELECT l.*, len(l.w) > 0 AND ((l.doc_id, l.line_no) <> s.at OR t.w IS NOT NULL) AS gone FROM line AS l LEFT JOIN seen AS s ON l.w = s.w LEFT JOIN late AS t ON l.w = t.w),
kept AS (SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_removed, string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT coalesce(gone, false)) AS t FROM mark GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents AS d LEFT JOIN kept USING (doc_id)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import held_out, learn, scores

    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return scores(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, ["doc_id", "held_out"])


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.alignment import align

    return align(table(spark, sf_dir, "documents"))


#: Operator 12 holds the table against a copy whose texts are lower-cased where 5 divides the id's CRC-32.
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.manifest import manifest

    low = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(table(spark, sf_dir, "documents"), {"text": F.when(hit, low).otherwise(F.col("text"))})


def _op12_sql(deep: int = 8, groups_deep: int = 3) -> str:
    """The tree's levels one by one: `deep` of them for 16**deep rows a source, `groups_deep` for 16**groups_deep sources."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    steps = "list_transform(range(1, 8 * strlen(doc_id::VARCHAR) + 1), lambda i: CASE WHEN i % 8 = 1 THEN ascii(substr(doc_id::VARCHAR, 1 + (i - 1) // 8, 1)) ELSE 0 END)"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"
    out = [f"""d AS (SELECT doc_id, source, {leaf('text')} AS h, CASE WHEN {crc} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS now FROM documents)""",
           "t0 AS (SELECT doc_id, source AS g, h, coalesce(now, h) AS now, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM d)"]

    def level(name: str, k: int) -> None:
        out.append(f"{name}{k + 1} AS (SELECT g, i // 16 AS i, (any_value(n) + 15) // 16 AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY g, i // 16)")

    for k in range(deep):
        level("t", k)
    out.append(f"s0 AS (SELECT 0 AS g, g AS source, h, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t{deep})")
    for k in range(groups_deep):
        level("s", k)

    def path(name: str, k: int, keep: str) -> str:
        return f"""SELECT {keep} a.g, a.i, a.n, CASE WHEN a.n > 1 THEN [{{'l': coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), ''), 'r': coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '')}}] ELSE [] END AS own
  FROM {name}{k} AS a JOIN {name}{k} AS b ON a.g IS NOT DISTINCT FROM b.g AND a.i // 16 = b.i // 16 GROUP BY {keep} a.g, a.i, a.n"""

    def down(name: str, deep: int, top: str, keep: str) -> None:
        out.append(f"{name}p{deep} AS ({top})")
        for k in reversed(range(deep)):
            mine = keep if k == 0 else ""
            out.append(f"{name}o{k} AS ({path(name, k, ', '.join(f'a.{c}' for c in mine.split()) + ',' if mine else '')})")
            out.append(f"{name}p{k} AS (SELECT {', '.join(f'o.{c}' for c in mine.split()) + ',' if mine else ''} o.g, o.i, list_concat(o.own, p.path) AS path, p.root, p.subroot FROM {name}o{k} AS o JOIN {name}p{k + 1} AS p ON o.g IS NOT DISTINCT FROM p.g AND o.i // 16 = p.i)")

    down("s", groups_deep, f"SELECT g, i, []::STRUCT(l VARCHAR, r VARCHAR)[] AS path, h AS root, '' AS subroot FROM s{groups_deep}", "source h")
    down("t", deep, "SELECT source AS g, 0 AS i, path, root, h AS subroot FROM sp0", "doc_id h now")
    return "WITH " + ",\n".join(out) + """,
f AS (SELECT *, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256, list_reduce(list_concat([{'l': now, 'r': ''}], path), lambda a, x: {'l': sha256(x.l || a.l || x.r), 'r': ''}).l AS folded_root FROM tp0)
SELECT doc_id, h AS leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f"""


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import find

    return find(table(spark, sf_dir, "documents")).drop("found")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_licences, op3_language_id, op4_substring_dedup, op5_fingerprints, op6_decontamination, op7_html_extraction, op8_simhash_dedup, op9_line_dedup, op10_toxicity, op11_alignment, op12_manifest, op13_pii)}


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": OP4_SQL, "op7_html_extraction": OP7_SQL, "op9_line_dedup": OP9_SQL, "op12_manifest": _op12_sql()}
