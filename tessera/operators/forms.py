"""Form matching: by intent and by the sections that retrieved chunks mention."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import constants as C
from tessera.functions.responses import primary_url
from tessera.functions.text import normal_section, query_hash

CLBG = r"(?i)clbg|company limited by guarantee|checklist for clbg"
MOST_FORMS = 3


def taxonomy(spark) -> DataFrame:
    """(action, pos, section): the fixed table, primary section at pos 0."""
    return spark.createDataFrame([(a, i, s) for a, sections in C.TAXONOMY for i, s in enumerate(sections)], "action string, pos int, section string")


def taxonomy_text() -> str:
    return "\n".join(f"  {a} (sections: {', '.join(s)})" for a, s in C.TAXONOMY)


def index_forms(forms: DataFrame) -> DataFrame:
    """forms with form_no (its place), sections (normal references), acts and clbg_only."""
    refs = F.coalesce("related_sections", F.array().cast("array<string>"))
    found = r"(?i)(?:section|seksyen|s\.?)\s*(\d+[a-z]?)(?:\((\w+)\))?"
    one = lambda r: F.struct(F.lower(F.regexp_extract(r, found, 1)).alias("p"), F.lower(F.regexp_extract(r, found, 2)).alias("c"))
    parsed = F.filter(F.transform(refs, one), lambda x: x["p"] != "")
    sections = F.transform(parsed, lambda x: F.concat(x["p"], F.when(x["c"] != "", F.concat(F.lit("("), x["c"], F.lit(")"))).otherwise("")))
    named = F.array_compact(F.array(*[F.when(F.contains(F.lower(F.array_join(refs, "\n")), F.lit(k)), F.lit(a)) for k, a in C.ACT_NAMES]))
    acts = F.when(F.size(named) > 0, F.array_distinct(named)).otherwise(F.array(F.lit(C.COMPANIES)))
    clbg = F.exists(refs, lambda r: r.rlike(CLBG)) | F.col("name").rlike(CLBG)
    return forms.withColumns({"sections": sections, "acts": acts, "clbg_only": clbg})


def _unless_empty(df: DataFrame, by: str, fits: Column) -> DataFrame:
    """The rows that fit, or all rows of a group in which none does."""
    df = df.withColumn("fits", fits).withColumn("some", F.max("fits").over(Window.partitionBy(by)))
    return df.where(F.col("fits") | ~F.col("some")).drop("fits", "some")


def _best(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "form_no"))).where(F.col("rank") <= MOST_FORMS)


def forms_for_intents(intents: DataFrame, forms: DataFrame) -> DataFrame:
    """(query_id, rank, form_id, name, score): 3 points for the action's primary section, 1 for others.

    intents: (query_id, action, reasoning, legal_procedure, act). Forms of other acts, and those
    for companies by guarantee only, go unless nothing else is left.
    """
    f = index_forms(forms)
    t = F.broadcast(taxonomy(forms.sparkSession))  # a fixed table
    asked = intents.join(t, "action").withColumn("sec", normal_section(F.col("section")))
    offered = f.select("form_no", F.explode("sections").alias("s")).withColumn("sec", normal_section(F.col("s")))
    score = asked.join(offered, "sec").groupBy("query_id", "form_no").agg(F.sum(F.when(F.col("pos") == 0, 3).otherwise(1)).alias("score"))
    about = F.lower(F.concat_ws(" ", F.coalesce("reasoning", F.lit("")), F.coalesce("legal_procedure", F.lit(""))))
    q = intents.select("query_id", "act", about.rlike("clbg|company limited by guarantee|guarantee company").alias("clbg_query"))
    df = score.join(f.select("form_no", "form_id", "name", "acts", "clbg_only"), "form_no").join(q, "query_id")
    df = _unless_empty(df, "query_id", F.col("act").isNull() | F.array_contains("acts", F.col("act")))
    df = _unless_empty(df, "query_id", F.col("clbg_query") | ~F.col("clbg_only"))
    return _best(df, "query_id").select("query_id", "rank", "form_id", "name", "score")


def forms_for_sections(freq: DataFrame, forms: DataFrame, least: float = 0.30, dominance: float = 0.60) -> DataFrame:
    """(query_id, rank, form_id, name, score): shares of section mentions, gated by size and dominance.

    freq: (query_id, parent, child, chunks).
    """
    w = Window.partitionBy("query_id")
    ref = F.concat("parent", F.when(F.col("child").isNotNull(), F.concat(F.lit("("), "child", F.lit(")"))).otherwise(""))
    q = freq.withColumns({"sec": normal_section(ref), "total": F.sum("chunks").over(w), "most": F.max("chunks").over(w)})
    offered = index_forms(forms).select("form_no", "form_id", "name", F.explode("sections").alias("s")).withColumn("sec", normal_section(F.col("s")))
    df = q.join(offered, "sec").groupBy("query_id", "form_no", "form_id", "name", "most").agg(F.sum(F.col("chunks") / F.col("total")).alias("score"), F.max("chunks").alias("best"))
    df = df.where((F.col("score") >= least) & (F.col("best") >= F.col("most") * dominance))
    return _best(df, "query_id").select("query_id", "rank", "form_id", "name", "score")


def output_forms(forms: DataFrame) -> DataFrame:
    """name, form_number, url, link_type, resource_type: the first pdf, portal or platform link."""
    link = F.get(F.filter("links", lambda x: x["type"].isin("pdf", "portal", "platform")), F.lit(0))
    return forms.select("form_id", "name", F.coalesce("form_number", F.lit("")).alias("form_number"), F.coalesce(link["url"], F.lit("")).alias("url"), F.coalesce(link["type"], F.lit("pdf")).alias("link_type"), F.coalesce("resource_type", F.lit("form")).alias("resource_type"))


def with_urls(forms: DataFrame) -> DataFrame:
    return forms.withColumn("url", primary_url(F.col("links")))


def resolve(queries: DataFrame, intents: DataFrame, freq: DataFrame, forms: DataFrame, overrides: DataFrame, corrections: DataFrame) -> DataFrame:
    """(query_id, path, rank, form_id, name, score) by the first of: locked override, intent, sections; path none without forms.

    queries: (query_id, text); intents: classified, as parsed; overrides: (intent_action,
    form_id, form_name, confidence, locked); corrections: (query_hash, action), which replace
    the classified action. Actions count if actionable, unambiguous and of confidence .55.
    """
    q = queries.withColumn("query_hash", query_hash(F.col("text"))).join(corrections.select("query_hash", F.col("action").alias("fixed")), "query_hash", "left").join(intents, "query_id", "left")
    sure = F.col("fixed").isNotNull() | (F.col("is_actionable") & ~F.col("ambiguous") & (F.col("confidence") >= 0.55))
    q = q.withColumns({"sure": F.coalesce(sure, F.lit(False)), "action": F.coalesce("fixed", "action")})
    locked = q.join(overrides.where("locked AND form_id <> ''"), F.col("action") == F.col("intent_action")).select("query_id", F.lit(0).alias("order"), F.lit("locked_override").alias("path"), F.lit(1).alias("rank"), "form_id", F.col("form_name").alias("name"), overrides["confidence"].cast("double").alias("score"))
    by_intent = forms_for_intents(q.where("sure AND action <> 'unknown'").select("query_id", "action", "reasoning", "legal_procedure", F.col("act") if "act" in q.columns else F.lit(None).cast("string").alias("act")), forms)
    by_section = forms_for_sections(freq, forms)
    tagged = lambda df, n, p: df.select("query_id", F.lit(n).alias("order"), F.lit(p).alias("path"), "rank", "form_id", "name", F.col("score").cast("double").alias("score"))
    every = locked.unionByName(tagged(by_intent, 1, "agent")).unionByName(tagged(by_section, 2, "section_match"))
    first = every.withColumn("least", F.min("order").over(Window.partitionBy("query_id"))).where("order = least").drop("order", "least")
    return queries.select("query_id").join(first, "query_id", "left").withColumn("path", F.coalesce("path", F.lit("none")))


def classifier_patches(patches: DataFrame) -> DataFrame:
    """One text of all intent corrections, a bullet each, in key order."""
    kept = patches.where(F.col("type") == "intent_direction_correction")
    return kept.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "patch_text"))), lambda x: F.concat(F.lit("- "), x["patch_text"])), "\n").alias("block"))


# ---- resolved forms that are kept, and queries that were rated down ----

#: Resolutions that are kept; the oldest go first.
KEPT = 200


def cache_key(query: Column, lang: Column, user: Column) -> Column:
    """One key for keeping, invalidating and clearing: the user, a query's first 100 characters, the language."""
    some = lambda c: F.coalesce(c, F.lit(""))
    return F.md5(F.concat(some(user), F.lit(":"), F.left(some(query), F.lit(100)), F.lit("_"), some(lang)).cast("binary"))


def _keys(queries: DataFrame) -> DataFrame:
    return queries.select(cache_key(F.col("text"), F.col("lang"), F.col("user")).alias("cache_key")).distinct()


def invalidate(kept: DataFrame, negatives: DataFrame, down: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, negatives) after queries (text, lang, user) were rated down: their resolutions go, their keys are flagged once."""
    keys = _keys(down)
    return kept.join(keys, "cache_key", "left_anti").select(*kept.columns), negatives.select("cache_key").unionByName(keys).distinct()


def clear_negative(negatives: DataFrame, up: DataFrame) -> DataFrame:
    """negatives without the keys of queries (text, lang, user) that were rated up."""
    return negatives.join(_keys(up), "cache_key", "left_anti")


def remember(kept: DataFrame, new: DataFrame, most: int = KEPT) -> DataFrame:
    """kept (cache_key, path, form_id, seq) with new rows, which replace those of their key in its place; of more than `most` the oldest go."""
    old = kept.join(new.select("cache_key", F.col("path").alias("p"), F.col("form_id").alias("f")), "cache_key", "left")
    old = old.select("cache_key", F.coalesce("p", "path").alias("path"), F.when(F.col("p").isNotNull(), F.col("f")).otherwise(F.col("form_id")).alias("form_id"), "seq")
    every = old.unionByName(new.join(kept, "cache_key", "left_anti").select(*old.columns))
    return every.orderBy(F.desc("seq"), "cache_key").limit(most)


def resolve_kept(queries: DataFrame, kept: DataFrame, negatives: DataFrame, intents: DataFrame, freq: DataFrame, forms: DataFrame, overrides: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, negatives): first forms as of resolve(), kept ones first, of queries (query_id, text, lang, user, seq).

    A kept resolution counts unless its key is flagged; a stored correction counts only where
    it is, and clears the flag when it leads to forms. resolved: (query_id, cache_key, seq,
    was_kept, path, form_id).
    """
    q = queries.withColumn("cache_key", cache_key(F.col("text"), F.col("lang"), F.col("user")))
    flagged = q.join(negatives, "cache_key", "left_semi")
    hits = q.join(negatives, "cache_key", "left_anti").join(kept.select("cache_key", "path", "form_id"), "cache_key")
    todo = q.join(hits.select("query_id"), "query_id", "left_anti")
    fixable = flagged.select(query_hash(F.col("text")).alias("query_hash")).distinct()
    fixes = corrections.join(fixable, "query_hash", "left_semi")
    new = resolve(todo.select("query_id", "text"), intents, freq, forms, overrides, fixes).where("rank IS NULL OR rank = 1").select("query_id", "path", "form_id")
    out = hits.withColumn("was_kept", F.lit(True)).unionByName(todo.join(new, "query_id").withColumn("was_kept", F.lit(False)))
    cured = flagged.withColumn("query_hash", query_hash(F.col("text"))).join(fixes, "query_hash", "left_semi").join(new.where("path = 'agent'"), "query_id", "left_semi")
    return out.select("query_id", "cache_key", "seq", "was_kept", "path", "form_id"), negatives.join(cured.select("cache_key"), "cache_key", "left_anti")
