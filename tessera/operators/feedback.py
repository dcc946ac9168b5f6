"""Feedback aggregation and learned corrections. State is tables; every step takes and returns tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import constants as C
from tessera.functions.responses import diagnose, failure_type, keyword_intent
from tessera.functions.text import normal_section, query_hash

LEAST_NEGATIVES, PATCH_SHARE, LOCK_AT, BOOST, HISTORY = 3, 0.25, 2, 0.15, 200
#: One vocabulary for classification and correction.
ACTIONS = [a for a, _ in C.TAXONOMY]


def record(feedback: DataFrame) -> DataFrame:
    """Feedback rows as they are kept: snippets of 300 characters, blanks for missing text, rating 0 if missing, form_correct as given."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return feedback.select("qa_id", "ts", text("query"), F.left(F.coalesce("response", F.lit("")), F.lit(300)).alias("response_snippet"), F.coalesce("rating", F.lit(0)).alias("rating"), text("failure_type"), text("comment"), F.coalesce("form_ids", F.array().cast("array<string>")).alias("form_ids"), "form_correct")


def summary(feedback: DataFrame) -> DataFrame:
    """One row: total, positive (4 and 5), neutral (3), negative (2 or less, missing ones too)."""
    r = F.coalesce("rating", F.lit(0))
    return feedback.agg(F.count("*").alias("total"), F.count_if(r >= 4).alias("positive"), F.count_if(r == 3).alias("neutral"), F.count_if(r <= 2).alias("negative"))


def failure_counts(feedback: DataFrame) -> DataFrame:
    """(failure_type, n) of all known types, those that never occur with 0."""
    known = feedback.sparkSession.createDataFrame([(t, i) for i, t in enumerate(C.FAILURE_TYPES)], "failure_type string, pos int")
    n = feedback.groupBy("failure_type").agg(F.count("*").alias("n"))
    return F.broadcast(known).join(n, "failure_type", "left").select("failure_type", F.coalesce("n", F.lit(0)).alias("n"))


def active_patches(feedback: DataFrame) -> DataFrame:
    """(failure_type, share): types that make up PATCH_SHARE or more of the negatives, of which there must be LEAST_NEGATIVES."""
    negative = summary(feedback).select("negative")
    share = F.try_divide(F.col("n"), F.col("negative"))
    return failure_counts(feedback).join(F.broadcast(negative)).where((F.col("negative") >= LEAST_NEGATIVES) & F.col("failure_type").isin(C.PATCHED_TYPES)).select("failure_type", share.alias("share")).where(F.col("share") >= PATCH_SHARE)


def failure_rates(failures: DataFrame) -> DataFrame:
    """(type, n) over the issues of all records."""
    return failures.select(F.explode("auto_issues").alias("i")).groupBy("i.type").agg(F.count("*").alias("n"))


def recent(failures: DataFrame, n: int = 5) -> DataFrame:
    return failures.orderBy(F.desc("ts"), F.desc("query_hash")).limit(n)


def bounded(rows: DataFrame, by: list[str], newest: list, n: int) -> DataFrame:
    """The newest n rows a key."""
    return rows.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(*newest))).where(F.col("__at") <= n).drop("__at")


def evicted(rows: DataFrame, by: list[str], newest: list, n: int) -> DataFrame:
    """What bounded() leaves out."""
    return rows.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy(*newest))).where(F.col("__at") > n).drop("__at")


def write_back(feedback: DataFrame, found: DataFrame) -> DataFrame:
    """feedback with found (qa_id, failure_type) where it has none, in a qa_id's first row."""
    first = F.row_number().over(Window.partitionBy("qa_id").orderBy("ts")) == 1
    f = found.groupBy("qa_id").agg(F.min("failure_type").alias("found"))
    df = feedback.withColumn("first", first).join(f, "qa_id", "left")
    empty = F.col("first") & (F.coalesce("failure_type", F.lit("")) == "")
    return df.withColumns({"auto_diagnosed": empty & F.col("found").isNotNull(), "failure_type": F.when(empty, F.coalesce("found", "failure_type")).otherwise(F.col("failure_type"))}).drop("first", "found")


# ---- learned corrections ----


def upsert(state: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """The latest row a key of both, new rows winning ties."""
    both = state.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc(order), F.desc("__new"))
    return both.withColumn("__at", F.row_number().over(w)).where("__at = 1").drop("__at", "__new")


def insert_absent(state: DataFrame, new: DataFrame, key: list[str], order: list) -> DataFrame:
    """state, and the first new row of each key that it lacks."""
    first = new.withColumn("__at", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__at = 1").drop("__at")
    return state.unionByName(first.join(state.select(*key), key, "left_anti").select(*state.columns))


def reinforce(overrides: DataFrame, corrections: DataFrame, positives: DataFrame) -> DataFrame:
    """overrides with confirmations added: positives (query_hash) count for the action stored for their query; locked from LOCK_AT on."""
    n = positives.join(corrections, "query_hash").groupBy("action").agg(F.count("*").alias("n"))
    df = overrides.join(n, F.col("intent_action") == F.col("action"), "left").drop("action")
    total = F.col("confirmed_positive") + F.coalesce("n", F.lit(0))
    return df.withColumns({"confirmed_positive": total, "locked": F.col("locked") | (F.col("n").isNotNull() & (total >= LOCK_AT))}).drop("n")


def count_negatives(overrides: DataFrame, shown: DataFrame) -> DataFrame:
    """overrides with confirmed_negative raised for each time that their form was shown and rated wrong. shown: (form_id)."""
    n = shown.where("form_id <> ''").groupBy("form_id").agg(F.count("*").alias("n"))
    return overrides.join(n, "form_id", "left").withColumn("confirmed_negative", F.col("confirmed_negative") + F.coalesce("n", F.lit(0))).drop("n").select(*overrides.columns)


def correct_mapping(overrides: DataFrame, corrections: DataFrame, patches: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after failures (query, suggested_intent, form_id, ts): a flagged override and a patch an action once, the latest action a query."""
    f = failures.where(F.col("suggested_intent").isin(ACTIONS)).withColumn("query_hash", query_hash(F.col("query")))
    flagged = f.select(F.col("suggested_intent").alias("intent_action"), F.coalesce("form_id", F.lit("")).alias("form_id"), F.concat(F.lit("[flagged: "), "suggested_intent", F.lit("]")).alias("form_name"), F.lit(0.5).alias("confidence"), F.lit(False).alias("locked"), F.lit(0).cast("long").alias("confirmed_positive"), F.lit(0).cast("long").alias("confirmed_negative"), "ts")
    fixed = f.select("query_hash", F.col("suggested_intent").alias("action"), "ts")
    hint = F.left(F.regexp_replace(F.lower(F.trim("query")), r"\s+", " "), F.lit(80))
    text = F.concat(F.lit('CORRECTION (from user feedback): Queries like "'), hint, F.lit('" should map to "'), "suggested_intent", F.lit('". Read the direction (to/from public/private) very carefully.'))
    notes = f.select(F.concat(F.lit("intent_correction_"), "suggested_intent").alias("key"), F.lit("intent_direction_correction").alias("type"), F.col("suggested_intent").alias("correct_intent"), hint.alias("example_query"), text.alias("patch_text"), "ts")
    return insert_absent(overrides, flagged, ["intent_action"], ["ts"]), upsert(corrections, fixed, ["query_hash"], "ts"), insert_absent(patches, notes, ["key"], ["ts"])


def correct_retrieval(boosts: DataFrame, failures: DataFrame) -> DataFrame:
    """boosts with BOOST for each suggested section that a query has none for. failures: (query, suggested_sections, ts)."""
    f = failures.withColumn("section", F.explode("suggested_sections"))
    f = f.select(query_hash(F.col("query")).alias("query_hash"), normal_section(F.col("section")).alias("section_parent"), F.concat(F.lit("suggested by self-reflection: "), F.left(F.col("query"), F.lit(60))).alias("reason"), "ts").where("section_parent <> ''")
    new = f.withColumns({"delta": F.lit(BOOST), "section_child": F.lit(None).cast("string")})
    return insert_absent(boosts, new, ["query_hash", "section_parent"], ["ts"])


def section_boost(asked: DataFrame, boosts: DataFrame) -> DataFrame:
    """asked (query_hash, section_parent) with its delta, 0 by default."""
    b = boosts.groupBy("query_hash", "section_parent").agg(F.min_by("delta", "ts").alias("delta"))
    return asked.join(b, ["query_hash", "section_parent"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0)))


def negative_pipeline(turns: DataFrame, reflections: DataFrame | None = None) -> DataFrame:
    """(qa_id, query_hash, issues, root_agent, suggested_intent, failure_type) of negatively rated turns.

    turns: (qa_id, query, response, shown). An issue of confidence .90 decides without a model
    unless it is a form's; otherwise reflections (qa_id, root_agent, suggested_intent), a
    model's answers, do, by default `unknown`. A keyword's action stands in where none is
    suggested, and then the forms are at fault.
    """
    df = turns.withColumn("issues", diagnose(F.col("query"), F.col("response"), F.col("shown"))).withColumn("query_hash", query_hash(F.col("query")))
    top = F.array_max(F.transform("issues", lambda i, n: F.struct(i["confidence"].alias("c"), (-n).alias("n"), i["agent"].alias("a"))))
    fast = (top["c"] >= 0.90) & (top["a"] != "form_mapping")
    r = reflections if reflections is not None else turns.select("qa_id", F.lit("unknown").alias("root_agent"), F.lit("").alias("suggested_intent"))
    df = df.join(r, "qa_id", "left").withColumns({"root_agent": F.when(fast, top["a"]).otherwise(F.coalesce("root_agent", F.lit("unknown"))), "suggested_intent": F.coalesce("suggested_intent", F.lit(""))})
    kind = failure_type(F.col("issues"), F.col("root_agent"))
    guess = keyword_intent(F.col("query"))
    stands_in = (F.col("suggested_intent") == "") & (guess != "")
    return df.withColumn("failure_type", kind).select("qa_id", "query_hash", "issues", F.when(stands_in, "form_mapping").otherwise(F.col("root_agent")).alias("root_agent"), F.when(stands_in, guess).otherwise(F.col("suggested_intent")).alias("suggested_intent"), "failure_type")


def correction_route(agent: Column) -> Column:
    """Which correction an agent's failure calls for."""
    return F.when(agent == "form_mapping", "mapping").when(agent == "retrieval", "retrieval").when(agent == "generation", "prompt").otherwise("none")


def stats(failures: DataFrame, latest: int = 5) -> DataFrame:
    """One row: total, without_issue, counts (type, n and share of all failures, by type) and the latest failures, newest first.

    failures: (query_hash, query, root_agent, auto_issues, ts).
    """
    each = failure_rates(failures).agg(F.array_sort(F.collect_list(F.struct("type", "n"))).alias("counts"))
    last = recent(failures, latest).select(F.struct("ts", "query_hash", F.left("query", F.lit(80)).alias("query"), "root_agent", F.transform("auto_issues", lambda i: i["type"]).alias("issues")).alias("r"))
    last = last.agg(F.transform(F.sort_array(F.collect_list("r"), False), lambda r: F.struct(r["query"].alias("query"), r["root_agent"].alias("root_agent"), r["issues"].alias("issues"), r["ts"].alias("ts"))).alias("recent"))
    total = failures.agg(F.count("*").alias("total"), F.count_if(F.size("auto_issues") == 0).alias("without_issue"))
    share = F.transform("counts", lambda c: F.struct(c["type"].alias("type"), c["n"].alias("n"), F.try_divide(c["n"], F.col("total")).alias("share")))
    return total.join(F.broadcast(each)).join(F.broadcast(last)).select("total", "without_issue", share.alias("counts"), "recent")  # a row each
