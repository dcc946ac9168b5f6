"""Rules as a table: any number of phrases, found in texts by one join on their words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.session import small

_WORDS = r"(?U)(\w+)(\W*)"


def word_runs(words: Column, pieces: Column, lengths: list[int]) -> Column:
    """The distinct runs of so many words, with what stands between them as it is. pieces: each word with what follows it.

    Each place of a run is an array moved along by as much, so the work is linear in the text."""
    moved = lambda c, k: F.slice(c, k + 1, F.size(c)) if k else c
    run = lambda n: reduce(lambda x, y: F.zip_with(x, y, lambda p, q: F.concat(p, q)), [moved(pieces, k) for k in range(n - 1)] + [moved(words, n - 1)])
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *[F.array_compact(run(n)) for n in lengths]))


def act_rules(spark: SparkSession) -> DataFrame:
    """The fixed phrases of acts as rules; a strong one settles the act."""
    rows = [(p, act, strong) for strong, rules in ((True, C.STRONG_PHRASES), (False, C.WEAK_WORDS)) for act, phrases in rules for p in phrases]
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "phrase string, label string, strong boolean, place long")


def found(texts: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, phrase, label, strong, place): the rules whose phrase stands in a text as whole words, each once a text.

    Every text gives its runs of words of the phrases' lengths, which meet the phrases in a join,
    so a text's cost doesn't depend on the number of rules. Only the distinct lengths, a few
    numbers, come to the driver. Phrases are compared in lower case and begin and end with a
    word character, others are never found; of equal rules the first place counts. Null and
    empty texts and phrases find nothing. keys name a text; other columns of both sides are
    left out, so their names don't matter.
    """
    size = F.size(F.regexp_extract_all("phrase", F.lit(_WORDS), F.lit(1)))
    rules = rules.select(F.lower("phrase").alias("phrase"), "label", "strong", "place").where("phrase IS NOT NULL").groupBy("phrase", "label", "strong").agg(F.min("place").alias("place"))
    lengths = sorted(r.n for r in rules.select(size.alias("n")).distinct().collect() if r.n)
    names = [f"key_{i}" for i in range(len(keys))]
    find = lambda group: F.regexp_extract_all(F.lower("text"), F.lit(_WORDS), F.lit(group))
    split = texts.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], find(1).alias("words"), find(0).alias("pieces"))
    runs = split.select(*names, F.explode(word_runs(F.col("words"), F.col("pieces"), lengths)).alias("phrase"))
    out = runs.join(small(rules), "phrase")
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "phrase", "label", "strong", "place")


def labels(texts: DataFrame, rules: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, label): the label of a text's first strong rule; else that with most weak ones, `least` at least, the first on ties.

    keys must be unique; texts that no rule labels are left out.
    """
    per = found(texts, rules, keys).groupBy(*keys, "label").agg(F.min(F.when(F.col("strong"), F.col("place"))).alias("first"), F.count_if(~F.col("strong")).alias("n"), F.min(F.when(~F.col("strong"), F.col("place"))).alias("weak"))
    settled = F.min(F.when(F.col("first").isNotNull(), F.struct("first", "label")))
    most = F.min(F.when(F.col("n") >= least, F.struct((-F.col("n")).alias("n"), "weak", "label")))
    return per.groupBy(*keys).agg(F.coalesce(settled["label"], most["label"]).alias("label")).where("label IS NOT NULL")
