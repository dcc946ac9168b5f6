"""The corpus pipeline: documents in, a weighted mix out, in five stages.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All stages but
the last return the columns of documents; each works on everything that its predecessor
kept. Nothing is sampled or cut short: what a stage leaves out is its decision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontamination, language_id, line_dedup, mixing, simhash_dedup
from tessera.session import in_steps, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents whose text is null or has no letter are in no language and go."""
    return language_id.accepted(docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: lines that stand earlier go, and documents that nothing is left of."""
    return line_dedup.deduplicate(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each group of near-duplicates the document with the smallest id stays."""
    return simhash_dedup.deduplicate_rows(docs)


def remove_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that hold a benchmark item go."""
    return decontamination.decontaminate_rows(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the documents that the mix takes, with their copies, and each source's size and target."""
    return mixing.mix(docs).where("copies > 0")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_repeated_lines),
    ("SimHash near-dedup", remove_near_duplicates),
    ("benchmark decontamination", remove_benchmark_copies),
    ("mixing sources", mix_sources),
]

#: SQL can't express the stages' models and fingerprints; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over documents; each result is written to the shared folder as Parquet and read again."""
    step = lambda stage: lambda docs: stage(spark, docs, sf_dir)
    return in_steps(table(spark, sf_dir, "documents"), [step(stage) for _, stage in STAGES])
