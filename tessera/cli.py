"""Command line: list and scan a source folder, process sources into chunks.

    python -m tessera.cli list ROOT [--overrides FILE]
    python -m tessera.cli scan ROOT
    python -m tessera.cli process ROOT TEXTS OUT [--key KEY] [--force] [--overrides FILE]

TEXTS is a Parquet table (key, text) of what a reader got from PDF files; CSV and presentation
files are read here.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import build_session
from tessera.sources import registry


def known(spark: SparkSession, root: str, overrides: str | None) -> DataFrame:
    folder = registry.discover(spark, root)
    return registry.merge(folder, registry.overrides(spark, overrides)) if overrides else folder


def process(spark: SparkSession, root: str, texts: str, out: str, key: str | None = None, force: bool = False, overrides: str | None = None) -> DataFrame:
    """Write the chunks of sources without any (with force: of all) and return the report: ok, skipped or failed."""
    sources = registry.enabled(known(spark, root, overrides))
    sources = registry.get(sources, key) if key else sources
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(out)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    keys = spark.read.parquet(out).select("source_key").distinct().collect() if there else []  # a row a source
    done = spark.createDataFrame(keys, "key string")
    todo = registry.unprocessed(sources, done, force)
    chunks, report = registry.process(todo, spark.read.parquet(texts), registry.read_external(spark, todo), registry.read_presentations(spark, todo))
    report = spark.createDataFrame(report.collect(), report.schema)  # a row a source, before the chunks change what is done
    registry.write_chunks(chunks, out)
    skipped = sources.join(todo.select("key"), "key", "left_anti").select("key", F.lit("skipped").alias("status"), F.lit(0).cast("long").alias("n"))
    return report.unionByName(skipped)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("do", choices=["list", "scan", "process"])
    p.add_argument("paths", nargs="+")
    p.add_argument("--overrides")
    p.add_argument("--key")
    p.add_argument("--force", action="store_true")
    a = p.parse_args(args)
    spark = build_session()
    if a.do == "process":
        process(spark, *a.paths[:3], key=a.key, force=a.force, overrides=a.overrides).orderBy("status", "key").show(1000, False)
    elif a.do == "list":
        registry.enabled(known(spark, a.paths[0], a.overrides)).select("key", "name", "category", "type", "doc_type").show(1000, False)
    else:
        registry.counts(registry.discover(spark, a.paths[0])).show(100, False)


if __name__ == "__main__":
    main()
