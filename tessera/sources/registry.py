"""Source discovery, overrides and views; chunk tables in and out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import constants as C
from tessera.functions import text as T
from tessera.functions.models import TextModel, VisionModel
from tessera.operators.chunking import CHUNK_COLUMNS, LEAST, parse, parse_slides
from tessera.operators.generation import chunks_of_images
from tessera.sources.extract import read_slides

SOURCE_SCHEMA = "key string, name string, category string, type string, doc_type string, enabled boolean, relates_to_acts array<string>, url string, local_path string"


def from_paths(paths: DataFrame) -> DataFrame:
    """Sources of (path) rows `.../category/doc_type/file` with known names and extensions; of equal keys the first by path."""
    part = lambda i: F.element_at(F.split("path", "/"), i)
    df = paths.select("path", part(-3).alias("category"), part(-2).alias("doc_type"), part(-1).alias("file"))
    ext = F.lower(F.regexp_extract("file", r"\.([^.]*)$", 1))
    df = df.where(F.col("category").isin(C.CATEGORIES) & F.col("doc_type").isin(C.DOC_TYPES) & ext.isin(C.EXTENSIONS))
    df = df.select(T.source_key(F.col("file")).alias("key"), F.regexp_replace("file", r"\.[^.]*$", "").alias("name"), "category", T.source_type(F.col("file")).alias("type"), "doc_type", F.lit(True).alias("enabled"), F.array().cast("array<string>").alias("relates_to_acts"), F.lit(None).cast("string").alias("url"), F.col("path").alias("local_path"))
    order = [F.when(F.col("category") == c, i) for i, c in enumerate(C.CATEGORIES)]
    w = Window.partitionBy("key").orderBy(F.coalesce(*order), "doc_type", "local_path")
    return df.withColumn("__at", F.row_number().over(w)).where("__at = 1").drop("__at")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Sources of the files below root; only their paths are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return from_paths(files.select("path"))


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON file {"sources": [...]}, without notes and comments, defaults filled in."""
    entry = "struct<key:string,name:string,category:string,type:string,doc_type:string,enabled:boolean,relates_to_acts:array<string>,url:string,local_path:string,_note:string,_comment:string>"
    raw = spark.read.schema(f"sources array<{entry}>").json(path, multiLine=True).select(F.explode("sources").alias("s")).select("s.*")
    return override_defaults(raw)


def override_defaults(raw: DataFrame) -> DataFrame:
    df = raw.where("_note IS NULL AND _comment IS NULL AND key IS NOT NULL") if "_note" in raw.columns else raw
    some = lambda c, d: F.coalesce(c, F.lit(d)).alias(c)
    return df.select("key", F.coalesce("name", "key").alias("name"), some("category", ""), F.when(F.col("type").isin(C.SOURCE_TYPES), F.col("type")).otherwise("pdf").alias("type"), some("doc_type", "act"), some("enabled", True), F.coalesce("relates_to_acts", F.array().cast("array<string>")).alias("relates_to_acts"), "url", "local_path")


def merge(folder: DataFrame, json: DataFrame) -> DataFrame:
    """Folder sources and overrides, by key, disabled ones included.

    An override's name counts if it isn't the key, category and acts if not empty, type,
    doc_type and enabled always, url and local_path if there.
    """
    f, j = folder.alias("f"), json.alias("j")
    new = F.col("j.key").isNotNull()
    some = lambda c: F.coalesce(F.nullif(F.col(f"j.{c}"), F.lit("")), F.col(f"f.{c}")).alias(c)
    always = lambda c: F.when(new, F.col(f"j.{c}")).otherwise(F.col(f"f.{c}")).alias(c)
    name = F.when(F.col("j.name") != F.col("j.key"), F.col("j.name")).otherwise(F.coalesce("f.name", "j.name")).alias("name")
    acts = F.when(F.size("j.relates_to_acts") > 0, F.col("j.relates_to_acts")).otherwise(F.coalesce("f.relates_to_acts", "j.relates_to_acts")).alias("relates_to_acts")
    return f.join(j, F.col("f.key") == F.col("j.key"), "full_outer").select(F.coalesce("f.key", "j.key").alias("key"), name, F.coalesce(some("category"), F.lit("")).alias("category"), always("type"), always("doc_type"), always("enabled"), acts, some("url"), some("local_path"))


def enabled(sources: DataFrame) -> DataFrame:
    return sources.where("enabled").orderBy("category", "name")


def by_category(sources: DataFrame) -> DataFrame:
    """(category, names) of enabled sources, in order of their names; known categories without any have an empty array."""
    known = sources.sparkSession.createDataFrame([(c,) for c in C.CATEGORIES], "category string")
    names = sources.where("enabled").groupBy("category").agg(F.array_sort(F.collect_list("name")).alias("names"))
    return known.join(names, "category", "full_outer").select("category", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def get(sources: DataFrame, key: str) -> DataFrame:
    return sources.where(F.col("key") == key)


def counts(sources: DataFrame) -> DataFrame:
    """(category, n) of enabled sources, categories without any included."""
    known = sources.sparkSession.createDataFrame([(c,) for c in C.CATEGORIES], "category string")
    n = sources.where("enabled").groupBy("category").agg(F.count("*").alias("n"))
    return known.join(n, "category", "full_outer").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def unprocessed(sources: DataFrame, processed: DataFrame, force: bool = False) -> DataFrame:
    """Enabled sources without chunks; with force all of them."""
    s = sources.where("enabled")
    return s if force else s.join(processed.select("key").distinct(), "key", "left_anti")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Processed chunk files: quoted, multi-line, missing values as empty text, in file order."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema=", ".join(f"{c} string" for c in CHUNK_COLUMNS))
    w = Window.partitionBy("source_key").orderBy("__at")
    df = df.withColumn("__at", F.monotonically_increasing_id())  # one task reads a multi-line file, in order
    return df.withColumn("chunk_no", F.row_number().over(w).cast("long")).drop("__at").fillna("", CHUNK_COLUMNS)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Parquet by source; a job's files appear together or not at all, and only its own sources are replaced."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_key").parquet(path)


def write_chunks_csv(chunks: DataFrame, path: str) -> None:
    chunks.select(*CHUNK_COLUMNS).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', quoteAll=True)


def _column(df: DataFrame, names: list[str]) -> Column:
    """The first of the columns that a table has, by exact name, else empty."""
    have = [c for c in names if c in df.columns]
    return reduce(lambda a, c: F.coalesce(a, F.col(f"`{c}`")), have[1:], F.col(f"`{have[0]}`")) if have else F.lit("")


def external_chunks(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of a foreign table as chunks: its content, text or body column, rows of LEAST characters or more."""
    found = next((c for c in df.columns if c.lower() in ("content", "text", "body")), None)
    if found is None:
        raise ValueError("no content, text or body column")
    content = T.strip(F.coalesce(F.col(f"`{found}`").cast("string"), F.lit("")))
    get_ = lambda *names: F.coalesce(_column(df, list(names)).cast("string"), F.lit(""))
    out = df.select(F.lit(key).alias("source_key"), F.lit(name).alias("source_name"), get_("part", "Part").alias("part"), get_("division", "Division").alias("division"), get_("subdivision", "Subdivision").alias("subdivision"), get_("section", "Section").alias("section"), get_("Subsection", "Section_Title", "section_title", "Title").alias("section_title"), content.alias("content"))
    return out.where(F.length("content") >= LEAST)


def read_external(spark: SparkSession, sources: DataFrame) -> DataFrame | None:
    """The rows of CSV sources' files as chunks, with row_no in file order; files without a content column have none. One read a file."""
    out = None
    for r in sources.where("type = 'csv' AND local_path IS NOT NULL").collect():  # a row a source
        df = spark.read.csv(r.local_path, header=True, multiLine=True, quote='"', escape='"')
        if any(c.lower() in ("content", "text", "body") for c in df.columns):
            part = external_chunks(df, r.key, r.name).withColumn("row_no", F.monotonically_increasing_id())
            out = part if out is None else out.unionByName(part)
    return out


def read_presentations(spark: SparkSession, sources: DataFrame) -> DataFrame | None:
    """The slides of presentation sources' files."""
    files = sources.where("type = 'pptx' AND local_path IS NOT NULL").select("key", "local_path")
    paths = [r.local_path for r in files.collect()]  # a row a source
    if not paths:
        return None
    read = spark.read.format("binaryFile").load(paths)
    name = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return read_slides(read.join(files, name(F.col("path")) == name(F.col("local_path"))).select("key", "content"))


def route(sources: DataFrame) -> DataFrame:
    """sources with `route`: how each is read, csv, image, slides or the parser of a PDF's doc_type; null where type or doc_type is unknown."""
    pdf = F.when(F.col("doc_type").isin(C.DOC_TYPES), F.when(F.col("doc_type") == "slide", "others").otherwise(F.col("doc_type")))
    by_type = F.when(F.col("type") == "csv", "csv").when(F.col("type") == "image", "image").when(F.col("type") == "pptx", "slides").when(F.col("type") == "pdf", pdf)
    return sources.withColumn("route", by_type)


def process(sources: DataFrame, texts: DataFrame, rows: DataFrame | None = None, slides: DataFrame | None = None, images: DataFrame | None = None, vision: VisionModel | None = None, model: TextModel | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, report): sources through the reader of their route. report: (key, status, n), ok or failed.

    texts: (key, text) of PDFs; rows: chunk columns of CSV sources, as of external_chunks();
    slides: (key, slide_number, title, body, tables, notes); images: (key, mime, content), read
    by vision and cut by model. A source without input, of an unknown kind or without a chunk has failed.
    """
    known = route(sources if "type" in sources.columns else sources.withColumn("type", F.lit("pdf"))).where("route IS NOT NULL").select("key", "name", "route")
    named = lambda kind: known.where(F.col("route") == kind).select("key", F.col("name").alias("source_name"))
    pdfs = known.where(~F.col("route").isin("csv", "image", "slides")).join(texts, "key")
    chunks = parse(pdfs.select(F.col("key").alias("source_key"), F.col("name").alias("source_name"), F.col("route").alias("doc_type"), "text"))
    if rows is not None:
        w = Window.partitionBy("source_key").orderBy("row_no")
        mine = rows.join(named("csv").select(F.col("key").alias("source_key")), "source_key", "left_semi")
        chunks = chunks.unionByName(mine.withColumn("chunk_no", F.row_number().over(w).cast("long")).select(*CHUNK_COLUMNS, "chunk_no"))
    if slides is not None:
        chunks = chunks.unionByName(parse_slides(slides.join(named("slides"), "key").withColumnRenamed("key", "source_key")))
    if images is not None and vision is not None and model is not None:
        chunks = chunks.unionByName(chunks_of_images(images.join(named("image"), "key").withColumnRenamed("key", "source_key"), vision, model))
    n = chunks.groupBy("source_key").agg(F.count("*").alias("n"))
    report = sources.join(n, sources["key"] == n["source_key"], "left").select("key", F.when(F.col("n") > 0, "ok").otherwise("failed").alias("status"), F.coalesce("n", F.lit(0)).alias("n"))
    return chunks, report


def report_lists(report: DataFrame) -> DataFrame:
    """(status, keys) of a report."""
    return report.groupBy("status").agg(F.array_sort(F.collect_list("key")).alias("keys"))
