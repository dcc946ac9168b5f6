"""An index kept up to date by batches of added and removed chunks; what is in it is not built again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.search import postings, weigh_terms
from tessera.operators.store import committed, remove
from tessera.session import small, store

KEY = ["source_key", "chunk_no"]
_TYPES = {
    "postings": "source_key string, chunk_no long, dl int, term string, tf long, batch long",
    "gone": "source_key string, chunk_no long, batch long",
    "terms": "source_key string, term string, df long",
    "sizes": "source_key string, n_chunks long, words long",
}


class LiveIndex:
    """Five tables below a path, a folder a batch: chunks, postings, keys that left, and signed counts by source and by source and term.

    A chunk is known by (source_key, chunk_no), once in a batch; one that is added again
    replaces the chunk before it, and removing one that isn't there does nothing. Statistics
    are sums of the signed counts, so no text and no posting is read for them; a batch reads
    its own texts and, for what leaves, the postings of those keys. Batches are applied in
    order. A batch counts once its sizes, which are written last, are committed, so a broken
    run is applied again, as the last batch may be. compact() makes one base of all batches.
    """

    def __init__(self, path: str, schema: str):
        """schema: of the chunks, source_key string, chunk_no long, text string and any others but batch and dl."""
        self.path = path
        self.types = {"chunks": f"{schema}, dl int, batch long", **_TYPES}

    def _parts(self, spark: SparkSession, below: int | None = None) -> list[str]:
        """The folders, relative to a table's, of the last base and the batches after it."""
        base, delta = (sorted(committed(spark, f"{self.path}/sizes/{kind}")) for kind in ("base", "delta"))
        last = base[-1] if base else -1
        if below is not None and below <= last:
            raise ValueError(f"batch {below} is in the base of batch {last}")
        return [f"base/batch={n}" for n in base[-1:]] + [f"delta/batch={n}" for n in delta if n > last and (below is None or n < below)]

    def _table(self, spark: SparkSession, name: str, below: int | None = None) -> DataFrame:
        parts = self._parts(spark, below)
        if not parts:
            return spark.createDataFrame([], self.types[name])
        return spark.read.schema(self.types[name]).parquet(*[f"{self.path}/{name}/{p}" for p in parts])

    def _live(self, spark: SparkSession, name: str, below: int | None = None) -> DataFrame:
        """Rows whose chunk hasn't left in a later batch; in one batch what leaves goes before what comes."""
        left = self._table(spark, "gone", below).groupBy(*KEY).agg(F.max("batch").alias("left_in"))
        rows = self._table(spark, name, below).join(small(left), KEY, "left")
        return rows.where("left_in IS NULL OR batch >= left_in").drop("left_in")

    def chunks(self, spark: SparkSession) -> DataFrame:
        return self._live(spark, "chunks").drop("dl", "batch")

    def postings(self, spark: SparkSession) -> DataFrame:
        """As of search.postings()."""
        return self._live(spark, "postings").drop("batch")

    def stats(self, spark: SparkSession) -> DataFrame:
        """As of search.term_stats()."""
        size = self._sums(self._table(spark, "sizes"), "source_key").where("n_chunks > 0")
        df = self._sums(self._table(spark, "terms"), "source_key", "term").where("df > 0")
        return weigh_terms(df, size.select("source_key", "n_chunks", (F.col("words") / F.col("n_chunks")).alias("avgdl")))

    @staticmethod
    def _sums(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in by])

    def _write(self, rows: DataFrame, name: str, folder: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/{folder}")

    def apply(self, spark: SparkSession, batch: int, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """One batch: chunks added, and keys of chunks removed. Its number is higher than those before it, or the last one's, to apply that again."""
        if any(n > batch for n in committed(spark, f"{self.path}/sizes/delta")):
            raise ValueError(f"batch {batch} comes before one that is there")
        types = self.types["chunks"].removesuffix(", dl int, batch long")
        added = spark.createDataFrame([], types) if added is None else added
        folder, number = f"delta/batch={batch}", F.lit(batch).cast("long")
        before = self._live(spark, "chunks", batch).select(*KEY, "dl")
        asked = added.select(*KEY)
        asked = asked if removed is None else asked.unionByName(removed.select(*KEY))
        leaving = store(before.join(small(store(asked.distinct())), KEY, "left_semi"))
        remove(spark, f"{self.path}/sizes/{folder}")
        self._write(added.select(*spark.createDataFrame([], types).columns, F.size(T.tokens(F.coalesce("text", F.lit("")))).alias("dl"), number.alias("batch")), "chunks", folder)
        self._write(leaving.select(*KEY, number.alias("batch")), "gone", folder)
        self._write(postings(added).withColumn("batch", number).select(*[c.split()[0] for c in _TYPES["postings"].split(", ")]), "postings", folder)
        come, came = (spark.read.schema(self.types[t]).parquet(f"{self.path}/{t}/{folder}") for t in ("postings", "chunks"))
        go = self._live(spark, "postings", batch).join(small(leaving.select(*KEY)), KEY, "left_semi")
        counted = lambda df, sign: df.groupBy("source_key", "term").agg((F.count("*") * sign).alias("df"))
        self._write(self._sums(counted(come, 1).unionByName(counted(go, -1)), "source_key", "term").where("df <> 0"), "terms", folder)
        size = lambda df, sign: df.groupBy("source_key").agg((F.count("*") * sign).alias("n_chunks"), (F.sum("dl") * sign).alias("words"))
        self._write(self._sums(size(came, 1).unionByName(size(leaving, -1)), "source_key"), "sizes", folder)

    def compact(self, spark: SparkSession) -> None:
        """What is live as one base, which counts once its sizes are committed; then what it holds is removed."""
        parts = self._parts(spark)
        if not parts:
            return
        last = int(parts[-1].split("=")[1])
        if parts == [f"base/batch={last}"]:
            return
        folder, number = f"base/batch={last}", F.lit(last).cast("long")
        for name in ("chunks", "postings"):
            self._write(self._live(spark, name).withColumn("batch", number), name, folder)
        self._write(spark.createDataFrame([], self.types["gone"]), "gone", folder)
        self._write(self._sums(self._table(spark, "terms"), "source_key", "term").where("df > 0"), "terms", folder)
        self._write(self._sums(self._table(spark, "sizes"), "source_key").where("n_chunks > 0"), "sizes", folder)
        for name in ("sizes", "chunks", "postings", "gone", "terms"):  # sizes first: what has none doesn't count
            for part in parts:
                remove(spark, f"{self.path}/{name}/{part}")
