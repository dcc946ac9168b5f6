"""Sessions and messages as tables: lists, idempotent appends, deletes, versioned state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def title(query: Column) -> Column:
    """A session's title: its first question, 52 characters of it."""
    q = F.coalesce(query, F.lit(""))
    return F.when(F.length(q) > 52, F.concat(F.left(q, F.lit(52)), F.lit("…"))).when(q == "", "New Chat").otherwise(q)


def list_sessions(sessions: DataFrame, user: str) -> DataFrame:
    return sessions.where(F.col("user_id") == user).orderBy(F.desc("updated_at"), "id")


def load_session(messages: DataFrame, user: str, session: str) -> DataFrame:
    return messages.where((F.col("user_id") == user) & (F.col("session_id") == session)).orderBy("created_at", "qa_id")


def append_messages(messages: DataFrame, new: DataFrame) -> DataFrame:
    """messages, and the new rows whose (qa_id, session_id) is not there yet; rows without qa_id always go in."""
    named = new.where(F.coalesce("qa_id", F.lit("")) != "")
    w = Window.partitionBy("qa_id", "session_id").orderBy(F.desc("created_at"))
    once = named.withColumn("__at", F.row_number().over(w)).where("__at = 1").drop("__at")
    fresh = once.join(messages.select("qa_id", "session_id"), ["qa_id", "session_id"], "left_anti").select(*messages.columns)
    return messages.unionByName(fresh).unionByName(new.where(F.coalesce("qa_id", F.lit("")) == "").select(*messages.columns))


def touch_sessions(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """sessions with the title of their first message and the time of their last."""
    m = messages.groupBy("session_id").agg(F.min_by("query", "created_at").alias("first"), F.max("created_at").alias("last"))
    df = sessions.join(m, sessions["id"] == m["session_id"], "left")
    return df.select("id", "user_id", F.when(F.col("session_id").isNotNull(), title(F.col("first"))).otherwise(F.col("title")).alias("title"), F.greatest("updated_at", "last").alias("updated_at"))


def delete_session(sessions: DataFrame, messages: DataFrame, user: str, session: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the session, if it is the user's."""
    mine = sessions.where((F.col("id") == session) & (F.col("user_id") == user)).select("id")
    return sessions.join(mine, "id", "left_anti").select(*sessions.columns), messages.join(mine, messages["session_id"] == mine["id"], "left_anti")


def save_state(df: DataFrame, path: str, version: int) -> None:
    """A whole table as one version; readers see a version only when its job has committed."""
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The latest version, or an empty table where there is none."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return spark.createDataFrame([], schema)
    done = [s.getPath() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(max(done, key=lambda p: int(p.getName().split("=")[1])).toString())


def committed(spark: SparkSession, folder: str) -> dict[int, str]:
    """The folders name=number in a folder whose job has committed, by number."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    return {int(p.getName().split("=")[1]): p.toString() for p in found if fs.exists(path(p, "_SUCCESS"))}


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def save_bucketed(df: DataFrame, name: str, path: str, key: list[str], buckets: int) -> DataFrame:
    """df as a table of one sorted file a bucket, under a name; a join on the key moves the other side only.

    Worth it for tables that are probed again and again, with at least as many buckets as
    shuffles have partitions. Rows of one key lie in one bucket, so keys are (nearly) unique.
    """
    df.repartition(buckets, *key).write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, name: str, path: str, schema: str, key: list[str], buckets: int) -> DataFrame:
    """A table that save_bucketed() wrote, named again in a session that doesn't know it."""
    by = ", ".join(f"`{c}`" for c in key)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


class UpsertTable:
    """A keyed table that batches are put into: a folder of rows a batch, read as the latest value a key and column.

    put() of a batch that is there replaces it, so a batch may be run again. compact() writes
    what is read as one base and removes the batches that are in it; a reader takes the latest
    base that is committed and the batches after it. Rows of a key meet in a grouped maximum,
    which is summed up where they are read first, so a key with many rows is no hot one.
    """

    def __init__(self, path: str, key: list[str]):
        self.path, self.key = path, key

    @staticmethod
    def merged(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
        """A row a key with the latest value, that isn't null, of each other column."""
        others = [c for c in rows.columns if c not in key]
        keyed = rows.withColumn("__order", order)
        some = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__order"))).alias(c)
        return keyed.groupBy(*key).agg(*[some(c) for c in others]).select(*rows.columns)

    def put(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/delta/batch={batch}")

    def _versions(self, spark: SparkSession, kind: str) -> dict[int, str]:
        return committed(spark, f"{self.path}/{kind}")

    def read(self, spark: SparkSession, schema: str, below: int | None = None) -> DataFrame:
        """The table as of all batches, or of those with a lower number than `below`, which must not be compacted."""
        base, delta = self._versions(spark, "base"), self._versions(spark, "delta")
        last = max(base, default=-1)
        if below is not None and below <= last:
            raise ValueError(f"batch {below} is in the base of batch {last}")
        parts = [(last, base[last])] if base else []
        parts += sorted((n, p) for n, p in delta.items() if n > last and (below is None or n < below))
        if not parts:
            return spark.createDataFrame([], schema)
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/[^/]*$", 1).cast("long")
        rows = spark.read.schema(schema).parquet(*[p for _, p in parts]).withColumn("__batch", folder)
        return self.merged(rows, self.key, F.col("__batch")).drop("__batch")

    def compact(self, spark: SparkSession, schema: str) -> None:
        delta = self._versions(spark, "delta")
        if not delta:
            return
        last = max(delta)
        self.read(spark, schema).write.mode("overwrite").parquet(f"{self.path}/base/batch={last}")
        old = [p for n, p in self._versions(spark, "base").items() if n < last]
        for p in [*old, *delta.values()]:
            remove(spark, p)
