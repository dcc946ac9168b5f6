"""Session construction and small helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most so many narrow rows.
BROADCAST_ROWS = 1_000_000
#: Files that checkpoint() and store() made and that are not removed yet, in order.
_MADE: list[str] = []


def build_session(cpus: int | str = 8, app: str = "tessera", **extra: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, ANSI, adaptive execution, Arrow.

    On this machine, unless spark-submit has begun one elsewhere; then spark.checkpoint.dir
    must be set, or given here as spark__checkpoint__dir.
    """
    b = SparkSession.builder if "PYSPARK_GATEWAY_PORT" in os.environ else SparkSession.builder.master(f"local[{cpus}]")
    b = (
        b.appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in extra.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; read by Spark only, so any store that Spark can reach will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, which survives lost executors. For narrow or small tables."""
    _folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    _MADE.append(out._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get())
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one that spark.checkpoint.dir names.

    Where that is unset, a session on one machine takes a temporary folder; on a cluster this
    raises, as executors don't see each other's disks.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = os.path.join(tempfile.gettempdir(), "tessera-checkpoints")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def _folder(spark: SparkSession) -> str:
    if not _MADE:
        atexit.register(release, spark)
    return shared_folder(spark)


def store(df: DataFrame) -> DataFrame:
    """Like checkpoint(), as a compressed columnar table, for larger intermediate results.

    The table lies in the shared folder and is removed by release(), at the latest when the
    Python process ends.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed by release()."""
    path = f"{_folder(spark)}/files-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, which must be narrow and cheap to count, with a broadcast hint if it has few rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def release(spark: SparkSession, first: int = 0, keep: int = 0) -> None:
    """Remove what was made from the first-th file on, but the last `keep` ones. Nothing that reads it may be used after this."""
    gone = _MADE[first : len(_MADE) - keep]
    del _MADE[first : len(_MADE) - keep]
    if gone and spark.sparkContext._jsc is not None:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in gone:
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(conf).delete(jpath, True)


def in_steps(df: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """df through the steps, one after the other; each result is stored, and what a step made on the way, and its input, is removed after it."""
    spark = df.sparkSession
    first = len(_MADE)
    for step in steps:
        df = store(step(df))
        release(spark, first, keep=1)
    return df
