"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import checkpoint

#: A side of a join is broadcast only if it was counted and has at most so many rows of fixed width.
BROADCAST_ROWS = 1_000_000


def own_prefix(columns: list[str]) -> str:
    """What no column's name begins with, so that an operator's own columns never meet a caller's."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are few, else as it is, for a shuffled join.

    df must be cheap to count (a checkpoint) and narrow (a few fixed-width columns).
    """
    return F.broadcast(df) if df.count() <= most else df


def without(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows of docs whose key is not in gone; null keys stay."""
    return docs.join(sized(checkpoint(gone.distinct())), key, "left_anti")


def row_key() -> Column:
    """A row by doc_id (null ones last) and a hash of its text, so that rows without an id, or with the same, are told apart."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("th"))


def _met(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    th = own_prefix(docs.columns) + "th"
    d, k = docs.withColumn(th, row_key()["th"]).alias("d"), keys.alias("k")
    return d.join(k, (F.col(f"d.{th}") == F.col("k.th")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), how).drop(th)


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose row_key() is not in gone's column `key`; null ids are ids like others."""
    return _met(docs, sized(checkpoint(gone.select("key.doc_id", "key.th").distinct())), "left_anti")


def once_each(docs: DataFrame, again: DataFrame) -> DataFrame:
    """docs with one row for each row_key() in again's column `key`, the first by its other columns; other rows stay as they are."""
    keys = checkpoint(again.select("key.doc_id", "key.th").distinct())
    if keys.isEmpty():
        return docs
    keys = sized(keys)
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    w = Window.partitionBy("doc_id", row_key()["th"]).orderBy(*others or [F.lit(0)])
    n = own_prefix(docs.columns) + "n"
    one = _met(docs, keys, "left_semi").withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)
    return _met(docs, keys, "left_anti").unionByName(one)
