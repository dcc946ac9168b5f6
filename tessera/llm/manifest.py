"""Operator 12: a Merkle manifest of a table, with a proof for each row.

A row is a leaf, a group (source) of rows is a tree of runs of `fanout` nodes, and the trees'
tops are the leaves of one tree over all groups. Each level is a window: partitioned by
(group, parent index) and ordered by index, a full-frame collect_list is the parent's
preimage and holds each node's siblings; the first node of a run then gives the parent, so a
parent comes once. Positions come from a range sort and the sizes of its ranges, so a group
of any size is numbered, hashed and proved in as many tasks as there are. Proofs go down the
tree, joined level by level on (group, parent), where a key has `fanout` rows at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import small, store

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a run.
FANOUT = 16


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: list[Column]) -> Column:
    """A row's digest: each field as its UTF-8 byte count, a colon and its value, `-` if null."""
    text = [f.cast("string") for f in fields]
    return digest(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text])


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with idx, a row's place in its group g by `order` (nulls first), and n, the group's rows.

    Rows that are equal in all of these are dealt out in the order in which they are read, so
    that even many equal rows fill several ranges. df must be cheap to read twice.
    """
    keys = ["g", *order, "tie"]
    ranged = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*[F.asc_nulls_first(k) for k in keys]).sortWithinPartitions(*[F.asc_nulls_first(k) for k in keys])
    ranged = store(ranged.drop("tie").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    runs = ranged.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))  # a row a group and range
    whole = Window.partitionBy("g")
    before = F.coalesce(F.sum("rows").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = store(runs.select("g", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(whole).alias("n")))
    return ranged.join(small(runs), ["g", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _runs(level: DataFrame, fanout: int) -> DataFrame:
    """The nodes with their parent's index and, in order, the digests of their run."""
    w = Window.partitionBy("g", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return level.withColumn("parent", F.floor(F.col("idx") / fanout)).withColumn("run", F.collect_list("h").over(w))


def levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """(g, idx, n, h) of the nodes of each level, leaves first; a group's last node goes up as it is until all groups have one."""
    out, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        first = _runs(out[-1], fanout).where(F.col("idx") % fanout == 0)
        up = first.select("g", F.col("parent").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), F.when(F.col("n") > 1, digest(F.array_join("run", ""))).otherwise(F.col("h")).alias("h"))
        out.append(store(up))
        most = -(-most // fanout)
    return out


def paths(tree: list[DataFrame], top: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The leaves with `path`, the siblings left and right of them and of their ancestors, level by level, and with what `top` has.

    top: (g, path and other columns) of each group's last node.
    """
    extra = [c for c in top.columns if c not in ("g", "path")]
    above = top.withColumn("idx", F.lit(0).cast("long"))
    for level in reversed(tree[:-1]):
        place = (F.col("idx") % fanout).cast("int")
        own = F.struct(F.array_join(F.slice("run", F.lit(1), place), "").alias("l"), F.array_join(F.slice("run", place + 2, F.lit(fanout)), "").alias("r"))
        nodes = _runs(level, fanout).withColumn("own", F.when(F.col("n") > 1, F.array(own)).otherwise(F.array().cast("array<struct<l:string,r:string>>"))).drop("run", "n")
        nodes = nodes.join(above.select(F.col("g"), F.col("idx").alias("parent"), F.col("path").alias("rest"), *extra), ["g", "parent"])
        above = nodes.withColumn("path", F.concat("own", "rest")).drop("own", "rest", "parent")
    return above


def _emptied(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.array().cast("array<struct<l:string,r:string>>"))


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", fanout: int = FANOUT) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified), a row of docs each.

    changed: columns as they stand where the table is held against its manifest; folded_root
    is folded from the leaf that a row has with them and from the original siblings, so
    verified is false where a change matters. Groups and the rows of a group may be any
    number; a null group is one, before the others; rows with a null key come first in their
    group, and rows with one key are ordered by their leaf. Texts are hashed whole where they
    are read and never moved; equal rows are equal leaves and prove each their own place; an
    empty table has no rows. Columns beyond the fields don't count, whatever their names.
    """
    cell = lambda c: F.col(f"`{c}`")
    now = leaf([(changed or {}).get(c, cell(c)) for c in fields])
    g = F.when(cell(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), cell(group).cast("string")))
    rows = store(docs.select(g.alias("g"), cell(key).alias("key"), leaf([cell(c) for c in fields]).alias("h"), now.alias("now")).withColumn("now", F.when(F.col("now") != F.col("h"), F.col("now"))))
    leaves = store(numbered(rows, ["key", "h"]))
    tree = levels(leaves, fanout)
    tops = store(tree[-1].select(F.lit("").alias("g"), F.col("g").alias("of"), F.col("h")))
    whole = levels(store(numbered(tops, ["of"])), fanout)
    root = whole[-1].select("g", F.col("h").alias("root"))  # one row
    top = store(paths(whole, _emptied(root), fanout).select(F.col("of").alias("g"), "path", "root", F.col("h").alias("subroot")) if len(whole) > 1 else whole[0].join(root, "g").transform(_emptied).select(F.col("of").alias("g"), "path", "root", F.col("h").alias("subroot")))
    proved = paths(tree, top, fanout) if len(tree) > 1 else leaves.join(top, "g")
    siblings = F.array_join(F.transform("path", lambda p: F.concat(p["l"], p["r"])), "")
    folded = F.aggregate("path", F.coalesce("now", "h"), lambda h, p: digest(p["l"], h, p["r"]))
    out = proved.select(F.col("key").alias(key), F.col("h").alias("leaf"), "subroot", "root", digest(siblings).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
