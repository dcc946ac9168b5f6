"""Vector functions: unit norm and dot product, as expressions and as blocked matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructType

#: Query vectors are taken in blocks of so many, each sent to the tasks with the closure.
QUERY_BLOCK = 1_000


def dot(a: Column, b: Column) -> Column:
    """Summed in double, in order, so that engines agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v over its length; a zero vector as it is."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def similarities(queries: list[tuple[object, list[float]]], rows: DataFrame, least: float, keep: list[str], vector: str = "embedding") -> DataFrame:
    """(query_id, *keep, cosine) of all rows and a stated set of unit query vectors, where cosine is `least` or more.

    One matrix product a batch of rows and block of queries; rows that miss every query never leave the task.
    """
    kind = rows.select(*keep).schema
    id_type = pa.array([q for q, _ in queries]).type if queries else pa.int64()
    schema = StructType().add("query_id", from_arrow_type(id_type))
    for f in kind:
        schema = schema.add(f)
    schema = schema.add("cosine", "double")
    out = None
    for i in range(0, max(1, len(queries)), QUERY_BLOCK):
        ids = pa.array([q for q, _ in queries[i : i + QUERY_BLOCK]], id_type)
        matrix = np.array([v for _, v in queries[i : i + QUERY_BLOCK]], np.float64).T

        def run(batches: Iterator[pa.RecordBatch], ids=ids, matrix=matrix) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch) or not len(ids):
                    continue
                x = np.asarray(batch.column(len(keep)).flatten(), np.float64).reshape(len(batch), -1)
                score = x @ matrix
                r, q = np.nonzero(score >= least)
                take = pa.array(r)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), *[batch.column(j).take(take) for j in range(len(keep))], pa.array(score[r, q])], ["query_id", *keep, "cosine"])

        part = rows.where(F.col(vector).isNotNull()).select(*keep, vector).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


#: Rows of a shard: as many vectors as a task holds at a time.
SHARD = 1 << 16


class Clusters:
    """Unit vectors in clusters with a centre and a radius (the widest angle from it), for exact search."""

    def __init__(self, vectors: np.ndarray):
        n = len(vectors)
        k = max(1, int(n**0.5) // 2)
        pivots = vectors[np.linspace(0, n - 1, k).astype(int)]
        near = np.concatenate([(vectors[i : i + 4096] @ pivots.T).argmax(1) for i in range(0, n, 4096)]) if n else np.zeros(0, int)
        self.order = np.argsort(near, kind="stable")
        self.vectors = vectors[self.order]
        _, self.begin = np.unique(near[self.order], return_index=True)
        self.end = np.append(self.begin[1:], n)
        centre = np.add.reduceat(self.vectors, self.begin)
        norm = np.linalg.norm(centre, axis=1, keepdims=True)
        self.centre = centre / np.where(norm > 0, norm, 1)
        cosine = np.einsum("ij,ij->i", self.vectors, np.repeat(self.centre, self.end - self.begin, axis=0))
        self.radius = np.array([np.arccos(np.clip(cosine[a:b].min(), -1, 1)) for a, b in zip(self.begin, self.end)])

    def nearest(self, queries: np.ndarray, ids: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, row, cosine) of the k best rows a query by (cosine rounded to `digits`, then id), and how many pairs were compared.

        A cluster is skipped for the queries whose k-th best no row of it can reach: an angle
        to a row is the angle to the centre less the radius, at least. Both are unit vectors.
        """
        m, unit = len(queries), 10.0**digits
        best = np.full((m, k), -np.inf)
        row = np.full((m, k), -1)
        tie = np.full((m, k), np.iinfo(np.int64).max)
        angle = np.arccos(np.clip(queries @ self.centre.T, -1, 1)) - self.radius
        bound = np.where(angle <= 0, 1.0, np.cos(np.clip(angle, 0, np.pi))) + 2 / unit
        ranked = np.argsort(-bound, axis=1, kind="stable")  # each query takes its most hopeful clusters first
        compared, ids = 0, ids[self.order]
        for step in range(len(self.begin)):
            c = ranked[:, step]
            for cluster in np.unique(c):
                who = np.flatnonzero((c == cluster) & (bound[:, cluster] >= best[:, -1]))
                if not len(who):
                    continue
                a, b = self.begin[cluster], self.end[cluster]
                score = queries[who] @ self.vectors[a:b].T
                compared += score.size
                all_score = np.concatenate((best[who], np.floor(score * unit + 0.5) / unit), 1)
                all_tie = np.concatenate((tie[who], np.broadcast_to(ids[a:b], score.shape)), 1)
                all_row = np.concatenate((row[who], np.broadcast_to(np.arange(a, b), score.shape)), 1)
                top = np.lexsort((all_tie, -all_score), axis=1)[:, :k]
                best[who], tie[who], row[who] = (np.take_along_axis(x, top, 1) for x in (all_score, all_tie, all_row))
        q, j = np.nonzero(row >= 0)
        at = row[q, j]
        cosine = np.einsum("ij,ij->i", queries[q], self.vectors[at])
        return q, self.order[at], cosine, compared


def nearest(queries: DataFrame, rows: DataFrame, k: int, group: str | None = None, vector: str = "embedding", digits: int = 6, shard: int = SHARD, counted: bool = False) -> DataFrame:
    """(query_id, [group,] row_id, cosine): for each query at least its k nearest rows (of each group), at most k a shard; rank them to cut.

    queries: (query_id, vector); rows: (row_id, [group,] vector), all of unit length, ids whole
    numbers. Rows are dealt into shards of some `shard` rows (of one group), by id hash, and a
    task meets a shard first, which it puts in clusters, and then the queries in blocks, as one
    sorted stream: nothing is gathered on the driver, and a task holds a shard and a block.
    counted: instead (compared, pairs) a task, pairs being all there are.
    """
    kept = rows.where(F.col(vector).isNotNull()).select((F.col(group) if group else F.lit(0)).cast("string").alias("grp"), F.col("row_id").cast("long").alias("id"), F.col(vector).alias("v"))
    cells = kept.groupBy("grp").agg(F.ceil(F.count("*") / shard).cast("int").alias("cells"))  # a row a group
    own = kept.join(F.broadcast(cells) if cells.limit(100_001).count() <= 100_000 else cells, "grp")
    own = own.select("grp", F.pmod(F.xxhash64("id"), F.col("cells")).cast("int").alias("cell"), F.lit(0).alias("tag"), "id", "v")
    spread = cells.select("grp", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    asked = queries.where(F.col(vector).isNotNull()).select(F.lit(1).alias("tag"), F.col("query_id").cast("long").alias("id"), F.col(vector).alias("v"))
    asked = spread.join(asked)  # the stated query set against all shards
    stream = own.unionByName(asked.select(*own.columns)).repartition("grp", "cell").sortWithinPartitions("grp", "cell", "tag", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, parts, built = None, [], [], None
        done = pairs = 0
        for batch in batches:
            grp, cell, tag, num = (batch.column(i).to_pylist() for i in range(4))
            x = np.asarray(batch.column(4).flatten(), np.float64).reshape(len(batch), -1)
            edge = [0, *[i for i in range(1, len(grp)) if (grp[i], cell[i], tag[i]) != (grp[i - 1], cell[i - 1], tag[i - 1])], len(grp)] if len(grp) else []
            for a, b in zip(edge, edge[1:]):
                if (grp[a], cell[a]) != now:
                    now, ids, parts, built = (grp[a], cell[a]), [], [], None
                if tag[a] == 0:
                    ids.append(np.array(num[a:b]))
                    parts.append(x[a:b])
                    continue
                if built is None:
                    if not parts:
                        continue
                    held = np.concatenate(ids)
                    built = Clusters(np.concatenate(parts))
                    parts = []
                q, r, cosine, n = built.nearest(x[a:b], held, k, digits)
                done, pairs = done + n, pairs + (b - a) * len(held)
                if not counted and len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(num[a:b])[q]), pa.array([grp[a]] * len(q), pa.string()), pa.array(held[r]), pa.array(cosine)], ["query_id", "grp", "row_id", "cosine"])
        if counted:
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64()), pa.array([pairs], pa.int64())], ["compared", "pairs"])

    if counted:
        return stream.mapInArrow(run, "compared long, pairs long")
    out = stream.mapInArrow(run, "query_id long, grp string, row_id long, cosine double")
    return out.withColumn("grp", F.col("grp").cast(rows.schema[group].dataType)).withColumnRenamed("grp", group) if group else out.drop("grp")
