"""Operator 8: near-duplicate documents by SimHash.

Fingerprints: one bit a hash bit, set where over half of the shingles' XXH64 values have it.
Links: fingerprints that differ in at most `radius` bits. They are found through a
byte-position inverted index with count filtering: two fingerprints within three bits share
at least five of their eight positional bytes, so they share one of the eight byte triples
that lie in one half (five positions put three in a half). Each index entry's postings are
compared in blocks: the shared positional bytes of a pair are tallied, pairs under the
guaranteed minimum go, the rest is verified by its differing bits. Equal fingerprints are
one posting, long postings are split into pairs of bounded blocks that are compared in
separate tasks, and a block gives back a spanning forest, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.components import components
from tessera.session import checkpoint

SEED = 42
#: Every five of the eight byte positions hold one of these triples.
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
BLOCK = 2048


def _fingerprint_rows(raw: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    words = K.Words(raw, offsets, K.BLANK)
    n_rows, counts = len(offsets) - 1, np.diff(words.first)
    out = np.zeros(n_rows, np.uint64)
    if not len(words):
        return out
    text, starts, ends = words.joined(lower=True)
    # a row's shingles: its words from i to i+shingle-1; a shorter row has one, all its words
    n_sh = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    row = np.repeat(np.arange(n_rows), n_sh)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n_sh) - n_sh, n_sh)
    a = words.first[:-1][row] + at
    b = np.minimum(a + shingle, words.first[1:][row]) - 1
    h = K.xxh64(np.frombuffer(text, np.uint8), starts[a], ends[b] - starts[a], SEED)
    full = np.flatnonzero(n_sh)
    first = (np.cumsum(n_sh) - n_sh)[full]
    ones = np.zeros((len(full), 64), np.int64)
    step = 1 << 15
    lo = 0
    while lo < len(full):  # so many shingles at a time that their bits stay in cache
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + step)))
        hi = min(hi, len(full))
        stop = first[hi] if hi < len(full) else len(h)
        part = h[first[lo] : stop]
        if hi == lo + 1:  # one row, of any length
            for s in range(0, len(part), step):
                ones[lo] += np.unpackbits(part[s : s + step].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        else:
            bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
            ones[lo:hi] = np.add.reduceat(bits, first[lo:hi] - first[lo], axis=0, dtype=np.int64)
        lo = hi
    out[full] = np.packbits(2 * ones > n_sh[full][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp bigint) a row; a null text is an empty one, which has fingerprint 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = K.string_buffers(batch.column(1))
            fp = np.zeros(len(batch), np.uint64)
            for a, b, part, off in K.chunks(raw, offsets):
                fp[a:b] = _fingerprint_rows(part, off, shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _forest(group: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int, least_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group; edges of a spanning forest of the links within each group."""
    n = len(fp)
    label, left, right = np.arange(n), [], []
    at, lag = np.arange(n), 0
    while True:
        lag += 1
        at = at[at + lag < n]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            break
        x = fp[at] ^ fp[at + lag]
        same = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)  # shared positional bytes
        hit = at[same >= least_bytes]
        hit = hit[np.bitwise_count(fp[hit] ^ fp[hit + lag]) <= radius]
        hit = hit[label[hit] != label[hit + lag]]
        for i in hit.tolist():
            a, b = i, i + lag
            while label[a] != a:
                a = label[a]
            while label[b] != b:
                b = label[b]
            if a != b:
                label[max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + lag)
        while len(hit) and (label[label] != label).any():
            label = label[label]
    left, right = np.array(left, int), np.array(right, int)
    return fp[left], fp[right]


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that keep every component of the link graph."""
    if not 0 <= radius <= 3:
        raise ValueError("the index guarantees links within three bits at most")
    least = 8 - radius
    one = checkpoint(fps.select("fp").distinct())
    keys = [F.struct(F.lit(i).alias("t"), sum((F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) * F.lit(1 << (8 * k)) for k, p in enumerate(t)), F.lit(0).cast("long")).alias("v")) for i, t in enumerate(TRIPLES)]
    post = one.select("fp", F.explode(F.array(*keys)).alias("k")).select((F.col("k.t") * F.lit(1 << 24) + F.col("k.v")).alias("k"), "fp")
    size = checkpoint(post.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"))  # stored, so that a long posting list can be split where it meets its size
    blocks = F.ceil(F.col("n") / BLOCK)
    mine = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("long")
    tasks = (
        post.join(size, "k")
        .withColumn("nb", blocks)
        .withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
        .select("k", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            new = np.any(rows[1:, :3] != rows[:-1, :3], axis=1)
            group = np.concatenate(([0], np.cumsum(new)))
            a, b = _forest(group, np.ascontiguousarray(rows[:, 3]).view(np.uint64), group, radius, least)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            rows = np.column_stack([c.to_numpy() for c in batch.columns])
            rows = np.concatenate([*held, rows]) if held else rows
            last = np.flatnonzero(np.any(rows[:, :3] != rows[-1, :3], axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if cut:
                yield flush(rows[:cut])
            held = [rows[cut:]]
        if held and len(held[0]):
            yield flush(held[0])

    return tasks.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): component is the smallest id that links reach, the row's own included.

    Null and empty texts have fingerprint 0 and are linked like any other; rows that share an
    id each give a row; a component whose ids are all null has component null. No rows in, no rows out.
    """
    fps = checkpoint(fingerprints(docs, shingle, id_col, text_col))
    first = fps.groupBy("fp").agg(F.min("id").alias("first"))
    comp = components(links(fps, radius)).withColumnsRenamed({"node": "fp"})
    known = first.join(comp, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    lowest = known.groupBy("root").agg(F.min("first").alias("component"))
    return fps.join(known.join(lowest, "root").select("fp", "component"), "fp").select("id", "fp", "component")


def hex_fingerprint(fp) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicate(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """The documents whose id is the smallest of its component; all columns stay as they are.

    Rows that share one doc_id are one document and stay or go together; a null doc_id stays
    only if no document of its component has an id.
    """
    from tessera.llm.common import without

    near = near_duplicates(docs, radius, shingle)
    gone = near.where("id <> component").select(F.col("id").alias("doc_id"))
    return without(docs, gone, "doc_id")


def deduplicate_rows(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """One row a component, that with the smallest id (of one id, with the smallest text hash); all columns stay as they are.

    Unlike deduplicate(), rows are decided on by themselves: a null doc_id stays only if no
    document of its component has an id, and of equal rows one stays.
    """
    from tessera.llm.common import once_each, row_key, without_rows

    near = checkpoint(near_duplicates(docs.select(row_key().alias("key"), "text"), radius, shingle, "key"))
    kept = near.where(F.col("id").eqNullSafe(F.col("component")))
    again = kept.groupBy(F.col("id").alias("key")).count().where("count > 1")
    gone = near.where(~F.col("id").eqNullSafe(F.col("component"))).select(F.col("id").alias("key"))
    return once_each(without_rows(docs, gone), again)
