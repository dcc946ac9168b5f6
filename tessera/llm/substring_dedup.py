"""Operator 4: removal of long repeated passages through a compacted De Bruijn graph.

Edges are windows of k consecutive words, nodes their (k-1)-word overlaps. The graph is
never laid out edge by edge: as in minimiser-partitioned compaction, consecutive edges of a
document whose least m-word gram (the minimiser) is the same place form one path, which is
kept as one row (minimiser, content hashes, number of edges, source coordinates). Equal
windows have equal minimisers at equal relative places, so a repeated edge lies on two paths
with one minimiser. Hence, each step a Spark join or grouping:

1. Paths whose minimiser occurs once hold no repeated edge and go.
2. Occurrences of one path compact into one class: those of one minimiser and length whose
   words, read at their source coordinates, have one 128-bit digest. A class with two or
   more occurrences is repeated as a whole.
3. Where one minimiser has several classes, their paths branch: one occurrence of each is
   expanded to its edges at its source coordinates, and edges that two classes share, again
   by the digests of their words, are repeated.
4. Spans of all occurrences glue to maximal repeated spans of each document, by coordinates.

64-bit hashes choose minimisers only; what is removed rests on digests of the words
themselves (BLAKE2b, for which no two texts of one digest are known). A window counts as
repeated if its words also start anywhere else, in the same document or another; windows are
judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.session import store

GRAM = 6
_POS = np.uint64((1 << 28) - 1)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows are known by doc_id and a hash of the text: equal rows have equal spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while 2 * have <= w:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return np.minimum(v[: len(v) - (w - have)], v[w - have :]) if have < w else v


def _paths(docs: DataFrame, k: int, keys_only: bool = False) -> DataFrame:
    """(mkey, w, cnt, doc_id, th, first): maximal runs of windows with one minimiser; w: the digest of their words. Or only mkey."""
    names = ["mkey"] if keys_only else ["mkey", "w", "cnt", "doc_id", "th", "first"]

    def runs(words: K.Words):
        n = len(words)
        if n < k:
            return None
        grams = K.window_hashes(words.hashes(), GRAM)
        least = _sliding_min((grams & ~_POS) | np.arange(len(grams), dtype=np.uint64), k - GRAM + 1)
        doc = K.row_of(words.first)
        start = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
        if not len(start):
            return None
        at = (least[start] & _POS).astype(np.int64)
        i = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1))))
        return grams[at[i]].view(np.int64), start[i], np.diff(np.append(i, len(start))), doc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = K.string_buffers(batch.column(2))
            for a, b, part, off in K.chunks(raw, offsets):
                words = K.Words(part, off, K.BLANK)
                if (r := runs(words)) is None:
                    continue
                mkey, first, cnt, doc = r
                if keys_only:
                    yield pa.RecordBatch.from_arrays([pa.array(mkey)], names)
                    continue
                text, start, end = words.joined()
                w, _ = K.digests(text, start[first].tolist(), end[first + cnt + k - 2].tolist())
                d, ids = doc[first], batch.slice(a, b - a)
                take = pa.array(d)
                yield pa.RecordBatch.from_arrays([pa.array(mkey), w, pa.array(cnt.astype(np.int32)), ids.column(0).take(take), ids.column(1).take(take), pa.array((first - words.first[d]).astype(np.int32))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(run, "mkey long" if keys_only else f"mkey long, w binary, cnt int, doc_id {kind}, th long, first int")


def _edges(docs: DataFrame, coords: DataFrame, k: int) -> DataFrame:
    """(h, doc_id, th, start, single): the windows of the given paths, read at their source coordinates; h: the digest of their words."""
    per_doc = coords.groupBy("doc_id", "th").agg(F.flatten(F.collect_list(F.array("first", "cnt", F.col("single").cast("int")))).alias("at"))
    joined = _beside(docs, store(per_doc), "at", "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = K.string_buffers(batch.column(2))
            at, bounds = _flat(batch.column(3))
            for a, b, part, off in K.chunks(raw, offsets):
                words = K.Words(part, off, K.BLANK)
                text, first, last = words.joined()
                c = at[bounds[a] : bounds[b]].reshape(-1, 3)
                d = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]) // 3)
                n = c[:, 1]
                rel = np.repeat(c[:, 0], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                d, single = np.repeat(d, n), np.repeat(c[:, 2], n) == 1
                i = words.first[d] + rel
                h, _ = K.digests(text, first[i].tolist(), last[i + k - 1].tolist())
                ids, take = batch.slice(a, b - a), pa.array(d)
                yield pa.RecordBatch.from_arrays([h, ids.column(0).take(take), ids.column(1).take(take), pa.array(rel.astype(np.int32)), pa.array(single)], ["h", "doc_id", "th", "start", "single"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"h binary, doc_id {kind}, th long, start int, single boolean")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the n+1 bounds of its rows; null lists are empty."""
    lens = np.asarray(column.value_lengths().fill_null(0))
    return np.asarray(column.flatten()).astype(np.int64), np.concatenate(([0], np.cumsum(lens))).astype(np.int64)


def _beside(docs: DataFrame, found: DataFrame, values: str, how: str) -> DataFrame:
    """Documents with their arrays of `found`, met in a sort-merge join at every size: arrays of no proven size are never broadcast."""
    d, f = _keyed(docs).alias("d"), found.hint("merge").alias("f")
    return d.join(f, (F.col("d.th") == F.col("f.th")) & F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), how).select("d.doc_id", "d.th", "d.text", f"f.{values}")


def repeated_spans(docs: DataFrame, k: int = 35) -> DataFrame:
    """(doc_id, th, spans array<int>): for documents with repeats, the sorted, disjoint, half-open word ranges, as start, end, start, end."""
    if k <= GRAM:
        raise ValueError(f"k must be over {GRAM}")
    # grouped keys are stored before they meet the rows again, so that the join's sides are plain
    # exchanges, whose hot keys adaptive execution splits
    again = store(_paths(docs, k, keys_only=True).groupBy("mkey").agg(F.count("*").alias("n")).where("n > 1").select("mkey"))
    paths = store(_paths(docs, k).join(again, "mkey"))
    same = ["mkey", "w", "cnt"]
    classes = store(paths.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "first")).alias("one")))
    branching = store(classes.groupBy("mkey").agg(F.count("*").alias("kinds")).where("kinds > 1").select("mkey"))
    coords = classes.join(branching, "mkey").select("one.doc_id", "one.th", "one.first", "cnt", (F.col("n") == 1).alias("single"))
    edges = store(_edges(docs, coords, k))
    shared = store(edges.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    part = edges.where("single").join(shared, "h").select("doc_id", "th", F.col("start").alias("a"), (F.col("start") + k).alias("b"))
    full = paths.join(classes.where("n > 1").select(*same), same).select("doc_id", "th", F.col("first").alias("a"), (F.col("first") + F.col("cnt") + k - 1).alias("b"))
    spans = full.unionByName(part).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("s"))
    # a document's paths share no window, so spans in order of their starts are in order of their ends too
    begin = F.filter("s", lambda x, i: (i == 0) | (F.get(F.col("s"), i - 1)["b"] < x["a"]))
    end = F.filter("s", lambda x, i: (i == F.size("s") - 1) | (F.get(F.col("s"), i + 1)["a"] > x["b"]))
    return spans.select("doc_id", "th", F.flatten(F.zip_with(begin, end, lambda x, y: F.array(x["a"], y["b"]))).alias("spans"))


def without_repeats(docs: DataFrame, k: int = 35, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]) a row of docs.

    Words are runs of bytes other than ASCII blanks; a null text has none. Words under a
    window of k words that starts anywhere else too are removed, both in the first place and
    in later ones; the kept words are joined by one space. Texts of under k words stay whole.
    Rows that repeat, doc_id and all, repeat each other's words and lose them. A null doc_id
    is a row like any other. No rows in, no rows out; other columns aren't looked at.
    """
    joined = _beside(docs, store(repeated_spans(docs, k)), "spans", "left")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = K.string_buffers(batch.column(2))
            spans, bounds = _flat(batch.column(3))
            n_words, n_removed, sha, texts = [], [], [], []
            for a, b, part, off in K.chunks(raw, offsets):
                words = K.Words(part, off, K.BLANK)
                s = spans[bounds[a] : bounds[b]].reshape(-1, 2)
                base = words.first[np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]) // 2)]
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, base + s[:, 0], 1)
                np.add.at(change, base + s[:, 1], -1)
                keep = np.cumsum(change)[:-1] == 0
                text, start, end = words.joined(keep=keep)
                kept = np.concatenate(([0], np.cumsum(keep)))[words.first]
                n = np.diff(words.first)
                n_words.append(n)
                n_removed.append(n - np.diff(kept))
                for i, j in zip(kept[:-1].tolist(), kept[1:].tolist()):
                    piece = text[start[i] : end[j - 1]] if j > i else b""
                    sha.append(hashlib.sha256(piece).hexdigest())
                    if with_text:
                        texts.append(piece.decode("utf-8", "replace"))
            if not n_words:
                continue
            columns = [batch.column(0), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_removed)), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(texts, pa.string())] if with_text else [])], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
