"""Operator 9: removal of repeated lines by a deletion-neighbourhood join.

Lines are compared as word sequences and edits are of whole words. One rule holds at every
length: two lines are near if at most one edit, and at most one in PART words of the longer
line, makes one of the other; so a single edit counts from PART words on, and lines without
one must be equal. A line's neighbourhood is itself and its variants without one word, as
hashed keys of 128 bits:

- lines of equal length within one edit share the variant without word i, at the same i;
- a line and one that has a word more share a variant of the longer and the whole shorter one.

So equal keys are the links, no pairs within a group are needed: for each key the earliest
line is a grouped minimum, and every line meets only those minima. Before any variant is made,
an exact filter leaves out lines without a neighbour: of two lines within one edit the first
or the last half of the words is equal, so lines whose half keys nobody shares stay as they
are. Every pair that meets is verified word by word before a line is given up.

Equal lines are those whose words have one 128-bit digest (BLAKE2b, for which no two texts
of one digest are known), so no line goes by a chance or contrived collision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K
from tessera.llm.substring_dedup import _beside, _flat, _keyed
from tessera.session import store

#: Words of a line for one edit.
PART = 5
NEWLINE = 0x0A
_KEYS = ["k0", "k1", "k2", "k3"]
_SUBST, _WHOLE = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)


def _lines(words: K.Words, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each line with words: its row, its number in the row, and its first and last word number."""
    if not len(words):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    breaks = np.concatenate(([0], np.cumsum(words.raw == NEWLINE)))
    row = K.row_of(words.first)
    number = breaks[words.starts] - breaks[off[row]]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (number[1:] != number[:-1])))
    a = np.flatnonzero(new)
    return row[a], number[a], a, np.append(a[1:], len(words))


def _halves(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Four keys a line (0: none): its first and last half for partners as long or a word longer, and for a word shorter ones."""
    n, out = b - a, []
    i = np.arange(len(h))
    fore, back = K.prefix_sums(K.placed(h, i - np.repeat(a, n))), K.prefix_sums(K.placed(h, np.repeat(b, n) - 1 - i))
    for shorter in (n, n - 1):
        half = shorter // 2
        for tag, key in enumerate((fore[a + half] - fore[a], back[b] - back[b - half])):
            with np.errstate(over="ignore"):
                key = K.mix(key ^ (shorter.astype(np.uint64) * np.uint64(2) + np.uint64(tag)))
            out.append(np.where(shorter >= PART - 1, key, np.uint64(0)))
    return np.column_stack(out)


def _all_lines(docs: DataFrame) -> DataFrame:
    """(lh, doc_id, th, line_no, again, k0..k3): every line with words; lh: their digest; again: an equal one stands earlier in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = K.string_buffers(batch.column(2))
            for x, y, part, off in K.chunks(raw, offsets):
                words = K.Words(part, off, K.BLANK)
                row, number, a, b = _lines(words, off)
                if not len(row):
                    continue
                keys = _halves(words.hashes(), a, b)
                text, start, end = words.joined()
                lh, d = K.digests(text, start[a].tolist(), end[b - 1].tolist())
                order = np.lexsort((d[:, 1], d[:, 0], row))  # stable: earlier lines first
                again = np.zeros(len(row), bool)
                again[order[1:]] = (row[order[1:]] == row[order[:-1]]) & (d[order[1:]] == d[order[:-1]]).all(1)
                ids, take = batch.slice(x, y - x), pa.array(row)
                halves = [pa.array(keys[:, i].copy().view(np.int64), mask=keys[:, i] == 0) for i in range(4)]
                yield pa.RecordBatch.from_arrays([lh, ids.column(0).take(take), ids.column(1).take(take), pa.array(number.astype(np.int32)), pa.array(again), *halves], ["lh", "doc_id", "th", "line_no", "again", *_KEYS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(run, f"lh binary, doc_id {kind}, th long, line_no int, again boolean, " + ", ".join(f"{k} long" for k in _KEYS))


def _candidates(docs: DataFrame, coords: DataFrame) -> DataFrame:
    """(lh, doc_id, th, line_no, words): the words of the lines at the given coordinates, one blank apart."""
    per_doc = store(coords.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line_no")).alias("at")))
    joined = _beside(docs, per_doc, "at", "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = K.string_buffers(batch.column(2))
            at, bounds = _flat(batch.column(3))
            for x, y, part, off in K.chunks(raw, offsets):
                words = K.Words(part, off, K.BLANK)
                row, number, a, b = _lines(words, off)
                wide = 1 << 32
                want = np.repeat(np.arange(y - x), np.diff(bounds[x : y + 1])) * wide + at[bounds[x] : bounds[y]]
                hit = np.flatnonzero(np.isin(row * wide + number, want))
                if not len(hit):
                    continue
                row, number, a, b = row[hit], number[hit], a[hit], b[hit]
                text, start, end = words.joined()
                start, end = start[a].tolist(), end[b - 1].tolist()
                lines = pa.array([text[i:j].decode("utf-8", "replace") for i, j in zip(start, end)], pa.string())
                ids, take = batch.slice(x, y - x), pa.array(row)
                yield pa.RecordBatch.from_arrays([K.digests(text, start, end)[0], ids.column(0).take(take), ids.column(1).take(take), pa.array(number.astype(np.int32)), lines], ["lh", "doc_id", "th", "line_no", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"lh binary, doc_id {kind}, th long, line_no int, words string")


def _variants(cand: DataFrame) -> DataFrame:
    """(vk, wk, rank, role): role 0 one word substituted at a place, 1 one word left out, 2 the line as it is; vk and wk: two independent hashes."""

    def keys(h: np.ndarray, words: K.Words, longer: np.ndarray) -> np.ndarray:
        line = K.row_of(words.first)
        a, b, i = words.first[line], words.first[line + 1], np.arange(len(h))
        here, left = K.prefix_sums(K.placed(h, i - a)), K.prefix_sums(K.placed(h, np.maximum(i - a - 1, 0)))
        length = (b - a).astype(np.uint64)
        with np.errstate(over="ignore"):
            gone = (here[i] - here[a]) + (left[b] - left[i + 1])  # the words before i, and those after it one place to the left
            whole = here[words.first[1:]] - here[words.first[:-1]]
            subst = K.mix(gone ^ _SUBST) + K.mix(length * np.uint64(1 << 32) + (i - a).astype(np.uint64))
            short = K.mix(gone ^ _WHOLE) + length - np.uint64(1)
            full = K.mix(whole ^ _WHOLE) + np.diff(words.first).astype(np.uint64)
        return K.mix(np.concatenate((subst[longer], short[longer], full))).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(0).to_numpy()
            raw, offsets = K.string_buffers(batch.column(1))
            for x, y, part, off in K.chunks(raw, offsets):
                words = K.Words(part, off, K.BLANK)
                n = np.diff(words.first)
                longer = np.flatnonzero(np.repeat(n >= PART, n))
                line = K.row_of(words.first)[longer]
                who = np.concatenate((line, line, np.arange(y - x))) + x
                role = np.repeat(np.arange(3, dtype=np.int8), (len(line), len(line), y - x))
                vk, wk = (keys(words.hashes(seed=seed), words, longer) for seed in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(vk), pa.array(wk), pa.array(rank[who]), pa.array(role)], ["vk", "wk", "rank", "role"])

    return cand.select("rank", "words").mapInArrow(run, "vk long, wk long, rank long, role byte")


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Whether at most one word inserted, left out or substituted makes a of b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]


def near(a: list[str], b: list[str]) -> bool:
    """The rule: at most one edit, and at most one in PART words of the longer line."""
    return a == b or (max(len(a), len(b)) >= PART and within_one_edit(a, b))


def _after_first() -> Column:
    """Whether a row's document comes after the first with the line; one without an id (`none`) is first of all."""
    return F.when(F.col("none"), F.col("doc_id").isNotNull()).otherwise(F.col("doc_id") > F.col("first"))


def near_lines(docs: DataFrame, lines: DataFrame, first: DataFrame) -> DataFrame:
    """(lh): the distinct lines with an earlier one that is near.

    lines: as of _all_lines(), without repeats in one text; first: (lh, first, none, k0..k3), a row a distinct line.
    """
    key = first.select("lh", F.explode(F.array_compact(F.array(*_KEYS))).alias("k"))
    again = store(key.groupBy("k").agg(F.count("*").alias("m")).where("m > 1").select("k"))
    shares = key.join(again, "k").select("lh").distinct()
    where = store(first.join(shares, "lh").select("lh", "first", "none"))  # so that both sides of the next join are plain exchanges
    coords = store(lines.join(where, "lh").where(~_after_first()).select("doc_id", "th", "line_no"))
    cand = _candidates(docs, coords).dropDuplicates(["lh"])  # rows of one document agree
    # ranks follow the order of (document, line): partitions are ranges, and ids grow within and along them
    cand = store(cand.orderBy(F.col("doc_id").asc_nulls_first(), "line_no").select("lh", "words", F.monotonically_increasing_id().alias("rank")))
    rows = store(_variants(cand))
    least = lambda role: F.min(F.when(F.col("role") == role, F.col("rank")))
    groups = store(rows.groupBy("vk", "wk").agg(least(0).alias("subst"), least(1).alias("short"), least(2).alias("whole"), F.count("*").alias("m")).where("m > 1").drop("m"))
    other = F.when(F.col("role") == 0, F.col("subst")).when(F.col("role") == 1, F.col("whole")).otherwise(F.col("short"))
    met = rows.join(groups, ["vk", "wk"]).select("rank", other.alias("theirs")).where("theirs < rank").distinct()
    pairs = met.join(cand, "rank").select("lh", F.col("words").alias("a"), "theirs").join(cand.select(F.col("rank").alias("theirs"), F.col("words").alias("b")), "theirs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [near(x.split(" "), y.split(" ")) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_()))], ["lh"])

    return pairs.select("lh", "a", "b").mapInArrow(verify, "lh binary").distinct()


def repeated_lines(docs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(doc_id, th, gone array<int>): for documents that lose lines, the sorted numbers of those lines.

    A line goes if an equal one, or one within the bound, stands earlier: in a document with a
    smaller id (none is smallest), or before it in the same text; whether that line itself
    goes makes no difference. Rows that share an id, or have none, only lose lines to others.
    Ids may be of any type that has an order.
    """
    lines = store(_all_lines(docs))
    once = lines.where("NOT again")
    first = store(once.groupBy("lh").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("none"), F.count("*").alias("m"), *[F.min(k).alias(k) for k in _KEYS]))
    late = first.where("m > 1").select("lh", "first", "none")
    if fuzzy:
        late = late.join(near_lines(docs, once, first).withColumn("near", F.lit(True)), "lh", "full_outer")
    else:
        late = late.withColumn("near", F.lit(None).cast("boolean"))
    gone = once.join(store(late), "lh").where(F.col("near") | _after_first())
    every = gone.select("doc_id", "th", "line_no").unionByName(lines.where("again").select("doc_id", "th", "line_no"))
    return every.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))


def _taken_out(docs: DataFrame, fuzzy: bool, keep: list[str]) -> DataFrame:
    """The kept columns as c0, c1 and so on, whatever their names, then __kept, __n_lines, __n_removed, __emptied and __null (the text was null)."""
    g = store(repeated_lines(docs, fuzzy)).hint("merge").alias("g")  # of no proven size, so never broadcast
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = [f"c{i}" for i in range(len(keep))]
    d = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col("doc_id").alias("__id"), F.xxhash64(text).alias("__th"), text.alias("__text"), F.col("text").isNull().alias("__null")).alias("d")
    joined = d.join(g, (F.col("d.__th") == F.col("g.th")) & F.col("d.__id").eqNullSafe(F.col("g.doc_id")), "left").select(*[F.col(f"d.{c}") for c in [*names, "__text", "__null"]], F.col("g.gone").alias("__gone"))
    lines = F.when(F.col("__text") == "", F.array().cast("array<string>")).otherwise(F.split("__text", "\n", -1))
    joined = joined.withColumn("__lines", lines)
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    rest = F.array_join(F.transform(stay, lambda i: F.get(F.col("__lines"), i)), "\n")
    joined = joined.withColumn("__kept", F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(rest))
    n_gone = F.when(F.col("__gone").isNull(), F.lit(0)).otherwise(F.size("__gone")).cast("long")
    emptied = F.col("__gone").isNotNull() & ~F.col("__kept").rlike(r"[^\x20\x09-\x0D]")
    return joined.select(*names, "__kept", F.size("__lines").cast("long").alias("__n_lines"), n_gone.alias("__n_removed"), emptied.alias("__emptied"), "__null")


def without_lines(docs: DataFrame, fuzzy: bool = True, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs, then kept_text, n_lines, n_removed and emptied, a row of docs each.

    n_lines counts the pieces between line feeds (an empty text has none; a null text is
    empty). Lines without words are no one's repeat and stay; the others go as
    repeated_lines() says, and the rest stand as they were, one line feed apart. emptied: all
    lines with words went. Lines of any
    length are compared whole. Clashing columns are replaced; empty tables stay empty.
    """
    new = ["kept_text", "n_lines", "n_removed", "emptied"]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    out = _taken_out(docs, fuzzy, keep)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("__kept").alias("kept_text"), F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.col("__emptied").alias("emptied"))


def deduplicate(docs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """The documents without repeated lines; those that lose every line with words go.

    Columns stay as they are, whatever their names, but text, and n_chars, if there is one,
    which counts the new text's characters.
    """
    df = _taken_out(docs, fuzzy, docs.columns).where("NOT __emptied")
    text = F.when(~F.col("__null"), F.col("__kept"))

    def column(i: int, name: str) -> Column:
        if name == "text":
            return text.alias(name)
        if name == "n_chars":
            return F.when(F.col("__n_removed") > 0, F.length(text).cast(docs.schema[name].dataType)).otherwise(F.col(f"c{i}")).alias(name)
        return F.col(f"c{i}").alias(name)

    return df.select(*[column(i, c) for i, c in enumerate(docs.columns)])
