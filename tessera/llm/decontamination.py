"""Operator 6: benchmark decontamination by SimHash over item-sized windows.

For each benchmark item, every window of as many words of a document (the whole document, if
it is shorter) is a possible copy. Windows and items have 64-bit SimHash fingerprints over
their five-word shingles, weighted by how often each occurs. Fingerprints are indexed by
their blocks of BLOCK bits, among items of one length: two that differ in RADIUS bits at most
differ in no more than RADII[b] bits in some block b, as RADII[b] + 1 bits in every block are
more than RADIUS. So the entries within those radii of a window's blocks hold every item
within RADIUS of it, and some fifth of the others. Pairs within the radius are verified by the
exact weighted Jaccard similarity of the shingle multisets.

To fingerprint and look up every window at every item's length would cost thousands of probes
a word. So windows are spared first, without loss: one as similar as SIMILARITY lacks less
than a fifth of an item's shingles, so of any more of them, here those that the fewest items
have, it holds one, and it holds enough of that item's shingles. Windows for which no item
meets both are left out; which items those left are compared with is the blocks' choice.

The items are the stated query set. They are taken in blocks of bounded size, each broadcast
and held against all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType, StructType

from tessera.llm import kernels as K
from tessera.llm.common import row_key, without, without_rows

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of texts as similar as SIMILARITY differ in 9.7 bits of 64 on average, with a deviation of 2.9.
RADIUS = 20
#: Four blocks of 16 bits; the radii are the least for which all of RADIUS is found.
BLOCK, RADII = 16, (5, 4, 4, 4)
#: Characters of a block of items, each item counted as ITEM_CHARS more. A model has some 8 bytes for each.
BLOCK_CHARS, ITEM_CHARS = 8_000_000, 20
#: Windows that are fingerprinted at a time, and entries that are looked up at a time.
STEP, PROBES = 1 << 14, 1 << 20


@dataclass
class Model:
    """Flat arrays; items in the order of their rows."""

    ids: pa.Array
    times: np.ndarray  # rows of the item
    n_words: np.ndarray
    prints: np.ndarray
    start: np.ndarray  # bounds of each item's part of values and counts
    values: np.ndarray  # its distinct shingle hashes, sorted
    counts: np.ndarray
    rare: np.ndarray  # the shingles by which items are found, sorted
    rare_start: np.ndarray  # bounds of each one's part of rare_items
    rare_items: np.ndarray
    sieve: np.ndarray  # by the top 20 bits of such a shingle
    tables: list[tuple[np.ndarray, np.ndarray]]  # a block's: sorted (words of the item, bits of the block), items
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # words, under SHINGLE -> sorted hashes of all words, items


def _signs(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8), bitorder="little").reshape(-1, 64).astype(np.int32) * 2 - 1


def _simhash(bits_sum: np.ndarray) -> np.ndarray:
    """Rows of 64 signed sums to fingerprints."""
    return np.packbits(bits_sum > 0, axis=-1, bitorder="little").view(np.uint64).ravel()


def _window_prints(s: np.ndarray, start: np.ndarray, w: int) -> np.ndarray:
    """Fingerprints of the windows of w shingles at sorted starts, from running sums over a bounded stretch at a time."""
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(start, start[i] + STEP))
        if w > STEP:  # few windows of a long item: each is summed in pieces
            j = i + 1
            total = sum(_signs(s[x : min(x + STEP, start[i] + w)]).sum(0) for x in range(int(start[i]), int(start[i]) + w, STEP))
            out[i] = _simhash(total[None, :])[0]
        else:
            lo = int(start[i])
            sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_signs(s[lo : int(start[j - 1]) + w]), axis=0, dtype=np.int32)))
            at = start[i:j] - lo
            out[i:j] = _simhash(sums[at + w] - sums[at])
        i = j
    return out


def _block(prints: np.ndarray, b: int) -> np.ndarray:
    return (prints >> np.uint64(BLOCK * b)).astype(np.int64) & ((1 << BLOCK) - 1)


@cache
def _flips(radius: int) -> np.ndarray:
    """The block values of so many bits at most."""
    x = np.arange(1 << BLOCK)
    return x[np.bitwise_count(x) <= radius]


def named(m: Model, prints: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a fingerprint's number and an item of so many words that a block's entries name, each once.

    A block's entries are found by all values within its radius, or, where the items have fewer, by going through those."""
    pairs = []
    for b, (radius, (keys, items)) in enumerate(zip(RADII, m.tables)):
        lo, hi = np.searchsorted(keys, [n_words << BLOCK, (n_words + 1) << BLOCK])
        mine, flips = keys[lo:hi], _flips(radius)
        value = _block(prints, b)
        if hi - lo <= len(flips):
            which, at = np.nonzero(np.bitwise_count((mine & ((1 << BLOCK) - 1))[None, :] ^ value[:, None]) <= radius)
        else:
            probe = (value[:, None] ^ flips[None, :]).ravel() | (n_words << BLOCK)
            first = np.searchsorted(mine, probe)
            n = np.searchsorted(mine, probe, "right") - first
            which = np.repeat(np.repeat(np.arange(len(prints)), len(flips)), n)
            at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs.append(which * len(m.prints) + items[lo:hi][at])
    return np.divmod(np.unique(np.concatenate(pairs)), max(len(m.prints), 1))


def within_radius(m: Model, prints: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A fingerprint's number, an item of so many words, and their differing bits, for all pairs within RADIUS, by item."""
    keys = m.tables[0][0]
    lo, hi = np.searchsorted(keys, [n_words << BLOCK, (n_words + 1) << BLOCK])
    step = max(1, PROBES // max(1, min(hi - lo, max(len(_flips(max(RADII))), (hi - lo) // 8))))  # bounds the probes, and about the pairs
    parts = []
    for x in range(0, len(prints), step):
        which, item = named(m, prints[x : x + step], n_words)
        bits = np.bitwise_count(prints[x + which] ^ m.prints[item])
        near = bits <= RADIUS
        parts.append((x + which[near], item[near], bits[near]))
    which, item, bits = (np.concatenate(c) for c in zip(*parts))
    by = np.argsort(item, kind="stable")
    return which[by], item[by], bits[by]


def prepare(rows: list[tuple[object, str, int]], id_type: DataType | None = None) -> Model:
    """A model of (item_id, text, times) rows; items without words match nothing."""
    texts = [(text or "").encode() for _, text, _ in rows]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    words = K.Words(raw, np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64), K.NON_WORD)
    h, n_words, item_of = words.hashes(lower=True), np.diff(words.first), K.row_of(words.first)
    s = K.window_hashes(h, SHINGLE)
    whole = np.flatnonzero(item_of[: len(s)] == item_of[SHINGLE - 1 :]) if len(s) else np.zeros(0, np.int64)
    s, of = s[whole], item_of[whole]
    sums = np.zeros((len(rows), 64), np.int32)
    for x in range(0, len(s), STEP):
        g = of[x : x + STEP]
        cut = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        sums[g[cut]] += np.add.reduceat(_signs(s[x : x + STEP]), cut, axis=0)
    order = np.lexsort((s, of))
    s, of = s[order], of[order]
    cut = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (of[1:] != of[:-1])))) if len(s) else np.zeros(0, np.int64)
    flat, item, each = s[cut], of[cut].astype(np.int32), np.diff(np.append(cut, len(s))).astype(np.int32)
    start = np.searchsorted(item, np.arange(len(rows) + 1))
    short = {}
    for k in range(1, SHINGLE):
        mine = np.flatnonzero(n_words == k)
        if len(mine):
            t = K.window_hashes(h, k)[words.first[mine]]
            by = np.argsort(t, kind="stable")
            short[k] = (t[by], mine[by])
    # an item's shingles, those that the fewest items have first, until so many are taken that one must be in a copy
    _, back, shared = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((flat, shared[back], item)) if len(flat) else np.zeros(0, np.int64)
    before = np.cumsum(each[order]) - each[order]
    first = before[start[:-1][np.diff(start) > 0]] if len(flat) else before
    within = before - np.repeat(first, np.diff(start)[np.diff(start) > 0])
    total = n_words - SHINGLE + 1
    enough = total - np.ceil(SIMILARITY * total - 1e-9).astype(np.int64) + 1  # one more than a copy may lack
    taken = order[within < enough[item[order]]]
    by = taken[np.argsort(flat[taken], kind="stable")]
    rare, bounds = np.unique(flat[by], return_index=True)
    sieve = np.zeros(1 << 20, bool)
    sieve[(rare >> np.uint64(44)).astype(np.int64)] = True
    prints, shingled, tables = _simhash(sums), np.flatnonzero(n_words >= SHINGLE), []
    for b in range(len(RADII)):
        key = (n_words[shingled] << BLOCK) | _block(prints[shingled], b)
        order = np.argsort(key, kind="stable")
        tables.append((key[order], shingled[order].astype(np.int32)))
    ids = pa.array([i for i, _, _ in rows], to_arrow_type(id_type or LongType()))
    return Model(ids, np.array([m for _, _, m in rows], np.int64), n_words, prints, start, flat, each, rare, np.append(bounds, len(by)), item[by], sieve, tables, short)


def _similarity(values: np.ndarray, counts: np.ndarray, total: int, window: np.ndarray) -> float:
    v, c = np.unique(window, return_counts=True)
    at = np.minimum(np.searchsorted(values, v), len(values) - 1)
    both = np.minimum(np.where(values[at] == v, counts[at], 0), c).sum()
    return float(both / (total + len(window) - both))


def _rare_hits(m: Model, s: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where rare shingles stand, and their numbers."""
    maybe = np.flatnonzero(inside & m.sieve[(s >> np.uint64(44)).astype(np.int64)])
    if not len(maybe) or not len(m.rare):
        return maybe[:0], maybe[:0]
    at = np.minimum(np.searchsorted(m.rare, s[maybe]), len(m.rare) - 1)
    same = m.rare[at] == s[maybe]
    return maybe[same], at[same]


def _postings(m: Model, rare: np.ndarray) -> np.ndarray:
    """The distinct items of distinct rare shingles."""
    n = m.rare_start[rare + 1] - m.rare_start[rare]
    return np.unique(m.rare_items[np.repeat(m.rare_start[rare], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])


def _search(m: Model, s: np.ndarray, n_words: int, rare: np.ndarray) -> dict[int, tuple[float, int, int, int]]:
    """The best window for each item in one document: item -> (similarity, -start, words, differing bits). s: its shingles; rare: those that spare windows."""
    best: dict[int, tuple[float, int, int, int]] = {}
    order = np.argsort(s, kind="stable")
    ordered = s[order]

    def places(i: int) -> np.ndarray:
        """Where an item's shingles stand."""
        values = m.values[m.start[i] : m.start[i + 1]]
        lo, hi = np.searchsorted(ordered, values, "left"), np.searchsorted(ordered, values, "right")
        n = hi - lo
        return np.sort(order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])

    spared: dict[int, list[np.ndarray]] = {}  # words of an item -> starts of windows
    for i in _postings(m, np.unique(rare)).tolist():
        total, words = int(m.n_words[i]) - SHINGLE + 1, min(int(m.n_words[i]), n_words)
        w = words - SHINGLE + 1  # shingles of a window
        need = math.ceil(SIMILARITY / (1 + SIMILARITY) * (w + total) - 1e-9)
        p = places(i)
        if len(p) < need:
            continue
        a, b = p[: len(p) - need + 1], p[need - 1 :]
        a, b = a[b - a < w], b[b - a < w]  # a window with `need` of them starts after b - w and at a at the latest
        a, b = np.minimum(a, len(s) - w), np.maximum(b - w + 1, 0)
        b = np.maximum(b, np.concatenate(([0], a[:-1] + 1)))  # both grow, so starts that an earlier range has are left out
        n = np.maximum(a - b + 1, 0)
        start = np.repeat(b, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if len(start):
            spared.setdefault(int(m.n_words[i]), []).append(start)
    for length, starts in spared.items():
        total, words = length - SHINGLE + 1, min(length, n_words)
        w, start = words - SHINGLE + 1, np.unique(np.concatenate(starts))
        which, item, bits = within_radius(m, _window_prints(s, start, w), length)
        items, first = np.unique(item, return_index=True)
        for i, x, y in zip(items.tolist(), first.tolist(), np.append(first[1:], len(item)).tolist()):
            values, counts, p = m.values[m.start[i] : m.start[i + 1]], m.counts[m.start[i] : m.start[i + 1]], places(i)
            at, differ = start[which[x:y]], bits[x:y]
            have = np.minimum(np.searchsorted(p, at + w) - np.searchsorted(p, at), w)
            bound = have / (total + w - have)
            for j in np.lexsort((at, -bound)).tolist():  # best first, until no bound reaches what was found
                if bound[j] < max(SIMILARITY, best[i][0] if i in best else 0.0) - 1e-12:
                    break
                z = int(at[j])
                if i in best and bound[j] <= best[i][0] and z > -best[i][1]:  # as good at most, and later
                    continue
                sim = _similarity(values, counts, total, s[z : z + w])
                if sim >= SIMILARITY:
                    best[i] = max(best.get(i, (0.0, 0, 0, 0)), (sim, -z, words, int(differ[j])))
    return best


def _found(docs: DataFrame, model: Model, id_type: DataType) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "item_id", "first_word", "n_words", "differing_bits", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, offsets = K.string_buffers(batch.column(1))
            row, found = [], []
            for a, b, part, off in K.chunks(raw, offsets):
                words = K.Words(part, off, K.NON_WORD)
                if not len(words):
                    continue
                h = words.hashes(lower=True)
                first = words.first
                s = K.window_hashes(h, SHINGLE)
                doc = K.row_of(first)
                at, rare = _rare_hits(m, s, doc[: len(s)] == doc[SHINGLE - 1 :] if len(s) else np.zeros(0, bool))
                docs_hit, where = np.unique(doc[at], return_index=True)
                for d, x, y in zip(docs_hit.tolist(), where.tolist(), np.append(where[1:], len(at)).tolist()):
                    n = int(first[d + 1] - first[d])
                    for i, (sim, start, w, bits) in _search(m, s[first[d] : first[d + 1] - SHINGLE + 1], n, rare[x:y]).items():
                        row.append(a + d)
                        found.append((i, -start, w, bits, sim))
                for k, (hashes, of) in m.short.items():
                    t = K.window_hashes(h, k)
                    place = np.flatnonzero(np.isin(t, hashes) & (doc[: len(t)] == doc[k - 1 :])) if len(t) else np.zeros(0, np.int64)
                    lo, hi = np.searchsorted(hashes, t[place], "left"), np.searchsorted(hashes, t[place], "right")
                    n = hi - lo
                    item = of[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    p = np.repeat(place, n)
                    for j in np.unique(doc[p] * len(m.ids) + item, return_index=True)[1].tolist():  # the first place of each
                        row.append(a + int(doc[p[j]]))
                        found.append((int(item[j]), int(p[j] - first[doc[p[j]]]), k, 0, 1.0))
            if row:
                item, *columns = (np.array(c) for c in zip(*found))
                often = np.repeat(np.arange(len(row)), m.times[item])  # repeated items each give a row
                types = (pa.int32(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(row)[often])), m.ids.take(pa.array(item[often])), *[pa.array(c[often], t) for c, t in zip(columns, types)]], names)

    schema = StructType([docs.schema["doc_id"]]).add("item_id", id_type).add("first_word", "integer").add("n_words", "integer").add("differing_bits", "integer").add("similarity", "double")
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, differing_bits, similarity): documents that hold a copy of an item.

    A row for each document and item, with the most similar window (of equal ones the first).
    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased.
    Items under five words must occur as they are. Null and empty texts, on either side, match
    nothing; repeated rows and items each give rows; empty tables give none. Ids may be of any
    type that Arrow has.
    """
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").groupBy("item_id", "text").agg(F.count("*").alias("times"))
    chars = items.agg(F.sum(F.length("text") + ITEM_CHARS)).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    kind = benchmark.schema["item_id"].dataType
    out = None
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()  # about block_chars characters
        part = _found(docs, prepare(sorted(((r.item_id, r.text, r.times) for r in rows), key=str), kind), kind)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no copy of an item; columns stay as they are."""
    return without(docs, contaminated(docs, benchmark).select("doc_id"), "doc_id")


def decontaminate_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Like decontaminate(), but rows are decided on by themselves: with a null doc_id, and where others have the same."""
    found = contaminated(docs.select(row_key().alias("doc_id"), "text"), benchmark)
    return without_rows(docs, found.select(F.col("doc_id").alias("key")))
