"""Operator 11: how the tokens of two tokenizers align over a corpus.

A text is cut before single spaces between other characters, where neither tokenizer has a
token across, so a batch's distinct pieces are encoded once. Two tokens are linked if their
byte ranges end together. What a batch of documents links goes out as postings, a row for
each B id: the document, the A id and how often. These are shuffled by B id, dealt over
several cells where an id has many, and each cell's rows come as a sorted stream that Spark
spills as it needs to: first the counts of the id's pairs, summed beforehand where they were
made, from which the id's highest count follows, then its postings. A cell gives out what it
adds to each document, a row a chunk of documents, and these rows, sorted by chunk before its
documents, are summed by document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tessera.llm import kernels as K
from tessera.session import store

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are encoded together; a longer text is taken in parts.
CHUNK = 4 << 20
#: Bytes of pieces that go to an encoder as one string, and the longest piece among them.
ROOM, LONG = 1 << 15, 1_000
#: Postings of a cell; more where an id has many pairs, whose counts each of its cells gets.
CELL = 1 << 16
#: Fixed value: how byte-level vocabularies of this kind cut text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: First bytes of characters that are surely no white space or control characters.
_SOLID = np.zeros(256, bool)
_SOLID[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True


def _byte_alphabet() -> dict[str, int]:
    """Character to byte in byte-level vocabularies: visible Latin-1 characters stand for themselves, other bytes for 256 and up, in order."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in visible]
    return {**{chr(b): b for b in visible}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Tokenizers:
    """Both tokenizers with the bytes of each id. A task's Python process loads them once."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(a_path)
        self.whole.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = _byte_alphabet()
        special = {t["content"] for t in spec["added_tokens"]}
        vocab = {token: i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.a_bytes = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letter[c] for c in token)
        plain = {b: i for i, b in enumerate(self.a_bytes) if b}
        # ids in the order of the merges are ranks, for which there is a faster encoder
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ranked = [vocab.get(x + y) for x, y in merges] == list(range(256, 256 + len(merges)))
        pre = spec["pre_tokenizer"] or {}
        self.cuts = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and bool(pre.get("use_regex")) and spec["normalizer"] is None
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={}) if ranked and self.cuts else None
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = [self.pieces.id_to_piece(i) for i in range(len(self.pieces))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.cuts = self.cuts and not any("▁" in p.lstrip("▁") for p in names)
        if not all(self.b_bytes):
            raise ValueError(f"{b_path} has a token without bytes")
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        text = lambda n, end: np.array([f"{i}{end}".encode() for i in range(n)], object)
        self.a_text, self.b_text = ([text(n, e) for e in ends] for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The A and B ids of texts that each begin with a space."""
        if self.fast:  # its pattern matcher has a bounded stack
            a = [self.fast.encode_ordinary(t) if len(t) <= 2 * ROOM else self.whole.encode(t, add_special_tokens=False).ids for t in texts]
        else:
            a = [self.whole.encode(t, add_special_tokens=False).ids for t in texts]
        return a, self.pieces.encode([t[1:] for t in texts], num_threads=1)


@dataclass
class Pieces:
    """What the tokenizers make of each of some pieces of text."""

    ok: np.ndarray  # the tokens' bytes are the piece's
    n_a: np.ndarray
    n_b: np.ndarray
    first: np.ndarray  # n+1 places in a and b
    a: np.ndarray  # linked ids
    b: np.ndarray
    groups: np.ndarray  # as text, each group with a semicolon


def cuts(raw: np.ndarray) -> np.ndarray:
    """Where a space stands between characters that are no white space; in UTF-8 bytes."""
    at = np.flatnonzero(raw[1:-1] == 0x20) + 1
    at = at[_SOLID[raw[at + 1]]]
    lead, back = raw[at - 1], 1
    while back < 4:  # to the first byte of the character before
        back += 1
        inner = (lead & 0xC0) == 0x80
        lead = np.where(inner, raw[np.maximum(at - back, 0)], lead)
    return at[_SOLID[lead]]


def spell(t: Tokenizers, raw: bytes, offsets: np.ndarray) -> Pieces:
    """Both tokenizers over pieces of text, each of which begins with a space."""
    n = len(offsets) - 1
    flat = np.frombuffer(raw, np.uint8)
    size = np.diff(offsets)
    # pieces that begin and end as those between two cuts may stand beside others
    alone = np.ones(n, bool)
    inner = np.flatnonzero((size > 1) & (size <= LONG)) if t.cuts else np.zeros(0, np.int64)
    lead = flat[offsets[1:][inner] - 1]
    for back in range(2, 5):
        lead = np.where((lead & 0xC0) == 0x80, flat[np.maximum(offsets[1:][inner] - back, 0)], lead)
    alone[inner] = ~(_SOLID[flat[offsets[:-1][inner] + 1]] & _SOLID[lead])
    starts = alone.copy()
    starts[1:] |= alone[:-1] | (np.diff(offsets[:-1] // ROOM) > 0)
    if n:
        starts[0] = True
    head = np.flatnonzero(starts)
    tail = np.append(head[1:], n)
    texts = [raw[offsets[i] : offsets[j]] for i, j in zip(head.tolist(), tail.tolist())]
    a, b = t.encode([x.decode("utf-8", "replace") for x in texts])
    same = lambda ids, table, text: b"".join([table[i] for i in ids]) == text
    right = [same(x, t.a_bytes, s) and same(y, t.b_bytes, s) for x, y, s in zip(a, b, texts)]
    if not all(right):  # a string of pieces that has a wrong one is taken apart
        more = [(i, i + 1) for k, r in enumerate(right) if not r and tail[k] - head[k] > 1 for i in range(head[k], tail[k])]
        singles = [raw[offsets[i] : offsets[j]] for i, j in more]
        x, y = t.encode([s.decode("utf-8", "replace") for s in singles])
        good = [same(p, t.a_bytes, s) and same(q, t.b_bytes, s) for p, q, s in zip(x, y, singles)]
        keep = sorted([(int(head[k]), int(tail[k]), a[k], b[k]) for k, r in enumerate(right) if r] + [(i, j, p, q) for (i, j), p, q, g in zip(more, x, y, good) if g], key=lambda r: r[:2])
        ok = np.zeros(n, bool)
        for i, j, _, _ in keep:
            ok[i:j] = True
        a, b = [r[2] for r in keep], [r[3] for r in keep]
    else:
        ok = np.ones(n, bool)
    ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int32) for x in (a, b))
    end_a, end_b = np.cumsum(t.a_size[ids_a]), np.cumsum(t.b_size[ids_b])
    bound = np.cumsum(size[ok])  # ends of the pieces that are right, one after the other
    total = int(bound[-1]) if len(bound) else 0
    is_a, is_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    is_a[end_a], is_b[end_b] = True, True
    if not (is_a[bound] & is_b[bound]).all():
        raise RuntimeError("a token stands across a cut")
    both_a, both_b = np.flatnonzero(is_b[end_a]), np.flatnonzero(is_a[end_b])  # last tokens of groups
    full = np.flatnonzero(ok)
    count = lambda ends: np.bincount(full[np.searchsorted(bound, ends)], minlength=n) if len(ends) else np.zeros(n, np.int64)
    n_links = count(end_a[both_a])
    # the groups' text: the A tokens of a group, then its B tokens
    group_a, group_b = np.searchsorted(both_a, np.arange(len(ids_a))), np.searchsorted(both_b, np.arange(len(ids_b)))
    items = np.empty(len(ids_a) + len(ids_b), object)
    before = np.append(0, both_b + 1)[group_a]
    last_a, last_b = is_b[end_a], is_a[end_b]
    items[np.arange(len(ids_a)) + before] = np.where(last_a, t.a_text[1][ids_a], t.a_text[0][ids_a])
    items[np.arange(len(ids_b)) + both_a[group_b] + 1 if len(ids_b) else np.zeros(0, np.int64)] = np.where(last_b, t.b_text[1][ids_b], t.b_text[0][ids_b])
    n_a, n_b = count(end_a), count(end_b)
    at = np.append(0, np.cumsum(n_a + n_b)).tolist()
    listed = items.tolist()
    groups = np.empty(n, object)
    groups[:] = [b"".join(listed[i:j]) for i, j in zip(at, at[1:])]
    return Pieces(ok, n_a, n_b, np.append(0, np.cumsum(n_links)), ids_a[both_a], ids_b[both_b], groups)


def _parts(raw: np.ndarray, at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of pieces of at most `most` bytes, one piece at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1))
        yield i, j
        i = j


def _linked(p: Pieces, piece: np.ndarray, row: np.ndarray) -> dict[str, pa.Array]:
    """Postings by B id of pieces with their rows (rows without tokens left out): for each id the A ids met, their links, and per posting the A id's place, row and links."""
    key, times = np.unique(row.astype(np.int64) * (len(p.ok) + 1) + piece, return_counts=True)
    row, piece = key // (len(p.ok) + 1), key % (len(p.ok) + 1)
    pairs, code = np.unique(p.b.astype(np.int64) << 32 | p.a, return_inverse=True)
    n = np.diff(p.first)[piece]
    link = np.arange(n.sum()) + np.repeat(p.first[:-1][piece] - (np.cumsum(n) - n), n)
    rows = int(row.max(initial=0)) + 1
    key = code[link] * rows + np.repeat(row, n)
    order = np.argsort(key, kind="stable")
    key, times = key[order], np.repeat(times, n)[order]
    new = np.flatnonzero(np.diff(key, prepend=-1))
    m = np.add.reduceat(times, new) if len(new) else np.zeros(0, np.int64)
    code, doc = key[new] // rows, key[new] % rows
    used, first, place = np.unique(code, return_index=True, return_inverse=True)  # pairs
    met = pairs[used]
    links = np.add.reduceat(m, first) if len(first) else m
    b, begin = np.unique(met >> 32, return_index=True)
    bounds = np.append(begin, len(met)).astype(np.int32)
    post = np.append(first, len(code))[bounds].astype(np.int32)
    lists = lambda off, x: pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x, pa.int32()))
    return {"b": pa.array(b, pa.int32()), "a": lists(bounds, met & 0xFFFFFFFF), "n": lists(bounds, links), "at": lists(post, place - np.repeat(bounds[:-1], np.diff(post))), "docs": lists(post, doc), "m": lists(post, m)}


_ROWS = [("doc", "integer"), ("n_a", "long"), ("n_b", "long"), ("n_groups", "long"), ("groups_sha256", "string")]
_POSTS = [("b", "integer"), *[(c, ArrayType(IntegerType())) for c in ("a", "n", "at", "docs", "m")]]
_LOADED: dict[tuple[str, str], Tokenizers] = {}


def _load(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _LOADED:
        _LOADED[a_path, b_path] = Tokenizers(a_path, b_path)
    return _LOADED[a_path, b_path]


def encoded(docs: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str, chunk: int = CHUNK) -> DataFrame:
    """Two kinds of rows by (chunk, doc): a document's own figures (b is null), and postings of a B id in a chunk."""
    kept = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = StructType().add("chunk", "long").add("id", kept.schema["id"].dataType)
    for name, kind in _ROWS + _POSTS:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, number = _load(a_path, b_path), TaskContext.get().partitionId() << 33
        kinds = {"chunk": pa.int64(), "id": None, "doc": pa.int32(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups_sha256": pa.string(), "b": pa.int32(), **{k: pa.list_(pa.int32()) for k in ("a", "n", "at", "docs", "m")}}

        def rows(cols: dict[str, pa.Array], n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([cols[f] if f in cols else pa.nulls(n, k) for f, k in kinds.items()], list(kinds))

        for batch in batches:
            kinds["id"] = batch.schema.field(0).type
            raw, offsets = K.string_buffers(batch.column(1))
            for x, y, part, off in K.chunks(raw, offsets, chunk):
                number += 1
                figures, posts = _chunk(t, part, off, chunk)
                n = y - x
                yield rows({"chunk": pa.array(np.full(n, number)), "id": batch.column(0)[x:y], "doc": pa.array(np.arange(n), pa.int32()), **figures}, n)
                for p in posts:
                    k = len(p["b"])
                    yield rows({"chunk": pa.array(np.full(k, number)), **p}, k)

    return kept.mapInArrow(run, schema)


def _chunk(t: Tokenizers, raw: np.ndarray, offsets: np.ndarray, most: int) -> tuple[dict[str, pa.Array], list[dict[str, pa.Array]]]:
    """The rows' own figures, and the postings, of some texts: taken together or, one long text, in parts."""
    n = len(offsets) - 1
    filled = np.flatnonzero(np.diff(offsets) > 0)
    at = offsets[:-1][filled] - offsets[0]
    raw = np.insert(raw, at, 0x20)
    starts = at + np.arange(len(filled))  # each text now begins with a space
    bounds = np.unique(np.concatenate((starts, cuts(raw) if t.cuts and len(raw) > 2 else starts[:0]))).astype(np.int64)
    row = filled[np.searchsorted(starts, bounds, "right") - 1] if len(filled) else bounds
    bounds = np.append(bounds, len(raw)).astype(np.int64)
    parts = list(_parts(raw, bounds, 2 * most))
    sums, sha, bad = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups")}, {}, np.zeros(n, bool)
    posts = []

    def pieces(i: int, j: int) -> tuple[Pieces, np.ndarray]:
        offs = (bounds[i : j + 1] - bounds[i]).astype(np.int64)
        text = raw[bounds[i] : bounds[j]]
        column = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(text))]).dictionary_encode()
        own = column.dictionary
        own_off = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
        body = own.buffers()[2].to_pybytes() if len(own) else b""
        return spell(t, body[own_off[0] : own_off[-1]], own_off - own_off[0]), column.indices.to_numpy(zero_copy_only=False)

    if len(parts) > 1:  # whether a text has tokens at all shows at its end
        for i, j in parts:
            p, which = pieces(i, j)
            bad[row[i:j][~p.ok[which]]] = True
    for i, j in parts:
        p, which = pieces(i, j)
        r = row[i:j]
        bad[r[~p.ok[which]]] = True
        good = ~bad[r]
        which, r = which[good], r[good]
        for k, x in (("n_a", p.n_a), ("n_b", p.n_b), ("n_groups", np.diff(p.first))):
            np.add.at(sums[k], r, x[which])
        edge = np.flatnonzero(np.diff(r, prepend=-1, append=-1))
        said = p.groups[which].tolist()
        for x, y in zip(edge.tolist(), edge[1:].tolist()):
            sha.setdefault(int(r[x]), [sha256(), b""])
            h = sha[int(r[x])]
            h[0].update(h[1])
            text = b"".join(said[x:y])
            h[0].update(text[:-1])
            h[1] = text[-1:]  # the last semicolon only if more follows
        if len(r):
            posts.append(_linked(p, which, r))
    hexes = [sha[i][0].hexdigest() if i in sha else "" for i in range(n)]
    return {**{k: pa.array(v) for k, v in sums.items()}, "groups_sha256": pa.array(hexes, pa.string())}, posts


def _cogroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of cells: an id's counts, then its postings, whose documents get the sums of their links' counts."""
    cell = counts = ids = None
    top = 0
    for batch in batches:
        flat = lambda i: (np.asarray(batch.column(i).flatten()), np.append(0, np.cumsum(np.asarray(batch.column(i).value_lengths().fill_null(0)))).tolist())  # noqa: B023, E731
        b, salt, tag, chunk = (np.asarray(batch.column(i)).tolist() for i in range(4))
        (a, a_at), (n, n_at), (at, at_at), (docs, _), (m, _) = (flat(i) for i in range(4, 9))
        total, best, who = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        for i in range(len(b)):
            if tag[i] == 0:
                cell, ids, counts = (b[i], salt[i]), a[a_at[i] : a_at[i + 1]], n[n_at[i] : n_at[i + 1]].astype(np.int64)
                top = int(counts.max())
                continue
            if (b[i], salt[i]) != cell:
                raise RuntimeError("postings without the counts of their pairs")
            x, y = at_at[i], at_at[i + 1]
            count = counts[np.searchsorted(ids, a[a_at[i] : a_at[i + 1]])][at[x:y]]
            total[x:y], best[x:y], who[x:y] = count * m[x:y], np.where(count == top, m[x:y], 0), chunk[i]
        if not len(docs):
            continue
        chunks, place = np.unique(who, return_inverse=True)
        key = place.astype(np.int64) << 32 | docs
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        bounds = np.append(np.searchsorted(key[new] >> 32, np.arange(len(chunks))), len(new))
        lists = lambda x, kind: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, kind))  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays([pa.array(chunks), lists(key[new] & 0xFFFFFFFF, pa.int32()), lists(np.add.reduceat(best[order], new), pa.int64()), lists(np.add.reduceat(total[order], new), pa.int64())], ["chunk", "docs", "best", "total"])


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of chunks: what cells add to a chunk's documents, then the documents, which get their sums."""
    now, held = None, np.zeros((2, 0), np.int64)
    for batch in batches:
        chunk, tag, doc = (np.asarray(batch.column(i).fill_null(0)) for i in range(3))
        docs, best, total = (np.asarray(batch.column(i).flatten()) for i in range(8, 11))
        at = np.append(0, np.cumsum(np.asarray(batch.column(8).value_lengths().fill_null(0))))
        sums = np.zeros((2, len(chunk)), np.int64)
        edge = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)] if len(chunk) else []
        for x, y in zip(edge, edge[1:]):
            if chunk[x] != now:
                now, held = chunk[x], np.zeros((2, 0), np.int64)
            cut = x + int(np.searchsorted(tag[x:y], 1))
            i, j = at[x], at[cut]
            if j > i:
                more = int(docs[i:j].max()) + 1 - held.shape[1]
                held = np.pad(held, ((0, 0), (0, max(0, more))))
                np.add.at(held[0], docs[i:j], best[i:j])
                np.add.at(held[1], docs[i:j], total[i:j])
            known = cut + np.flatnonzero(doc[cut:y] < held.shape[1])
            sums[:, known] = held[:, doc[known]]
        own = pa.array(np.flatnonzero(tag == 1))
        row = [batch.column(i).take(own) for i in range(3, 8)]
        yield pa.RecordBatch.from_arrays([*row, *[pa.array(s).take(own) for s in sums]], ["id", "n_a", "n_b", "n_groups", "groups_sha256", "n_best", "count_sum"])


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = f"{TOKENIZERS}/{A_FILE}", b_path: str = f"{TOKENIZERS}/{B_FILE}", chunk: int = CHUNK) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row of docs each.

    A text is encoded whole, with a space before it. Null and empty texts, and those that
    a tokenizer doesn't give back byte for byte, have no tokens: zeros and an empty digest.
    Rows are told apart by their place, so repeated ids and texts, and null ids, each count
    and give a row; an empty table stays empty; other columns don't count. A text of over
    `chunk` bytes is taken in parts between its cuts; one without a cut is one piece.
    The tokenizer files must lie at the same path on every machine.
    """
    all_rows = store(encoded(docs, id_col, text_col, a_path, b_path, chunk))
    posts = all_rows.where("b IS NOT NULL").select("chunk", *[c for c, _ in _POSTS])
    counts = posts.select("b", F.inline(F.arrays_zip("a", "n"))).groupBy("b", "a").agg(F.sum("n").alias("n"))
    # a row for each B id with at most as many pairs as A has ids; its size in postings decides on its cells
    size = posts.groupBy("b").agg(F.sum(F.size("docs")).alias("posts"))
    of = counts.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("a", "n"))).alias("pairs")).join(size, "b")
    cells = F.ceil(F.col("posts") / F.greatest(F.lit(CELL), 4 * F.size("pairs"))).cast("int")
    of = store(of.select("b", cells.alias("cells"), F.col("pairs.a").alias("a"), F.col("pairs.n").alias("n")))
    none = F.lit(None).cast("array<int>")
    first = of.select("b", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("salt"), F.lit(0).alias("tag"), F.lit(-1).cast("long").alias("chunk"), "a", "n", none.alias("at"), none.alias("docs"), none.alias("m"))
    dealt = F.pmod(F.xxhash64("chunk"), F.col("cells")).cast("int")
    then = posts.join(F.broadcast(of.select("b", "cells")), "b")  # a vocabulary's ids, two numbers each
    then = then.select("b", dealt.alias("salt"), F.lit(1).alias("tag"), "chunk", "a", F.lit(None).cast("array<long>").alias("n"), "at", "docs", "m")
    stream = first.unionByName(then).repartition("b", "salt").sortWithinPartitions("b", "salt", "tag", "chunk")
    parts = stream.mapInArrow(_cogroup, "chunk long, docs array<int>, best array<long>, total array<long>")
    own = all_rows.where("b IS NULL").select("chunk", F.lit(1).alias("tag"), "doc", "id", "n_a", "n_b", "n_groups", "groups_sha256")
    rows = own.unionByName(parts.withColumn("tag", F.lit(0)), allowMissingColumns=True).repartition("chunk").sortWithinPartitions("chunk", "tag", "doc")
    schema = StructType([f for f in own.schema.fields if f.name not in ("chunk", "tag", "doc")]).add("n_best", "long").add("count_sum", "long")
    out = rows.mapInArrow(_by_document, schema)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
