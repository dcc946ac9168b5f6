"""Vectorised text kernels over Arrow buffers, run inside Arrow-batched workers.

A batch of texts is one UTF-8 byte buffer with row offsets. Words are runs of bytes that a
256-entry table does not call separators; all separators are ASCII, so byte runs are code
point runs. Hashes are chains, trees or sums of avalanche steps, never polynomials, so no
arrangement of bytes or words cancels out: words of up to eight bytes and one length never
collide, others only by chance. Where a hash alone decides what is equal, digests() of the
bytes are taken instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)
#: Longer words are hashed by XXH64, one by one.
LONG_WORD = 256
#: Keep the first n bytes of eight.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_PLACES: list[np.ndarray] = []

#: ASCII blanks: space and 0x09-0x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters, digits and non-ASCII bytes.
NON_WORD = np.ones(256, bool)
NON_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit avalanche step, elementwise."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(33))
        x = x * U64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> U64(33))
        x = x * U64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> U64(33))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 row offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def chunks(raw: np.ndarray, offsets: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most `most` bytes (one row at least): first row, last row, bytes, offsets from 0."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


class Words:
    """The words of a chunk: byte starts and ends, and for each row its first and last word number."""

    __slots__ = ("raw", "starts", "ends", "first")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        self.raw = raw
        w = ~separators[raw]
        before, after = np.empty(len(w), bool), np.empty(len(w), bool)
        if len(w):
            before[0], before[1:] = False, w[:-1]
            after[-1], after[:-1] = False, w[1:]
            inner = offsets[(offsets > 0) & (offsets < len(w))]
            before[inner] = False  # a row's first byte continues no word
            after[inner - 1] = False
        self.starts = np.flatnonzero(w & ~before)
        self.ends = np.flatnonzero(w & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)  # n+1 word numbers

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        """A 64-bit hash for each word; other seeds give independent ones."""
        return self.span_hashes([(self.starts, self.ends)], lower, seed)[0]

    def span_hashes(self, spans: list[tuple[np.ndarray, np.ndarray]], lower: bool = False, seed: int = 0) -> list[np.ndarray]:
        """64-bit hashes of byte spans, given as arrays of starts and ends; equal bytes, equal hashes."""
        n = len(self.raw)
        padded = np.zeros(n + 8, np.uint8)
        padded[:n] = LOWER[self.raw] if lower else self.raw
        eight = np.ndarray(n + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place
        return [_chain(padded, eight, a, b - a, seed) for a, b in spans]

    def joined(self, lower: bool = False, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words (those of the mask `keep`) one space apart, as bytes, with each word's new start and end."""
        starts, ends = (self.starts, self.ends) if keep is None else (self.starts[keep], self.ends[keep])
        lens = ends - starts
        before = np.cumsum(lens) - lens  # bytes of the words before
        new = before + np.arange(len(lens))
        out = np.full(int(lens.sum()) + len(lens), 0x20, np.uint8)
        at = np.arange(int(lens.sum()))
        src = self.raw[at + np.repeat(starts - before, lens)]
        out[at + np.repeat(new - before, lens)] = LOWER[src] if lower else src
        return out.tobytes(), new, new + lens


def _chain(raw: np.ndarray, eight: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """Eight bytes after the other are mixed into a state that begins with the length."""
    with np.errstate(over="ignore"):
        h = mix((length.astype(np.uint64) + U64(seed << 40)) * _ODD) ^ (eight[start] & _KEEP[np.minimum(length, 8)])
        h = mix(h)
        todo, at = np.flatnonzero((length > 8) & (length <= LONG_WORD)), 8
        while len(todo):
            rest = length[todo] - at
            h[todo] = mix(h[todo] ^ (eight[start[todo] + at] & _KEEP[np.minimum(rest, 8)]))
            todo, at = todo[rest > 8], at + 8
        for i in np.flatnonzero(length > LONG_WORD).tolist():
            h[i] = xxhash.xxh64_intdigest(raw[start[i] : start[i] + length[i]].tobytes(), seed)
    return h


_P1, _P2, _P3, _P4, _P5 = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Longer spans are hashed one by one.
LONG_SPAN = 1024


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def _lane(acc: np.ndarray | np.uint64, x: np.ndarray) -> np.ndarray:
    return _turn(acc + x * _P2, 31) * _P1


def xxh64(text: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 0) -> np.ndarray:
    """The XXH64 of byte spans, as the algorithm is published, all spans a step at a time."""
    n, seed_ = len(text), U64(seed)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = text
    eight = np.ndarray(n + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place
    with np.errstate(over="ignore"):
        h, at = length.astype(np.uint64) + (seed_ + _P5), np.zeros(len(start), np.int64)
        long = np.flatnonzero((length >= 32) & (length <= LONG_SPAN))
        if len(long):
            acc = [np.full(len(long), seed_ + x) for x in (_P1 + _P2, _P2, U64(0), U64(0) - _P1)]
            go, s, rest, pos = np.arange(len(long)), start[long], length[long], 0
            while len(go):
                for j in range(4):
                    acc[j][go] = _lane(acc[j][go], eight[s[go] + (pos + 8 * j)])
                pos += 32
                go = go[rest[go] - pos >= 32]
            g = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for j in range(4):
                g = (g ^ _lane(U64(0), acc[j])) * _P1 + _P4
            h[long], at[long] = g + rest.astype(np.uint64), rest // 32 * 32
        go = np.flatnonzero((length - at >= 8) & (length <= LONG_SPAN))
        while len(go):
            h[go] = _turn(h[go] ^ _lane(U64(0), eight[start[go] + at[go]]), 27) * _P1 + _P4
            at[go] += 8
            go = go[length[go] - at[go] >= 8]
        go = np.flatnonzero((length - at >= 4) & (length <= LONG_SPAN))
        h[go] = _turn(h[go] ^ ((eight[start[go] + at[go]] & _KEEP[4]) * _P1), 23) * _P2 + _P3
        at[go] += 4
        go = np.flatnonzero((length > at) & (length <= LONG_SPAN))
        while len(go):
            h[go] = _turn(h[go] ^ (padded[start[go] + at[go]].astype(np.uint64) * _P5), 11) * _P1
            at[go] += 1
            go = go[length[go] > at[go]]
        h = (h ^ (h >> U64(33))) * _P2
        h = (h ^ (h >> U64(29))) * _P3
        h = h ^ (h >> U64(32))
    for i in np.flatnonzero(length > LONG_SPAN).tolist():
        h[i] = xxhash.xxh64_intdigest(text[start[i] : start[i] + length[i]].tobytes(), seed)
    return h


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair of neighbouring sequences, of theirs."""
    with np.errstate(over="ignore"):
        return mix(a * _ODD + b)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes (len(h)-k+1 of them, over row bounds too), as a tree of halves."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    out, done, size = None, 0, 1
    while True:
        if k & size:  # h: of the `size` words from each place; out: of the `done` words
            out = h if out is None else join_hashes(out[: n - done - size + 1], h[done:])
            done += size
        if done == k:
            return out
        h, size = join_hashes(h[:-size], h[size:]), 2 * size


def placed(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Word hashes tied to places; their sum over a range is a hash of the sequence."""
    most = int(place.max(initial=0)) + 1
    if not _PLACES or len(_PLACES[0]) < most:
        with np.errstate(over="ignore"):
            _PLACES[:] = [mix((np.arange(1 << max(12, most.bit_length()), dtype=np.uint64) + U64(1)) * _ODD)]
    return mix(h ^ _PLACES[0][place])


def prefix_sums(x: np.ndarray) -> np.ndarray:
    """len(x)+1 running sums modulo 2**64, from 0."""
    c = np.zeros(len(x) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(x, out=c[1:])
    return c


def digests(text: bytes, start: list[int], end: list[int]) -> tuple[pa.Array, np.ndarray]:
    """128-bit BLAKE2b digests of spans of the text, as a binary column and as rows of two numbers: collision-resistant, so one digest means the same bytes."""
    joined = b"".join([blake2b(text[i:j], digest_size=16).digest() for i, j in zip(start, end)])
    column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(start), [None, pa.py_buffer(joined)])
    return column.cast(pa.binary()), np.frombuffer(joined, np.uint64).reshape(-1, 2)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each word, from the rows' first word numbers."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.flags["C_CONTIGUOUS"] else np.ascontiguousarray(x).view(np.int64)
