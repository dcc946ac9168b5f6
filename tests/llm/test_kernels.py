"""The kernels against plain forms of what they compute."""

import random
from hashlib import blake2b

import numpy as np
import xxhash

from tessera.llm import kernels as K

M = (1 << 64) - 1


def plain_mix(x):
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        x = (x ^ x >> shift) * factor & M
    return x


def plain_hash(word, seed=0):
    if len(word) > K.LONG_WORD:
        return xxhash.xxh64_intdigest(word, seed)
    h = plain_mix((len(word) + (seed << 40)) * 0x9E3779B97F4A7C15 & M)
    for i in range(0, max(1, len(word)), 8):
        h = plain_mix(h ^ int.from_bytes(word[i : i + 8], "little"))
    return h


def words_of(text):
    return K.Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]), K.BLANK)


def test_word_hashes():
    rnd = random.Random(1)
    words = [bytes(rnd.choice(b"abAB\xc3\xa9") for _ in range(n)) for n in [*range(1, 40), 255, 256, 257, 5000] for _ in range(3)]
    got = words_of(b" ".join(words))
    for seed in (0, 1):
        assert got.hashes(seed=seed).tolist() == [plain_hash(w, seed) for w in words]
    assert got.hashes(lower=True).tolist() == [plain_hash(w.replace(b"A", b"a").replace(b"B", b"b")) for w in words]


def turned(n, a, b):
    return [a if bin(i).count("1") % 2 == 0 else b for i in range(n)]


def test_contrived_sequences_get_hashes_of_their_own():
    for n in (64, 256, 1024, 4096):
        texts = [b"".join(turned(n, x, y)) for x, y in ((b"a", b"b"), (b"b", b"a"))]
        assert len(set(words_of(b" ".join(texts)).hashes().tolist())) == 2
        h = [words_of(b" ".join(turned(n, x, y))).hashes() for x, y in ((b"no", b"yes"), (b"yes", b"no"))]
        assert K.window_hashes(h[0], n)[0] != K.window_hashes(h[1], n)[0]
        place = np.arange(n)
        assert K.prefix_sums(K.placed(h[0], place))[-1] != K.prefix_sums(K.placed(h[1], place))[-1]


def test_windows_and_places():
    h = words_of(b" ".join(b"w%d" % (i % 7) for i in range(60))).hashes()
    for k in (1, 2, 5, 6, 8, 35, 60, 61):
        got = K.window_hashes(h, k)
        want = [tuple(h[i : i + k].tolist()) for i in range(len(h) - k + 1)]
        assert len(got) == len(want) and len(set(got.tolist())) == len(set(want))
        assert {w: g for w, g in zip(want, got.tolist())} == dict(zip(want, got.tolist()))
    assert K.placed(h, np.zeros(60, np.int64))[7] == K.placed(h, np.zeros(60, np.int64))[0] != K.placed(h, np.ones(60, np.int64))[0]


def test_xxh64_is_the_published_one():
    rnd = random.Random(2)
    raw = bytes(rnd.randrange(256) for _ in range(9000))
    spans = [(rnd.randrange(4000), n) for n in [*range(0, 140), 1000, 1023, 1024, 1025, 4999] for _ in range(2)]
    start, length = (np.array(x, np.int64) for x in zip(*spans))
    for seed in (0, 42):
        assert K.xxh64(np.frombuffer(raw, np.uint8), start, length, seed).tolist() == [xxhash.xxh64_intdigest(raw[i : i + n], seed) for i, n in spans]


def test_digests():
    column, rows = K.digests(b"one two", [0, 4, 0], [3, 7, 7])
    want = [blake2b(x, digest_size=16).digest() for x in (b"one", b"two", b"one two")]
    assert column.to_pylist() == want and [r.tobytes() for r in rows] == want
    assert len(K.digests(b"", [], [])[0]) == 0
