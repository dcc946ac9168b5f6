"""Operator 13: base spans against the contract's patterns taken literally; checks, context and edge rows."""

import random
import re
import time
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import pii as P
from tessera.llm.queries import op13_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def right(kind, s):
    digits = [int(c) for c in s if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    """(kind, start, end) of the base kinds."""
    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if right(k, m.group())]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def joined(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def base(text):
    return [(P.KINDS[k], a, b) for a, k, b, _ in P.spans(text)[0] if k < 4]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op13_pii(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r.doc_id])
        kinds = [k for k, _, _ in want]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in P.BASE]
        assert r.base_sha256 == sha256(joined(want).encode()).hexdigest()
        assert set(filter(None, joined(want).split(","))) <= set(r.spans.split(","))
    assert all(sum(r[f"n_{k}"] for r in got) for k in P.BASE)


@settings(max_examples=3_000, deadline=None)
@given(st.text(alphabet="ab9.1025+-@ ()_%é\n3", max_size=60))
def test_scans_are_the_patterns(text):
    assert base(text) == plain(text)


def test_numbers_of_all_lengths():
    rnd = random.Random(2)
    for _ in range(3_000):
        text = "".join(rnd.choice(["4111111111111111", "+44 20 7946 0958", "10.0.0.1", "1", "25", "6", "0", " ", "-", ".", "x", "a@b.co", "0000", "5500 0000 0000 0004"]) for _ in range(rnd.randrange(1, 12)))
        assert base(text) == plain(text)


def test_checks_and_context():
    kinds = lambda text: [P.KINDS[k] for _, k, _, _ in P.spans(text)[0]]
    score = lambda text: P.spans(text)[0][0][3]
    assert kinds("pay to GB82 WEST 1234 5698 7654 32 now") == ["iban"] and kinds("pay to GB82WEST12345698765431 now") == []
    assert kinds("her social security number is 123-45-6789.") == ["national_id"] and kinds("part 123-45-6789") == []
    assert score("card 4111 1111 1111 1111") > score("4111 1111 1111 1111") > score("order 4111 1111 1111 1111")
    assert score("call +44 20 7946 0958") > score("+44 20 7946 0958") > score("version +44 20 7946 0958")
    assert kinds("serial 4111 1111 1111 1111 isbn") == ["card"]  # base spans stay


def test_long_texts_take_linear_time():
    size = 1_000_000
    for bit in ("a", "1", "1.", "a@", "+1", "1 ", "1-", ".", "@", "a.", "AB12", "+1(", "1.1.1.1", "9 9", "ab@cd.", "A1 "):
        began = time.process_time()
        P.spans(bit * (size // len(bit)))
        assert time.process_time() - began < 20, bit


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "é😀 a@b.co"), (3, "é😀 a@b.co"), (None, "1.2.3.4")]
    df = spark.createDataFrame([(i, t, "s", 5, "f") for i, t in rows], "doc_id long, text string, spans string, n_email int, found string")
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.spans) for r in P.find(df).collect()), key=str)
    assert got == sorted([(1, 0, 0, ""), (2, 0, 0, ""), (3, 1, 0, "email:3:9"), (3, 1, 0, "email:3:9"), (None, 0, 1, "ip:0:7")], key=str)
    assert P.find(df.limit(0)).count() == 0
    found = P.find(df).where("doc_id IS NULL").first().found
    assert [(f.kind, f.start, f.end) for f in found] == [("ip", 0, 7)]
