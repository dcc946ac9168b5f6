"""Operator 13: personal data. Patterns propose spans, checksums confirm them, words nearby move their score.

All patterns are scanned in linear time, whatever the text: the base ones are written as runs
that can't overlap instead of as patterns that begin anew at each character.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

KINDS = ("email", "ip", "card", "phone", "iban", "national_id")
BASE = KINDS[:4]
#: Added spans count from this score on; base ones always do.
THRESHOLD = 0.5
#: Characters before and after a span that words are looked for in.
NEAR = 40

# Words that speak for a kind, and for numbers that are no personal data.
FOR = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login", "adresse", "dirección"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "tarjeta", "carte", "karte", "cvv", "expires"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "whatsapp", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte", "bic", "swift", "transfer"),
    "national_id": ("ssn", "social", "security", "identity", "passport", "taxpayer", "national"),
}
AGAINST = ("version", "isbn", "issn", "order", "invoice", "serial", "part", "doi", "example", "test", "build", "release")

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    """The check digit of card numbers: every second digit from the right is doubled, its digits summed."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    """The check of account numbers: rotated by four, letters as numbers from 10, the remainder by 97 is 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A span has one @; before it stands the run of name characters that ends there, and no span reaches into it."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        name = len(before) - len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if name else None
        if found:
            yield at - name, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four at a time of the numbers that single dots join; four with a part over 255 give none."""
    for run in _DOTTED.finditer(text):
        if run.end() - run.start() < 7:
            continue
        at, parts = run.start(), run.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(v := p.lstrip("0")) < 3 or (len(v) == 3 and v <= "255") for p in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    """Digits that stand together or one blank or hyphen apart, 12 to 19 of them with a right check digit."""
    for run in _DIGITS.finditer(text):
        if 12 <= run.end() - run.start() <= 37 and 12 <= len(d := _digits(run.group())) <= 19 and luhn(d):
            yield run.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def _added(text: str) -> Iterator[tuple[str, int, int, bool]]:
    for m in _IBAN.finditer(text):
        yield "iban", *m.span(), mod97(m.group().replace(" ", ""))
    for m in _NATIONAL.finditer(text):
        yield "national_id", *m.span(), False


def score(text: str, kind: str, start: int, end: int, checked: bool) -> float:
    """0.85 if a checksum holds or the form alone tells (email), else 0.45; 0.3 more for a word nearby that speaks for it, 0.3 less for one against."""
    near = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR])}
    value = 0.85 if checked or kind in ("email", "card") else 0.45
    return round(min(1.0, max(0.0, value + 0.3 * any(w in near for w in FOR[kind]) - 0.3 * any(w in near for w in AGAINST))), 2)


def spans(text: str) -> tuple[list[tuple[int, int, int, float]], int]:
    """(start, kind number, end, score) of all spans of a text, sorted, and how many of them are of the base kinds."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    found += [(a, 1, b) for a, b in addresses(text)] + [(a, 2, b) for a, b in cards(text)]
    if "+" in text:
        found += [(a, 3, b) for a, b in phones(text)]
    found = [(a, k, b, score(text, KINDS[k], a, b, False)) for a, k, b in found]
    n_base = len(found)
    taken = sorted((a, b) for a, _, b, _ in found)
    reach = []  # the furthest end up to each span
    for _, b in taken:
        reach.append(max(b, reach[-1]) if reach else b)
    for kind, a, b, checked in _added(text):
        i = bisect_left(taken, (b, 0))
        if i and reach[i - 1] > a:
            continue  # a base span holds a part of it
        s = score(text, kind, a, b, checked)
        if s >= THRESHOLD:
            found.append((a, KINDS.index(kind), b, s))
    return sorted(found), n_base


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, best_score, found), a row of docs each.

    found: array of (kind, start, end, score) in order of start, then kind; starts and ends
    count code points, the end is exclusive. Base spans always stay, whatever their score;
    account numbers and national numbers are added from THRESHOLD on where no base span
    overlaps them. Texts are scanned whole in one pass each, null ones are empty and give no
    spans; repeated rows each give a row; other columns don't count; an empty table stays
    empty. Rows stay in the tasks that read them: there is no shuffle.
    """
    kept = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    counts = [f"n_{k}" for k in BASE]
    schema = StructType(list(kept.select("key").schema.fields))
    for c in counts:
        schema = schema.add(c, "long")
    schema = schema.add("base_sha256", "string").add("spans", "string").add("n_spans", "long").add("best_score", "double").add("found", ArrayType(StructType().add("kind", "string").add("start", "long").add("end", "long").add("score", "double")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.array(KINDS)
        for batch in batches:
            n, shas, joined, best, offsets, flat = [], [], [], [], [0], []
            for t in batch.column(1):
                got, _ = spans(t.as_py() or "")
                said = [(f"{KINDS[k]}:{a}:{b}", k) for a, k, b, _ in got]
                shas.append(sha256(",".join(s for s, k in said if k < 4).encode()).hexdigest())
                joined.append(",".join(s for s, _ in said))
                n.append([sum(k == i for _, k in said) for i in range(4)])
                best.append(max((s for *_, s in got), default=0.0))
                flat += got
                offsets.append(len(flat))
            cols = list(zip(*flat)) if flat else [(), (), (), ()]
            items = pa.StructArray.from_arrays([kinds.take(pa.array(cols[1], pa.int64())), pa.array(cols[0], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())], ["kind", "start", "end", "score"])
            per = list(zip(*n)) if n else [()] * 4
            sizes = [b - a for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in per], pa.array(shas, pa.string()), pa.array(joined, pa.string()), pa.array(sizes, pa.int64()), pa.array(best, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)], schema.names)

    return kept.mapInArrow(run, schema).withColumnRenamed("key", key)
