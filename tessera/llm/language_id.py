"""Operator 3: language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed by each
automaton into phrases: the longest string from the present place that the labelled text
holds, again and again. phrases * log2(labelled length) / length estimates the cross
entropy, so the language that needs the fewest normalised phrases wins.

The alphabet is the bytes of lower-cased letters in UTF-8, so there is one of any script and
none is left out; anything but letters is one blank. The automata are made deterministic
tables: a missing transition leads to where the root goes with that byte and is marked as a
new phrase. Workers advance all texts of a batch, and all languages, one byte at a time with
vectorised table look-ups. So that long texts go as fast, they are first parsed in pieces, each a
fresh start; then every piece that its predecessor enters amid a phrase is parsed again from
there, beside its last parse, until both stand in one state. The counts are those of one
parse of the whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tessera.llm import kernels as K
from tessera.llm.common import own_prefix

PIECE = 1024
SPACE, OTHER = 0, 1  # symbols: anything but letters; bytes that no labelled letter has
UND = "und"


@dataclass
class Model:
    """langs sorted; table: next row offset * 2 + mark of a phrase's first letter; rest: a language's row offset between phrases; bits: log2 of the labelled length."""

    langs: list[str]
    table: np.ndarray
    rest: np.ndarray
    bits: np.ndarray
    symbol: np.ndarray  # byte of a letter -> symbol


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text divisible by 5. A null id is not held out, nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@cache
def _lowered() -> np.ndarray:
    """For each code point its lower-case letter's, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _bytes(code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of code points (0 for anything but letters, runs of which are one), and the row bounds `at` among them."""
    low = _lowered()[code]
    again = np.zeros(len(low), bool)
    again[1:] = (low[1:] == 0) & (low[:-1] == 0)
    again[at[(at > 0) & (at < len(low))]] = False
    at = np.concatenate(([0], np.cumsum(~again)))[at]
    low = low[~again]
    size = 1 + (low >= 0x80) + (low >= 0x800) + (low >= 0x10000).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(size)))
    if ends[-1] == len(low):
        return low.astype(np.uint8), at
    each, left = np.repeat(low, size), np.repeat(ends[1:], size) - 1 - np.arange(ends[-1])  # bytes that follow in the letter
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)[np.repeat(size, size)]
    head = np.zeros(ends[-1], bool)
    head[ends[:-1]] = True
    part = each >> (6 * left).astype(np.uint32)
    return np.where(head, part | lead, (part & 0x3F) | 0x80).astype(np.uint8), ends[at]


def sample(docs: DataFrame, rows: int, chars: int) -> list[tuple[str, str]]:
    """(lang, text) of at most `rows` labelled rows a language, in hash order of the id, each up to `chars` characters."""
    pool = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = pool.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows).select("doc_id", "lang").distinct().collect()
    if not chosen:
        return []
    ids = sorted({r.doc_id for r in chosen})
    texts = pool.where(F.col("doc_id").isin(ids)).select("lang", "doc_id", F.left(F.col("text").cast("string"), F.lit(chars)).alias("text"), F.xxhash64("doc_id").alias("h")).collect()
    want = {(r.doc_id, r.lang) for r in chosen}
    texts = sorted({(r.lang, r.h, r.doc_id, r.text) for r in texts if r.text and (r.doc_id, r.lang) in want})
    return [(lang, text) for lang, _, _, text in texts]


def _automaton(s: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of s; state 0 is the root."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in s:
        cur = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = cur
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = clone
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = clone
                    p = link[p]
        last = cur
    return go


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fit(labelled: list[tuple[str, str]], most: int = 40_000, most_in_all: int = 200_000) -> Model:
    """A model of (lang, text) rows: up to `most` bytes of letters a language, `most_in_all` in all. A language without a letter isn't learned."""
    known = {lang for lang, text in labelled if any(c.isalpha() for c in text)}
    langs = sorted(known)
    most = min(most, most_in_all // max(1, len(langs)))
    held: dict[str, list[np.ndarray]] = {}
    for lang, text in labelled:
        if lang in known and sum(map(len, held.get(lang, []))) < most:
            held.setdefault(lang, []).append(_bytes(_code_points(" " + text), np.array([0]))[0])
    learned = {lang: np.concatenate(parts)[:most] for lang, parts in held.items()}
    # after a cut in a text another follows; two blanks that meet there are no harm, as no text has two
    used = np.unique(np.concatenate(list(learned.values()))) if langs else np.zeros(0, np.uint8)
    symbol = np.full(256, OTHER, np.uint8)
    symbol[used] = np.arange(len(used)) + 2  # at most 245 bytes occur in UTF-8
    symbol[0] = SPACE
    width = len(used) + 2
    tables, rests, bits, base = [], [], [], 0
    for lang in langs:
        s = symbol[learned[lang]]
        go = _automaton(s.tolist())
        rest = base + len(go)  # between phrases: any byte begins one; an unseen one is a phrase and leads back here
        start = np.full(width, rest * width * 2 + 1, np.int64)
        for c, to in go[0].items():
            start[c] = (base + to) * width * 2 + 1
        t = np.tile(start, (len(go) + 1, 1))
        for i, out in enumerate(go):
            for c, to in out.items():
                t[i, c] = (base + to) * width * 2
        tables.append(t.astype(np.int32).ravel())
        rests.append(rest * width)
        bits.append(math.log2(max(2, len(s))))
        base += len(go) + 1
    return Model(langs, np.concatenate(tables) if tables else np.zeros(0, np.int32), np.array(rests, np.int32), np.array(bits), symbol)


def _again(table: np.ndarray, s: np.ndarray, begin: np.ndarray, size: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parses of pieces from the states `new` beside those from `old`: how many more phrases they have, and their last state (-1: they met the old parse)."""
    more, last = np.zeros(len(begin), np.int64), np.full(len(begin), -1, np.int32)
    who, t = np.arange(len(begin)), 0
    while len(who):
        c = s[begin[who] + t]
        x, y = table[old + c], table[new + c]
        more[who] += (y & 1) - (x & 1)
        old, new, t = x >> 1, y >> 1, t + 1
        over = size[who] == t
        last[who[over]] = np.where(old[over] == new[over], -1, new[over])
        stay = ~over & (old != new)
        who, old, new = who[stay], old[stay], new[stay]
    return more, last


def phrases(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: phrases a language (rows x languages), parsed bytes, and whether it has a letter."""
    n_rows, n_lang = len(offsets) - 1, len(model.langs)
    code = _code_points(raw.tobytes().decode("utf-8", "replace"))
    letters, at = _bytes(code, np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))[offsets])
    length = np.diff(at)
    seen = np.concatenate(([0], np.cumsum(letters != 0)))
    has = seen[at[1:]] > seen[at[:-1]]
    out = np.zeros((n_rows, n_lang), np.int64)
    pieces = -(-length // PIECE)
    row = np.repeat(np.arange(n_rows), pieces)
    if not len(row) or not n_lang:
        return out, length, has
    s = model.symbol[letters].astype(np.int32)
    part = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = at[:-1][row] + PIECE * part
    size = np.minimum(PIECE, at[1:][row] - begin)
    order = np.argsort(-size, kind="stable")
    place = np.empty(len(row), np.int64)
    place[order] = np.arange(len(row))
    after = np.full(len(row), -1)  # the place of the piece that goes on
    after[place[:-1]] = np.where(part[1:] > 0, place[1:], -1)
    row, begin, size = row[order], begin[order], size[order]
    rest = np.repeat(model.rest[:, None], len(row), axis=1)
    state, count = rest.copy(), np.zeros(rest.shape, np.int32)
    active = np.searchsorted(-size, -np.arange(size[0]), "left")  # pieces that reach byte t
    for t in range(int(size[0])):
        m = active[t]
        entry = model.table[state[:, :m] + s[begin[:m] + t]]
        count[:, :m] += entry & 1
        np.right_shift(entry, 1, out=state[:, :m])
    lang, who = np.nonzero((after >= 0) & (state != rest))  # pieces that end amid a phrase
    begun = rest  # the states that the pieces' counts hold for
    while len(who):
        nxt = after[who]
        new = state[lang, who]
        more, last = _again(model.table, s, begin[nxt], size[nxt], begun[lang, nxt], new)
        count[lang, nxt] += more
        begun[lang, nxt] = new
        turned = last >= 0
        state[lang[turned], nxt[turned]] = last[turned]
        turned &= after[nxt] >= 0
        lang, who = lang[turned], nxt[turned]
    for i in range(n_lang):
        out[:, i] = np.bincount(row, count[i], n_rows).astype(np.int64)
    return out, length, has


def _parsed(docs: DataFrame, model: Model, keep: list[str], text_col: str, pred_name: str, score_name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit()'s most_in_all
    names = [f"c{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, offsets = K.string_buffers(batch.column(len(keep)))
            best, score = np.full(len(batch), -2), np.zeros(len(batch))
            for a, b, part, off in K.chunks(raw, offsets, 2 << 20):
                n, length, has = phrases(m, part, off)
                if not m.langs:
                    best[a:b] = np.where(has, -1, -2)
                    continue
                cost = n * m.bits
                first = cost.argmin(1)
                low = cost[np.arange(b - a), first]
                other = cost.copy()
                other[np.arange(b - a), first] = np.inf
                nxt = other.min(1) if len(m.langs) > 1 else length * m.bits[0]
                with np.errstate(divide="ignore", invalid="ignore"):
                    score[a:b] = np.where(has & (nxt > 0), np.clip(1 - low / nxt, 0, 1), 0)
                best[a:b] = np.where(has, first, -2)
            langs = pa.array([*m.langs, UND, None], pa.string())  # null: letters, but no language is known
            pred = langs.take(pa.array(np.where(best == -2, len(m.langs), np.where(best == -1, len(m.langs) + 1, best))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pred, pa.array(score)], [*names, pred_name, score_name])

    kept = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)])
    schema = StructType(list(kept.schema.fields)).add(pred_name, "string").add(score_name, "double")
    out = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(f"`{text_col}`").cast("string").alias("__text")).mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], pred_name, score_name)


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns with lang_pred and score, a row of docs each.

    lang_pred is `und` and score 0 if the text is null, empty or without a letter, or if no
    language was learned. score is one less the ratio of the least to the next normalised
    phrase count, so 0 is a tie, in which the first language by name wins; beside a single
    language stands a parse of one phrase a byte. Texts are parsed whole, whatever their
    length; repeated rows each give a row; clashing columns are replaced; empty tables stay empty.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    return _parsed(docs, model, keep, text_col, "lang_pred", "score").fillna(UND, ["lang_pred"])


def learn(docs: DataFrame, rows: int = 200, chars: int = 1_000, most: int = 40_000) -> Model:
    """A model learned from the text and lang of the table's rows that are not held out.

    At most `rows` rows a language by a hash of the id, `chars` characters of each, go to the
    driver, and up to `most` bytes of their letters are learned. Of rows with one id and
    language all texts count.
    """
    return fit(sample(docs, rows, chars), most)


def accepted(docs: DataFrame) -> DataFrame:
    """The documents in a language: those whose text is null or has no letter go. Columns stay as they are, whatever their names.

    Without a usable label no language is known, and all texts with a letter stay.
    """
    own = own_prefix(docs.columns)
    found = _parsed(docs, learn(docs), docs.columns, "text", f"{own}lang", f"{own}score")
    return found.where(~F.col(f"{own}lang").eqNullSafe(UND)).select(*[F.col(f"`{c}`") for c in docs.columns])
