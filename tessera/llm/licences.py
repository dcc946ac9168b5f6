"""Operator 2: licence scans by a positional index of rare licence words.

The words of the licence templates are the licence words; how rare each is (its IDF) is
counted over all documents. The index has, for each template, its rarest words with their
positions, and the rarest of its key phrase. For each file the rare words that it holds are looked up: an occurrence at word p
of a word at template position q is a candidate start p - q. All template words are then
intersected with the file's by relative position, which gives the part of the template that
stands there, and the template's mandatory key phrase must stand whole in its place. Short
phrases are templates whose key phrase is all of them, so their every place is found: each
holds the phrase's rarest word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels as K

#: Phrase and label.
BASE = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]
#: Label, passage of the licence or its notice, mandatory key phrase.
TEMPLATES = [
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "software distributed under the license is distributed on an as is basis"),
    ("apache", "spdx license identifier apache 2 0", "spdx license identifier apache"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("bsd", "spdx license identifier bsd", "spdx license identifier bsd"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "any person or organization obtaining a copy of the software"),
    ("boost", "boost software license version 1 0", "boost software license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc", "this work is licensed under a creative commons attribution license", "creative commons"),
    ("cc0", "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide", "dedicated the work to the public domain"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "terms of the eclipse public license"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "see the gnu general public license for more details"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program", "copy of the gnu general public license"),
    ("gpl", "spdx license identifier gpl", "spdx license identifier gpl"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl", "licensed under the gnu general public license version 3", "general public license"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties", "the author disclaims all warranties"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies"),
    ("mit", "spdx license identifier mit", "spdx license identifier mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", "copy of the mpl was not distributed with this file"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "in no event will the authors be held liable"),
]
COVERAGE = 0.75
RARE = 3


@dataclass
class Template:
    label: str
    base: bool
    words: np.ndarray  # vocabulary numbers from 1
    key: tuple[int, int]  # first and last position of the key phrase
    rare: list[int]  # the rarest words, and that of the key phrase


def _vocabulary() -> tuple[list[str], np.ndarray]:
    words = sorted({w for p, _ in BASE for w in p.split()} | {w for _, p, _ in TEMPLATES for w in p.split()})
    raw = " ".join(words).encode()
    return words, K.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), K.NON_WORD).hashes(lower=True)


class Numbers:
    """Vocabulary numbers of words: from 1 for licence words, 0 for others."""

    def __init__(self):
        self.words, h = _vocabulary()
        order = np.argsort(h)
        self.sorted, self.number = h[order], (order + 1).astype(np.int16)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(h >> np.uint64(48)).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int16)
        maybe = np.flatnonzero(self.sieve[(h >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.sorted, h[maybe]), len(self.sorted) - 1)
        out[maybe] = np.where(self.sorted[at] == h[maybe], self.number[at], 0)
        return out


def idf(docs: DataFrame) -> dict[str, float]:
    """The IDF of each licence word over all documents, null and empty texts included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        n, df = 0, np.zeros(len(numbers.words) + 1, np.int64)
        for batch in batches:
            n += len(batch)
            raw, offsets = K.string_buffers(batch.column(0))
            for _, _, part, off in K.chunks(raw, offsets):
                words = K.Words(part, off, K.NON_WORD)
                v = numbers.of(words.hashes(lower=True))
                hit = np.flatnonzero(v)
                seen = np.unique(K.row_of(words.first)[hit] * (len(df) + 1) + v[hit])
                df += np.bincount(seen % (len(df) + 1), minlength=len(df))
        df[0] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df))), pa.array(df)], ["word", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row a licence word
    count = {r.word: r.n for r in rows}
    return {w: math.log((1 + count.get(0, 0)) / (1 + count.get(i + 1, 0))) for i, w in enumerate(_vocabulary()[0])}


def templates(rarity: dict[str, float]) -> list[Template]:
    number = {w: i + 1 for i, w in enumerate(_vocabulary()[0])}
    out = []
    for label, text, key, base in [(b, p, p, True) for p, b in BASE] + [(t, p, k, False) for t, p, k in TEMPLATES]:
        words, k = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(k)] == k)
        order = lambda ws: sorted(set(ws), key=lambda w: (-rarity[w], w))
        rare = order(words)[: 1 if base else RARE]
        rare += [w for w in order(k)[:1] if w not in rare]  # the key phrase stands whole at every place, so none is missed
        out.append(Template(label, base, np.array([number[w] for w in words], np.int16), (at, at + len(k)), [number[w] for w in rare]))
    return out


def _scan(index: list[Template], v: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(row, word, template, coverage) of the verified places in a chunk; v: the words' vocabulary numbers."""
    hit = np.flatnonzero(v)
    if not len(hit):
        return []
    row = K.row_of(first)
    by = {}
    order = np.argsort(v[hit], kind="stable")
    bounds = np.searchsorted(v[hit][order], np.arange(int(v.max()) + 2))
    found = []
    for t, m in enumerate(index):
        starts, rows = [], []
        for word in m.rare:
            if word + 1 >= len(bounds):
                continue
            if word not in by:
                by[word] = hit[order[bounds[word] : bounds[word + 1]]]
            p = by[word]
            for q in np.flatnonzero(m.words == word).tolist():
                starts.append(p - q)
                rows.append(row[p])
        if not starts:
            continue
        pair = np.unique(np.column_stack((np.concatenate(rows), np.concatenate(starts))), axis=0)
        r, s = pair[:, 0], pair[:, 1]
        at = s[:, None] + np.arange(len(m.words))
        inside = (at >= first[r][:, None]) & (at < first[r + 1][:, None])
        same = inside & (v[np.clip(at, 0, len(v) - 1)] == m.words)
        cover = same.mean(1)
        good = same[:, m.key[0] : m.key[1]].all(1) & (cover >= COVERAGE)
        for i in np.flatnonzero(good).tolist():
            found.append((int(r[i]), int(s[i] - first[r[i]]), t, float(cover[i])))
    return found


def scan(docs: DataFrame, rarity: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row of docs each.

    n_base counts all places of the base phrases, first_word and last_word are the least and
    greatest starts of them (null without any). labels has base labels and those of templates
    of which COVERAGE or more stands in place with the key phrase whole; score is the largest
    part of a template found, 0 without any. A null text is empty; texts are scanned whole;
    repeated rows each give a row; empty tables stay empty; other columns aren't looked at.
    Of words as rare the first in the alphabet is looked up; as every place with its key
    phrase whole is found, that, and how rare words are, only decides how fast.
    """
    index = templates(idf(docs) if rarity is None else rarity)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for batch in batches:
            raw, offsets = K.string_buffers(batch.column(1))
            n = len(batch)
            n_words, n_base, score = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            first, last, base, every = [None] * n, [None] * n, [""] * n, [""] * n
            for a, b, part, off in K.chunks(raw, offsets):
                words = K.Words(part, off, K.NON_WORD)
                n_words[a:b] = np.diff(words.first)
                places: dict[int, list[tuple[int, int, float]]] = {}
                for row, word, t, cover in _scan(index, numbers.of(words.hashes(lower=True)), words.first):
                    places.setdefault(a + row, []).append((word, t, cover))
                for i, found in places.items():
                    mine = [w for w, t, _ in found if index[t].base]
                    if mine:
                        n_base[i], first[i], last[i] = len(mine), min(mine), max(mine)
                    base[i] = ",".join(sorted({index[t].label for _, t, _ in found if index[t].base}))
                    every[i] = ",".join(sorted({index[t].label for _, t, _ in found}))
                    score[i] = max(c for _, _, c in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_base), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base), pa.array(every), pa.array(score)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
