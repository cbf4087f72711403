"""Licence findings: TF-IDF cosine of passages to templates, then inheritance down the directories."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import dealt_anew, utf8, written
from fieldloom.llm.license_texts import TEXTS

#: One-line notices and the openings of licence files, by SPDX name.
NOTICES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004 terms and conditions for use, reproduction, and distribution",
    ],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ],
    "LGPL-2.1": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    ],
    "LGPL-3.0": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "Zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
}
#: Names in the tags of the SPDX kind, besides those above that are the tag themselves.
TAGS = {name: name for name in ("Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "MIT-0", "MPL-2.0", "EPL-2.0", "ISC", "BSL-1.0", "Unlicense", "Zlib", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "WTFPL", "Artistic-2.0")}
TAGS |= {f"{name}-only": name for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")}
TAGS |= {f"{name}-or-later": name for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")}
TEMPLATES: dict[str, list[str]] = {name: [*NOTICES.get(name, []), *(f"SPDX-License-Identifier: {tag}" for tag, of in TAGS.items() if of == name)] for name in [*NOTICES, *(n for n in TAGS.values() if n not in NOTICES)]}
#: What licences that share most of their text call themselves.
SELF_NAMES = {
    "GPL-2.0": "gnu general public license",
    "GPL-3.0": "gnu general public license",
    "LGPL-2.1": "gnu lesser general public license",
    "LGPL-3.0": "gnu lesser general public license",
    "AGPL-3.0": "gnu affero general public license",
}
CLOSE = 0.95  # from this cosine on two whole texts are told apart by their differences
_TAG = re.compile(rb"(?i)SPDX-License-Identifier:[ \t]*([^\r\n]*)")
_ID = re.compile(rb"[A-Za-z0-9.+-]+")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PLACES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


def document_frequencies(docs: DataFrame, text: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many texts each word of the vocabulary occurs; a row for each task and word is all that moves."""
    out = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for data in batch.column(0):
                total.update(vocabulary.intersection(words(data.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], schema=out)

    rows = docs.select(utf8(F.col(text)).alias("data")).mapInArrow(count, "word binary, n long")
    return {bytes(r[0]): r[1] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class Matcher:
    """Templates as unit TF-IDF vectors over words and word pairs."""

    def __init__(self, templates: dict[str, list[str]], frequencies: dict[bytes, int], n_docs: int):
        self.names = [name for name, texts in templates.items() for _ in texts]
        own = [words(t.encode()) for texts in templates.values() for t in texts]
        self.sizes = [len(w) for w in own]
        self.idf = {w: math.log((1 + n_docs) / (1 + frequencies.get(w, 0))) + 1 for ws in own for w in ws}
        self.n_docs = n_docs
        self.index: dict[object, list[tuple[int, float]]] = {}
        for k, ws in enumerate(own):
            v = self.vector(ws)
            norm = math.sqrt(sum(x * x for x in v.values()))
            for term, x in v.items():
                self.index.setdefault(term, []).append((k, x / norm))
        self.terms = {term: n for n, term in enumerate(self.index)}
        self.squares = np.zeros((len(own), len(self.terms)))  # a template's part in each term
        for term, of in self.index.items():
            for k, y in of:
                self.squares[k, self.terms[term]] = y * y
        self.own = own
        self.frequencies = frequencies
        self._anchors: dict[float, dict[bytes, set[int]]] = {}

    def anchors(self, least: float) -> dict[bytes, set[int]]:
        """The sizes of templates by word, so that a passage of that size without any of its words stays under `least`.

        A cosine is at most the root of the shared terms' part of the template; a template's rarest words are taken until
        what has none of them is too little.
        """
        if least not in self._anchors:
            out: dict[bytes, set[int]] = {}
            for k, ws in enumerate(self.own):
                rest = {term: y * y for term, of in self.index.items() for j, y in of if j == k}
                for w in sorted(set(ws), key=lambda w: (self.frequencies.get(w, 0), w)):
                    if sum(rest.values()) < least * least - 1e-9:
                        break
                    out.setdefault(w, set()).add(self.sizes[k])
                    rest = {term: y for term, y in rest.items() if w != term and not (isinstance(term, tuple) and w in term)}
            self._anchors[least] = out
        return self._anchors[least]

    def vector(self, ws: list[bytes], more: dict[bytes, float] | None = None) -> dict[object, float]:
        """Weights of words and pairs; a word without a known frequency weighs the least that any can (1, as if in every text)."""
        idf, more = self.idf, more or {}
        own = [idf[w] if w in idf else more.get(w, 1.0) for w in ws]
        out: dict[object, float] = {}
        for w, x in zip(ws, own, strict=True):
            out[w] = out.get(w, 0.0) + x
        for a, b, x, y in zip(ws, ws[1:], own, own[1:], strict=False):
            out[a, b] = out.get((a, b), 0.0) + (x + y) / 2
        return out

    def cosines(self, ws: list[bytes], more: dict[bytes, float] | None = None) -> dict[int, float]:
        """The cosine to each template with a common term; without the frequencies of other words an upper bound of it."""
        v = self.vector(ws, more)
        norm = math.sqrt(sum(x * x for x in v.values()))
        scores: Counter = Counter()
        for term, x in v.items():
            for k, y in self.index.get(term, ()):
                scores[k] += x * y
        return {k: x / norm for k, x in scores.items()}

    def best(self, ws: list[bytes], more: dict[bytes, float] | None = None) -> tuple[float, int]:
        """The greatest cosine and its template."""
        scores = self.cosines(ws, more)
        if not scores:
            return 0.0, -1
        k = min(scores, key=lambda k: (-scores[k], k))
        return scores[k], k

    def candidates(self, ws: list[bytes], least: float) -> list[tuple[int, int]]:
        """(first word, words) of the passages that can reach `least`."""
        anchors = self.anchors(least)
        sizes = {size for w in anchors.keys() & set(ws) for size in anchors[w] if size <= len(ws)}
        if not sizes:
            return []
        single = _occurrences([self.terms.get(w, -1) for w in ws])
        paired = _occurrences([self.terms.get(t, -1) for t in zip(ws, ws[1:], strict=False)])
        out: set[tuple[int, int]] = set()
        for k, size in enumerate(self.sizes):
            if size in sizes:
                # the template's parts that the passage from each word on has, the most that a cosine's square can be
                parts = np.zeros(len(ws) + 1)
                for (at, term, before), reach in ((single, size), (paired, size - 1)):
                    own = self.squares[k, term]
                    parts += np.bincount(np.maximum(before + 1, at - reach + 1), own, len(parts)) - np.bincount(at + 1, own, len(parts))
                low = np.flatnonzero(np.cumsum(parts)[: len(ws) - size + 1] >= least * least - 1e-9)
                out.update((a, size) for a in low.tolist())
        return sorted((low, size) for low, size in out if self.best(ws[low : low + size])[0] >= least - 1e-9)

    def findings(self, ws: list[bytes], candidates: list[tuple[int, int]], more: dict[bytes, float], least: float, full: WholeTexts | None = None) -> list[tuple[int, int, str, float]]:
        """(first word, word after the last, name, cosine) of passages that do not overlap, best first where they would.

        A passage that whole licence texts begin with, or hold, is told by the words around it: where these are one of the whole
        texts (a cosine of at least `least`), the finding is that text's licence and reaches over all of it.
        """
        found = set()
        for low, size in candidates:
            score, k = self.best(ws[low : low + size], more)
            if score >= least and self.sizes[k] == size:
                found.add((-score, low, low + size, k))
        out = []
        for score, a, b, k in _apart(sorted(found)):
            around = full.around(ws, a, self.own[k], more, least) if full else None
            out.append(((0, -around[3]), *around) if around else ((1, score), a, b, self.names[k], -score))
        return sorted(f[1:] for f in _apart(sorted(set(out))))


def _apart(found: list[tuple]) -> list[tuple]:
    """Those of (order, first, after the last, ...) that do not overlap with earlier ones."""
    out: list[tuple[int, int]] = []
    kept = []
    for f in found:
        at = bisect_left(out, (f[1],))
        if (at == len(out) or f[2] <= out[at][0]) and (not at or out[at - 1][1] <= f[1]):
            out.insert(at, (f[1], f[2]))
            kept.append(f)
    return kept


class WholeTexts(Matcher):
    """Whole licence texts, of which close ones are told apart by what differs between them."""

    def __init__(self, texts: dict[str, str], frequencies: dict[bytes, int], n_docs: int):
        super().__init__({name: [t] for name, t in texts.items()}, frequencies, n_docs)
        self.counts = [Counter(ws) + Counter(zip(ws, ws[1:], strict=False)) for ws in self.own]
        self.joined = [b" " + b" ".join(ws) + b" " for ws in self.own]
        self.held: dict[int, set[str]] = {}

    def told(self, ws: list[bytes], ks: list[int]) -> int:
        """Of close texts the one whose name the words have most often, then the one from whose counts of differing terms theirs are least far."""
        if len(ks) == 1:
            return ks[0]
        own = Counter(ws) + Counter(zip(ws, ws[1:], strict=False))
        text = b" ".join(ws)
        differ = {t for k in ks for t in self.counts[k] if len({self.counts[j][t] for j in ks}) > 1}
        weight = {t: self.idf[t] if isinstance(t, bytes) else (self.idf[t[0]] + self.idf[t[1]]) / 2 for t in differ}

        def far(k: int) -> tuple[int, float, int]:
            name = SELF_NAMES.get(self.names[k])
            return -text.count(name.encode()) if name else 0, math.fsum(x * abs(own[t] - self.counts[k][t]) for t, x in weight.items()), k

        return min(ks, key=far)

    def nearest(self, ws: list[bytes], more: dict[bytes, float], least: float) -> tuple[float, int] | None:
        """(cosine, text) of the licence that the words as a whole are, if any reaches `least`."""
        scores = self.cosines(ws, more)
        close = self.close(scores, least)
        if not close:
            return None
        k = self.told(ws, close)
        return scores[k], k

    def close(self, scores: dict[int, float], least: float) -> list[int]:
        """The best text of those that reach `least`, and those that it takes more than a cosine to tell from it."""
        most = max(scores.values(), default=0.0)
        return sorted(k for k, x in scores.items() if x >= max(least, most - (1 - CLOSE))) if most >= least else []

    def spans(self, n_words: int, low: int, notice: list[bytes]) -> dict[int, tuple[int, int]]:
        """Where each whole text that a notice is part of would stand, if the notice is at word `low` of so many."""
        sought = b" " + b" ".join(notice) + b" "
        out = {}
        for k, text in enumerate(self.joined):
            if (at := text.find(sought)) >= 0:
                begin = low - text.count(b" ", 0, at)
                out[k] = max(0, begin), min(n_words, begin + self.sizes[k])
        return out

    def around(self, ws: list[bytes], low: int, notice: list[bytes], more: dict[bytes, float], least: float) -> tuple[int, int, str, float] | None:
        """(first word, word after the last, name, cosine) of the whole text that a notice at word `low` is part of."""
        spans = self.spans(len(ws), low, notice)
        scores = {k: self.cosines(ws[a:b], more).get(k, 0.0) for k, (a, b) in spans.items()}
        close = self.close(scores, least)
        if not close:
            return None
        k = self.told(ws[min(spans[k][0] for k in close) : max(spans[k][1] for k in close)], close)
        return *spans[k], self.names[k], scores[k]

    def tells_of(self, k: int, notices: Matcher, least: float) -> set[str]:
        """The licences that text k itself names or is close to: no findings of their own within it."""
        if k not in self.held:
            ws = self.own[k]
            found = notices.findings(ws, notices.candidates(ws, least), self.idf, least)
            self.held[k] = {self.names[j] for j, x in self.cosines(ws).items() if x >= CLOSE} | {name for _, _, name, _ in found}
        return self.held[k]


def _tagged(data: bytes, found: list[tuple[int, int, str, float]], known: set[str]) -> list[tuple[int, int, str, float]]:
    """Findings (in bytes) in which a tag's expression gives all licences that it names, and no other."""
    for m in _TAG.finditer(data):
        ids = [(x.start(), x.end(), x.group().decode()) for x in _ID.finditer(m.group(1))]
        names = []
        for n, (a, b, own) in enumerate(ids):
            if own.upper() in ("AND", "OR", "WITH"):
                continue
            if n and ids[n - 1][2].upper() == "WITH":  # an exception, no licence
                continue
            if n and ids[n - 1][2].upper() not in ("AND", "OR"):  # words after the expression
                break
            names.append((m.start(1) + a, m.start(1) + b, TAGS.get(own, own.rstrip("+"))))
        inside = [f for f in found if f[0] < m.end(1) and m.start() < f[1]]
        if [f[2] for f in inside] == [x[2] for x in names]:
            continue
        tags = [(m.start() if n == 0 else a, b, name, 1.0) for n, (a, b, name) in enumerate(names) if name in known]
        end = names[-1][1] if names else m.end(1)
        found = [f for f in found if f[1] <= m.start() or f[0] >= end] + tags
    return sorted(found)


def _occurrences(terms: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, term, place of the same term before or -1) of the known terms."""
    every = np.array(terms, np.int64)
    at = np.flatnonzero(every >= 0)
    term = every[at]
    order = np.argsort(term, kind="stable")
    same = term[order][1:] == term[order][:-1]
    before = np.full(len(at), -1)
    before[order[1:][same]] = at[order[:-1][same]]
    return at, term, before


_FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("cosine", pa.float64())])


def find_licenses(docs: DataFrame, keep: list[Column], templates: dict[str, list[str]] | None = None, least: float = 0.8, text_col: str = "text", field_bits: int = 22) -> DataFrame:
    """The kept columns with findings array<struct<start,end,license,cosine>> (UTF-8 bytes) and whole, if they fill most of the text.

    A text whose whole has a cosine of at least `least` to a whole licence text is a finding of all of it; of several such licences
    the one is told by what differs between them (its own name, then the counts of differing words and pairs).  Passages of
    other licences, which that licence's own text does not name, are findings besides.  Without such a whole, a passage is as
    many words as its template; it is found where its cosine is at least `least`, and where it is part of a whole licence text
    the finding is that text's.  All licences of a tag's SPDX expression that are known are findings, each where it stands (an
    exception after WITH is none, one tag with an unknown licence gives none).  Weights are inverse document frequencies
    over all texts.  Those of the templates' words are counted first; with them, and the least weight for all other words, a
    scan finds the passages that can reach `least`.  The other words of those are then counted in all texts (a bit field
    of 2**field_bits passes over most that are not asked for, an equi-join decides), and the passages scored again.
    Null and empty texts have no finding; an empty table gives no row; repeated rows stay.
    """
    templates = templates or TEMPLATES
    vocabulary = {w for texts in (*templates.values(), TEXTS.values()) for t in texts for w in words(t.encode())}
    frequencies, n_docs = document_frequencies(docs, text_col, vocabulary), docs.count()
    matcher = Matcher(templates, frequencies, n_docs)
    full = WholeTexts(TEXTS, frequencies, n_docs)
    known, weights = {*templates, *TEXTS}, matcher.idf | full.idf
    for m in (matcher, full):
        m.anchors(least)  # once, before it is sent to the tasks
    texts = docs.select(utf8(F.col(f"`{text_col}`")).alias("data"))
    screened = T.StructType([T.StructField("text", T.BinaryType()), T.StructField("unmet", T.ArrayType(T.BinaryType()))])

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts that can have a finding, and the words of theirs whose frequency it takes to tell."""
        for batch in batches:
            held, unmet = [], []
            for data in batch.column(batch.num_columns - 1):
                data = data.as_py()
                ws = words(data)
                file = not full.anchors(least).keys().isdisjoint(ws) and full.best(ws)[0] >= least - 1e-9
                passages = matcher.candidates(ws, least)
                spans = [(0, len(ws))] * file + passages
                for low, size in passages:  # what stands around a notice is scored too
                    around = full.spans(len(ws), low, matcher.own[matcher.best(ws[low : low + size])[1]])
                    spans += [(a, b - a) for k, (a, b) in around.items() if full.cosines(ws[a:b]).get(k, 0.0) >= least - 1e-9]
                held.append(data if spans or _TAG.search(data) else None)
                unmet.append(sorted({w for low, size in spans for w in ws[low : low + size]} - full.idf.keys() - matcher.idf.keys()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held, pa.binary()), pa.array(unmet, pa.list_(pa.binary()))], names=[f.name for f in way])

    held = docs.select(*keep, utf8(F.col(f"`{text_col}`")).alias("data"))
    names, kinds = [f.name for f in held.schema.fields[:-1]], [f.dataType for f in held.schema.fields[:-1]]
    plain = [f"c{k}" for k in range(len(names))]  # names that the way to Python and back can take
    way = T.StructType([T.StructField(n, k) for n, k in zip(plain, kinds, strict=True)] + screened.fields)
    rows = written(held.toDF(*plain, "data").mapInArrow(screen, way).withColumn("number", F.monotonically_increasing_id()), "screened")
    asked = rows.select("number", F.explode("unmet").alias("word"))
    more = asked.join(dealt_anew(_frequencies_of(texts, asked, field_bits), "word"), "word").groupBy("number").agg(F.collect_list(F.struct("word", "n")).alias("more"))
    kind = "findings array<struct<start:long,end:long,license:string,cosine:double>>, whole boolean"
    done = T.StructType(way.fields[: len(names)] + T._parse_datatype_string(kind).fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, whole = [], []
            for data, met in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                own: list[tuple[int, int, str, float]] = []
                if data:
                    ws, places = words(data), [m.span() for m in _PLACES.finditer(data)]
                    idf = weights | {x["word"]: math.log((1 + n_docs) / (1 + x["n"])) + 1 for x in met or ()}
                    near = full.nearest(ws, idf, least)
                    passages = matcher.findings(ws, matcher.candidates(ws, least), idf, least, full)
                    if near:
                        held = full.tells_of(near[1], matcher, least)
                        passages = [(0, len(ws), full.names[near[1]], near[0]), *(f for f in passages if f[2] not in held)]
                    own = _tagged(data, [(places[a][0], places[b - 1][1], name, x) for a, b, name, x in passages], known)
                found.append([{"start": a, "end": b, "license": name, "cosine": c} for a, b, name, c in own])
                whole.append(bool(own) and sum(len(words(data[a:b])) for a, b, _, _ in own) * 2 >= len(words(data)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(found, pa.list_(_FOUND)), pa.array(whole, pa.bool_())], names=[f.name for f in done])

    return rows.join(more, "number", "left").select(*plain, "text", "more").mapInArrow(score, done).toDF(*names, "findings", "whole")


def _frequencies_of(texts: DataFrame, asked: DataFrame, field_bits: int) -> DataFrame:
    """(word, n): in how many texts each asked word occurs."""
    place = F.xxhash64("word").bitwiseAND((1 << field_bits) - 1)
    set_ = asked.select(F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast(xxhash64(word) & {63} as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas()
    field = np.zeros(1 << field_bits - 6, np.int64)
    field[set_["at"].to_numpy(np.int64)] = set_["bit"].to_numpy(np.int64)
    sent = texts.sparkSession.sparkContext.broadcast(field.view(np.uint8).tobytes() if field.any() else b"")  # 2**(field_bits - 3) bytes
    out = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    mask = (1 << field_bits) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, total = sent.value, Counter()
        known: dict[bytes, bool] = {}
        for batch in batches if bits else ():
            for data in batch.column(0):
                some = []
                for w in set(words(data.as_py())):
                    on = known.get(w)
                    if on is None:
                        if len(known) >= 200_000:
                            known.clear()
                        h = xxhash.xxh64_intdigest(w, 42) & mask
                        on = known[w] = bool(bits[h >> 3] >> (h & 7) & 1)
                    if on:
                        some.append(w)
                total.update(some)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], schema=out)

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def license_scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", depth: int | None = None, least: float = 0.8, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, path, licenses array<string>, n_findings, origin, from_dir) of each row.

    origin is `own` for rows with findings, `inherited` for those with a licence file (a text that is mostly licence) in their
    directory or else in the nearest directory above, with that directory's licences, and `none` for the rest.  Directories
    are looked up by equi-joins, one level at a time from the nearest: a row leaves with the first that has a licence, and the table of
    directories with licences is summed first, so that its hot rows are one each.  Where `depth` is given, paths
    look no further up than that.  Null paths, like rows without a directory, belong to the root.
    """
    keep = [F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(path, F.lit("")).alias("path")]
    found = written(find_licenses(docs, keep, templates, least, text_col), "licenses")
    above = F.regexp_replace("path", "/?[^/]*$", "")
    rows = found.select(
        "id", "path", above.alias("dir"), F.array_sort(F.array_distinct(F.transform("findings", lambda x: x["license"]))).alias("licenses"),
        F.size("findings").cast("long").alias("n_findings"), "whole",
    )
    dirs = rows.where("whole").select("dir", F.explode("licenses").alias("l")).distinct().groupBy("dir").agg(F.array_sort(F.collect_list("l")).alias("dir_licenses"))
    parts = F.when(F.col("dir") == "", F.array()).otherwise(F.split("dir", "/"))
    up = F.transform(F.sequence(F.lit(0), F.size(parts) if depth is None else F.least(F.size(parts), F.lit(depth))), lambda n: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - n), "/"))
    # every directory that rows are in, once, against those above it
    ways = rows.where("n_findings = 0").select("dir").distinct().select("dir", F.posexplode(up).alias("steps", "from_dir"))
    nearest = ways.join(dealt_anew(dirs.withColumnRenamed("dir", "from_dir"), "from_dir"), "from_dir").groupBy("dir").agg(F.min(F.struct("steps", "from_dir", "dir_licenses")).alias("near"))
    out = rows.join(dealt_anew(nearest, "dir"), "dir", "left")
    own = F.col("n_findings") > 0
    near = F.col("near").isNotNull()
    return out.select(
        F.col("id").alias(id_col), "path", F.when(own, F.col("licenses")).when(near, F.col("near.dir_licenses")).otherwise(F.col("licenses")).alias("licenses"), "n_findings",
        F.when(own, "own").when(near, "inherited").otherwise("none").alias("origin"), F.when(~own & near, F.col("near.from_dir")).alias("from_dir"),
    )
