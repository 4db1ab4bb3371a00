"""License scans: a positional index of licence words, looked up by the rarest words of each notice."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.ship import ship

from ._text import lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases that are reported wherever they stand, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public licence notices as (label, text, mandatory key phrases).
TEMPLATES = (
    ("mit", "Released under the MIT License.", ("mit license",)),
    ("mit", "Licensed under the MIT License.", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", ("apache license version 2", "in compliance with the license")),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license version 2",)),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ("under the terms of the gnu general public license", "free software foundation")),
    ("lgpl-notice", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    ("agpl-notice", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("with or without fee is hereby granted",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license",)),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license",)),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered software", "public domain")),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ("waived all copyright",)),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", ("cc by sa",)),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0.", ("cc by nd",)),
    ("cc-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution",)),
)
#: Words of a notice that must be looked up in place before it is aligned, and the share of its words that must stand there.
VOTES, SHARE = 3, 0.6


def split(text: str | None) -> list[str]:
    return WORD.findall(lower(text or ""))


class Index:
    """Postings of the rarest words of each notice: word -> (template, position). Phrases are found from their rarest word.

    A notice has so many postings that VOTES of them are in place wherever SHARE of its words are.
    """

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, idf: dict[str, float] | None = None):
        self.labels = [t[0] for t in templates]
        self.words = [split(t[1]) for t in templates]
        self.keys = [[split(k) for k in t[2]] for t in templates]
        self.postings: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.idf = idf or {}
        for t, ws in enumerate(self.words):
            missing = len(ws) - math.ceil(SHARE * len(ws) - 1e-9)
            for i in sorted(range(len(ws)), key=lambda i: (-self.idf.get(ws[i], 0.0), i))[: missing + VOTES]:
                self.postings[ws[i]].append((t, i))
        self.needed = [frozenset(w for k in ks for w in k) for ks in self.keys]
        self.anchors: dict[str, list[tuple[list[str], int, str]]] = defaultdict(list)
        for p, label in phrases.items():
            ws = split(p)
            at = max(range(len(ws)), key=lambda i: (self.idf.get(ws[i], 0.0), -i))
            self.anchors[ws[at]].append((ws, at, label))
        self.vocabulary = frozenset(w for ws in self.words for w in ws) | frozenset(w for p in phrases for w in split(p))

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
        ws = split(text)
        where: dict[str, list[int]] = {}
        words = self.vocabulary
        for i, w in enumerate(ws):
            if w in words:
                where.setdefault(w, []).append(i)
        starts, base = [], set()
        for w in where.keys() & self.anchors.keys():
            for phrase, at, label in self.anchors[w]:
                k = len(phrase)
                found = [i - at for i in where[w] if i >= at and ws[i - at : i - at + k] == phrase]
                if found:
                    base.add(label)
                    starts += found
        labels, best = set(base), 1.0 if base else 0.0
        likely = [need <= where.keys() for need in self.needed]
        votes: Counter = Counter()
        for w in where.keys() & self.postings.keys() if any(likely) else ():
            for t, p in self.postings[w]:
                if likely[t]:
                    for i in where[w]:
                        votes[t, i - p] += 1
        for (t, s), n in votes.items():
            own = self.words[t]
            if n < min(VOTES, len(own)) or s < 0:
                continue
            share = sum(a == b for a, b in zip(own, ws[s : s + len(own)], strict=False)) / len(own)
            if share >= SHARE and all(_has(ws[max(0, s - 2) : s + len(own) + 2], k) for k in self.keys[t]):
                labels.add(self.labels[t])
                best = max(best, share)
        return len(ws), len(starts), min(starts, default=None), max(starts, default=None), sorted(base), sorted(labels), best


def _has(ws: list[str], key: list[str]) -> bool:
    k = len(key)
    return any(ws[i : i + k] == key for i in range(len(ws) - k + 1))


def licence_idf(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """IDF over all documents of the words of the index; as many entries as the index has words."""
    ship(docs.sparkSession)
    words = Index().vocabulary

    def count(batches):
        n: Counter = Counter()
        for batch in batches:
            n[""] += batch.num_rows
            for x in batch.column(0):
                n.update(words.intersection(split(x.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    found = {r["word"]: r["n"] for r in docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = found.pop("", 0)
    return {w: math.log((total + 1) / (found.get(w, 0) + 1)) for w in words}


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the text, with what the scan found in it: n_words, n_base, first_word, last_word, base_labels, labels (arrays) and score (1 for a phrase, else the share of the best notice's words that stand in place).

    Columns of these names are replaced. Null text: empty, with no words and
    score 0. Texts are read one by one, whole; no rows give no rows.
    """
    ship(docs.sparkSession)
    idf = licence_idf(docs, text)
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    own = [c for c in docs.columns if c not in (text, *names)]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64()]

    def run(batches):
        index = Index(idf=idf)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                found = list(zip(*[index.scan(x) for x in part.column(len(own)).to_pylist()], strict=True))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], names=[*own, *names])

    rows = docs.select(*own, text)
    return rows.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text), "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double"]))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.withColumns({"base_labels": F.array_join("base_labels", ","), "labels": F.array_join("labels", ",")})
