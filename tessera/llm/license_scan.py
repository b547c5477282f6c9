"""Licence scans by patience alignment of licence texts with documents.

A document is aligned with a licence text only where it holds enough of that text's distinct words. There,
each stretch that could hold the licence is aligned: words unique to both sides are the anchors, their
longest increasing subsequence is kept, and the gaps between anchors are aligned in the same way.
Coverage is the share of the licence text's words that are aligned.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import once, small_batches, text_slices, words

#: Notices as they are commonly written; a parameter of license_scan.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT notice": "Released under the MIT License",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0",
    "BSD redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "All rights reserved": "All rights reserved",
}
COVERAGE = 0.8
#: A match lies within this many times its licence text's words, and a few more.
STRETCH, SLACK = 1.5, 4


def templates_in(spark: SparkSession, folder: str) -> dict[str, str]:
    """Licence texts of a folder, a file each, by the files' names without their ending; empty files are left out."""
    name = F.regexp_replace(F.element_at(F.split(F.url_decode(F.input_file_name()), "/"), -1), r"\.[^.]*$", "")
    rows = spark.read.text(folder, wholetext=True).select(name.alias("name"), "value").where("trim(value) <> ''")
    return {r.name: r.value for r in rows.orderBy("name").collect()}


def patience(a: list, b: list, a0: int = 0, b0: int = 0) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b), increasing in both."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(a0 + k, b0 + k) for k in range(head)]
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    if mid_a and mid_b:
        in_a, in_b = Counter(mid_a), Counter(mid_b)
        where = {w: k for k, w in enumerate(mid_a)}
        anchors = increasing([(where[w], k) for k, w in enumerate(mid_b) if in_b[w] == 1 and in_a.get(w) == 1])
        if anchors:
            last_a = last_b = 0
            for x, y in [*anchors, (len(mid_a), len(mid_b))]:
                out += patience(mid_a[last_a:x], mid_b[last_b:y], a0 + head + last_a, b0 + head + last_b)
                if x < len(mid_a):
                    out.append((a0 + head + x, b0 + head + y))
                last_a, last_b = x + 1, y + 1
    return out + [(a0 + len(a) - tail + k, b0 + len(b) - tail + k) for k in range(tail)]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence that increases in the first number; pairs are sorted by the second."""
    ends: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (x, _) in enumerate(pairs):
        j = bisect_left(ends, x)
        before[k] = at[j - 1] if j else -1
        if j == len(ends):
            ends.append(x)
            at.append(k)
        else:
            ends[j], at[j] = x, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def matches(seq: list, place: list, template: list, least: float) -> list[tuple[int, int, int]]:
    """(aligned words, first word, last word) of the best stretches that don't overlap; seq holds the template's words at their places."""
    m, need = len(template), -(-int(least * len(template) * 1000) // 1000)
    opening, distinct = set(template[: m - need + 1]), set(template)
    reach, found, k = int(STRETCH * m) + SLACK, [], 0
    while k < len(seq):
        skip = k + 1
        if seq[k] in opening:
            part = seq[k : bisect_left(place, place[k] + reach, k)]
            if len(part) >= need and len(set(part)) >= least * len(distinct) - (m - len(distinct)):
                pairs = patience(part, template)
                if len(pairs) >= need:
                    found.append((len(pairs), place[k + pairs[0][0]], place[k + pairs[-1][0]]))
                    if len(pairs) == m:
                        skip = k + pairs[-1][0] + 1  # nothing better overlaps it
        k = skip
    taken: list[tuple[int, int, int]] = []  # by first word
    for n, first, last in sorted(set(found), key=lambda x: (-x[0], x[2] - x[1], x[1])):
        at = bisect_left(taken, first, key=lambda x: x[1])
        if (at == 0 or taken[at - 1][2] < first) and (at == len(taken) or taken[at][1] > last):
            taken.insert(at, (n, first, last))
    return taken


def prepare(templates: dict[str, str]):
    doc, h, _ = words(pa.array(list(templates.values()), pa.string()))
    vocabulary, term = np.unique(h, return_inverse=True)
    lists = [term[doc == k].tolist() for k in range(len(templates))]
    holds = np.zeros((len(templates), len(vocabulary)), np.float32)
    for k, seq in enumerate(lists):
        holds[k, seq] = 1
    return vocabulary, lists, holds


def scan_texts(text: pa.Array, templates: dict[str, str], least: float) -> list[tuple[int, int, int, int, int]]:
    """(text, template, aligned words, first word, last word) of every match that reaches `least`."""
    vocabulary, lists, holds = once(f"licences {hash(tuple(templates.items()))}", lambda: prepare(templates))
    doc, h, place = words(text)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    known = vocabulary[at] == h
    doc, term, place = doc[known], at[known], place[known]
    there = np.zeros((len(text), len(vocabulary)), np.float32)
    there[doc, term] = 1
    distinct, size = holds.sum(1), np.array([len(x) for x in lists])
    # Aligned words are at most those of the distinct words that occur, and all their repeats.
    enough = there @ holds.T + (size - distinct) >= least * size - 1e-6
    first, out = np.searchsorted(doc, np.arange(len(text) + 1)), []
    for d, k in zip(*(x.tolist() for x in np.nonzero(enough))):
        mine = slice(first[d], first[d + 1])
        use = holds[k, term[mine]] > 0
        out += [(d, k, *found) for found in matches(term[mine][use].tolist(), place[mine][use].tolist(), lists[k], least)]
    return out


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, first_word, n_words): the matches of each licence text in each document.

    Only matches that cover at least `least` of the licence text's words are given; first_word and n_words
    say where in the document, in words (runs of letters and digits, in lower case). Of matches of one licence
    text that overlap the best is given, then the shortest, then the first. Null and empty texts match nothing; a null doc_id stays null;
    repeated rows are scanned each. Documents are scanned whole. Other columns aren't read.
    """
    templates = dict(TEMPLATES if templates is None else templates)
    names = list(templates)

    def run(batches):
        for batch in text_slices(batches):
            rows = scan_texts(batch.column("text"), templates, least)
            if rows:
                d, k, n, a, b = (np.array(x, np.int64) for x in zip(*rows))
                size = np.array([len(x) for x in once(f"licences {hash(tuple(templates.items()))}", lambda: prepare(templates))[1]])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), pa.array([names[x] for x in k]), pa.array(np.round(n / size[k], 6)), pa.array(a), pa.array(b - a + 1)], ["doc_id", "license", "coverage", "first_word", "n_words"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, license string, coverage double, first_word long, n_words long")
