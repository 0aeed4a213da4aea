"""License scans: an exact set-similarity join of text blocks with license notices, beside plain phrases.

A notice is a template, a set of words. A block is a window of a text's words, across line ends, of as many words as the
notice has beside a share of 1 - ``CONTAINMENT`` of other words; there is one at every word. It matches where it contains
at least ``CONTAINMENT`` of the template's words. The join is exact; a text whose words as a whole don't match has no block
that does, so texts are filtered first and the windows of the rest are counted in one sweep a template:

* one pass over all texts counts in how many of them each template word occurs, the global order of words, rarest first;
* of a template with n words, of which o = ceil(n x CONTAINMENT) must occur, the first n - o + 1 in that order are its
  prefix: a text without any of them can't match;
* the length filter drops texts with fewer than o words that are in any template;
* the positional filter drops a pair if the words from the first common one on are too few, in template or text, to
  reach o; the rest are verified on the sets, then by windows.

Templates are a fixed list, so the index is small and sent to every task; nothing is shuffled but the word counts.

Words are runs of ASCII letters and digits and all other characters beyond ASCII, with A-Z in lower case. Defined cases:
a null text is empty, has no words, labels '' and score 0; template words that occur equally often are in the order of their
bytes, on which no match depends; of overlapping windows of a template with as many of its words the first is given; repeated
rows give repeated rows; an empty table gives an empty table. Every step is linear in the text, for each template. Only the
named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_texts, tuned

CONTAINMENT = 0.8
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Fixed values of the contract: phrases and labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: The notices that licenses ask for or that are customary, and their labels.
NOTICES = (
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("mit", "Released under the MIT License."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


@dataclass(frozen=True)
class Index:
    """The templates in global order, and an index of their prefixes."""

    labels: tuple[str, ...]
    words: tuple[tuple[bytes, ...], ...]
    needed: tuple[int, ...]
    widths: tuple[int, ...]
    prefix: dict[bytes, list[tuple[int, int]]]
    rank: dict[bytes, int]


def universe(notices: tuple[tuple[str, str], ...]) -> frozenset[bytes]:
    return frozenset(w for _, t in notices for w in words_of(t))


def build_index(counts: dict[bytes, int], notices: tuple[tuple[str, str], ...] = NOTICES, containment: float = CONTAINMENT) -> Index:
    rank = {w: i for i, w in enumerate(sorted(universe(notices), key=lambda w: (counts.get(w, 0), w)))}
    words = tuple(tuple(sorted(set(words_of(t)), key=rank.__getitem__)) for _, t in notices)
    needed = tuple(ceil(len(w) * containment - 1e-9) for w in words)
    widths = tuple(ceil(len(words_of(t)) / containment - 1e-9) for _, t in notices)
    prefix: dict[bytes, list[tuple[int, int]]] = {}
    for k, (w, o) in enumerate(zip(words, needed, strict=True)):
        for i in range(len(w) - o + 1):
            prefix.setdefault(w[i], []).append((k, i))
    return Index(tuple(label for label, _ in notices), words, needed, widths, prefix, rank)


def match_block(words: list[bytes], index: Index) -> list[tuple[int, float]]:
    """(template, containment) of the templates that a block of words contains."""
    own = sorted(index.rank.keys() & words, key=index.rank.__getitem__)
    found, tried = [], set()
    for j, w in enumerate(own):
        for k, i in index.prefix.get(w, ()):
            if k in tried:
                continue
            tried.add(k)
            n, o = len(index.words[k]), index.needed[k]
            if len(own) < o or min(n - i, len(own) - j) < o:
                continue
            shared = len(set(index.words[k]).intersection(own))
            if shared >= o:
                found.append((k, shared / n))
    return found


def windows(hits: list[tuple[int, bytes]], needed: int, width: int) -> list[tuple[int, int, int]]:
    """(first word, end, distinct words) of windows with enough of the words in ``hits``; of overlapping ones the first best."""
    held: Counter[bytes] = Counter()
    out: list[tuple[int, int, int]] = []
    low = reach = 0
    for i, w in hits:
        held[w] += 1
        while hits[low][0] <= i - width or held[hits[low][1]] > 1:
            left = hits[low][1]
            held[left] -= 1
            if not held[left]:
                del held[left]
            low += 1
        if len(held) < needed:
            continue
        now = (hits[low][0], i + 1, len(held))
        if not out or now[0] >= reach:
            out.append(now)
        elif now[2] > out[-1][2]:
            out[-1] = now
        reach = i + 1
    return out


def matches(words: list[bytes], index: Index) -> list[tuple[int, int, int, float]]:
    """(first word, end, template, containment) of the windows of words that contain a template."""
    if index.prefix.keys().isdisjoint(words):
        return []
    whole = match_block(words, index)
    if not whole:
        return []
    hits = [(i, w) for i, w in enumerate(words) if w in index.rank]
    out = []
    for k, _ in whole:
        own = set(index.words[k])
        out += [(s, e, k, c / len(own)) for s, e, c in windows([h for h in hits if h[1] in own], index.needed[k], index.widths[k])]
    return sorted(out)


def places(words: list[bytes]) -> list[tuple[int, str]]:
    """(index of the first word, label) where a phrase's words stand one after the other."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in PHRASES:
        key = b" " + phrase.encode() + b" "
        at, seen, word = joined.find(key), 0, 0
        while at >= 0:
            word += joined.count(b" ", seen, at)  # each stretch is counted once
            seen = at
            out.append((word, label))
            at = joined.find(key, at + 1)
    return out


def word_counts(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many of all texts each word of the vocabulary occurs."""
    rows = docs.select(F.col(f"`{text_col}`").cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(vocabulary.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    tuned(docs.sparkSession)
    return {bytes(r.word): r.n for r in rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks); blocks are first:end:label of words."""

    def run(texts: list[str]) -> list[pa.Array]:
        rows = []
        for t in texts:
            words = words_of(t)
            base = places(words)
            found = matches(words, index)
            starts = [s for s, _ in base]
            base_labels = sorted({label for _, label in base})
            labels = sorted({*base_labels, *(index.labels[k] for _, _, k, _ in found)})
            score = 1.0 if base else max((c for *_, c in found), default=0.0)
            blocks = ",".join(f"{s}:{e}:{index.labels[k]}" for s, e, k, _ in found)
            rows.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(labels), score, blocks))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
        return [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]

    return map_texts(docs, text_col, [id_col], run, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks string")


def query(docs: DataFrame) -> DataFrame:
    return scan(docs, build_index(word_counts(docs, universe(NOTICES)))).drop("blocks")


def oracle_sql() -> str:
    """Phrases by position, and for each notice every window that begins at one of its words."""
    words = "regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    phrases = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES)
    index = build_index({})
    notices = ", ".join(f"({k}, '{label}', {[w.decode() for w in index.words[k]]!r}, {index.widths[k]}, {index.needed[k]})" for k, label in enumerate(index.labels))
    return f"""
WITH phrases(p, label) AS (VALUES {phrases}), notices(k, label, t, width, needed) AS (VALUES {notices}),
docs AS (SELECT doc_id, {words.format(t="coalesce(text, '')")} AS w FROM documents),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(1, len(w) - len(p) + 2), lambda i: w[i:i + len(p) - 1] = p)) - 1 AS pos FROM docs, phrases),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word FROM places GROUP BY doc_id),
likely AS (SELECT doc_id, w, k, label, t, width, needed FROM docs, notices WHERE len(list_intersect(list_distinct(w), t)) >= needed),
hits AS (SELECT doc_id, k, label, len(t) AS n, width, needed, unnest(list_filter(list_zip(w, range(len(w))), lambda x: list_contains(t, x[1]))) AS h FROM likely),
own_words AS (SELECT doc_id, k, label, n, width, needed, h[1] AS word, h[2] AS pos FROM hits),
windows AS (
  SELECT a.doc_id, a.label, a.n, a.needed, count(DISTINCT b.word) AS c FROM own_words a JOIN own_words b ON a.doc_id = b.doc_id AND a.k = b.k AND b.pos >= a.pos AND b.pos < a.pos + a.width
  GROUP BY a.doc_id, a.k, a.label, a.n, a.needed, a.pos),
good AS (SELECT doc_id, label, c::DOUBLE / n AS c FROM windows WHERE c >= needed),
own AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM places GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM good) GROUP BY doc_id),
best AS (SELECT doc_id, max(c) AS c FROM good GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(own.l, '') AS base_labels, coalesce(every.l, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM docs d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)"""
