"""Operator 9: license scans as an exact set-similarity join of text blocks and templates.

A block is a line of a text (between line feeds) or, since license texts are hard-wrapped, a
window of a text's consecutive words: one at every start, with as many words as the template
has / ``containment``, across line feeds. It meets a template if it has at least
``containment`` of the template's distinct words. Words have one global order, by their
number of occurrences in all texts (rarest first, ties by the word). With t words in a
template and o = ceil(containment * t) of them needed: prefix filter - a block that meets
it has one of the t - o + 1 rarest; length filter - it has at least o words of templates;
positional filter - o can still be reached with what follows its first prefix word in
either order (lines only). Survivors are counted exactly, so the join misses nothing.
A short template is met by blocks that have the words which name its license (``NAMING``),
or any sentence of its kind would do.

Templates are few and fixed (a parameter); texts never leave their task, whatever their length:
long ones are taken whole, rows are cut into blocks of texts. Repeated rows have their results
each, an empty table has none. A kept column with the name of a result goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, ascii_lower, blocks, kept, read_table, utf8, word_hash

# Phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Sentences of public license texts and of the notices by which files name a license.
TEMPLATES = [
    ("mit-notice", "released under the mit license"),
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("apache-header", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-header", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd-redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
]

# The words that name the license of a template.
NAMING = {"mit-notice": "mit", "apache-notice": "apache", "gpl-notice": "general public", "apache-header": "apache", "gpl-header": "general public", "mpl-notice": "mozilla", "cc-by": "creative commons"}


def _inside(data: np.ndarray) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ((48, 58), (65, 91), (97, 123), (128, 256)):
        table[a:b] = True
    return table[data]


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, _inside(data), ascii_lower())


@dataclass
class Plan:
    """Template words in global order, their hashes sorted, and each template as ranks in that order."""

    hashes: np.ndarray
    ranks: np.ndarray
    templates: list[tuple[str, np.ndarray, int, int, int, list[int]]]  # label, sorted ranks, words needed, prefix, words of a window, ranks of naming words
    phrases: list[tuple[list[int], str]]
    words: list[bytes]


def _vocabulary(templates) -> list[str]:
    return sorted({w for _, t in templates for w in t.split()} | {w for p, _ in PHRASES for w in p.split()})


def word_frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, int]:
    """Occurrences of each vocabulary word in all texts: one sum a word reaches the driver."""
    hashes = np.array([word_hash(w.encode()) for w in vocabulary], np.uint64)
    order = np.argsort(hashes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for whole in batches:
            for batch in blocks(whole, "__text"):
                at = _look_up(hashes[order], words_of(*utf8(batch.column("__text"))).hash)
                total += np.bincount(order[at[at >= 0]], minlength=len(vocabulary))
        yield pa.RecordBatch.from_pydict({"word": vocabulary, "n": total})

    rows = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("__text")).mapInArrow(count, "word string, n long")
    return {r["word"]: r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _look_up(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return np.where(hashes[at] == keys, at, -1)


def make_plan(frequency: dict[str, int], templates=TEMPLATES, containment: float = 0.8) -> Plan:
    vocabulary = sorted(_vocabulary(templates), key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(vocabulary)}
    hashes = np.array([word_hash(w.encode()) for w in vocabulary], np.uint64)
    order = np.argsort(hashes)
    made = []
    for label, t in templates:
        own = np.array(sorted({rank[w] for w in t.split()}), np.int64)
        need = -int(-containment * len(own) // 1)
        made.append((label, own, need, len(own) - need + 1, -int(-len(t.split()) / containment // 1), [rank[w] for w in NAMING.get(label, "").split()]))
    return Plan(hashes[order], order, made, [([rank[w] for w in p.split()], label) for p, label in PHRASES], [w.encode() for w in vocabulary])


def best_windows(rank: np.ndarray, doc: np.ndarray, own: np.ndarray, need: int, prefix: int, span: int, naming: list[int] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(row, distinct words of the template ``own``) of each window of ``span`` words with ``need`` or more,
    all ``naming`` ones among them. A window begins at a word of the template: an earlier start adds none."""
    at = np.flatnonzero(np.isin(rank, own))
    place = at + doc[at] * span  # no window spans two rows
    end = np.searchsorted(place, place + span)
    lead = np.concatenate([[0], np.cumsum(np.isin(rank[at], own[:prefix]))])
    i = np.arange(len(at))
    fit = (end - i >= need) & (lead[end] > lead[i])  # length and prefix filters
    for r in naming:
        named = np.concatenate([[0], np.cumsum(rank[at] == r)])
        fit &= named[end] > named[i]
    start = np.flatnonzero(fit)
    order = np.argsort(rank[at], kind="stable")
    same = np.flatnonzero(np.diff(rank[at][order]) == 0)
    before = np.full(len(at), -1, np.int64)  # where the word was last
    before[order[same + 1]] = order[same]
    met = np.zeros(len(start), np.int64)
    for a in range(0, len(start), 1 << 14):
        s = start[a : a + (1 << 14), None]
        j = s + np.arange(span)
        met[a : a + (1 << 14)] = ((j < end[s]) & (before[np.minimum(j, len(at) - 1)] < s)).sum(1)
    ok = met >= need
    return doc[at[start[ok]]], met[ok]


def scan_words(plan: Plan, w: Words, lines: np.ndarray):
    """Per row: (n_base, first, last, base labels, labels, score). ``lines``: the block number of each word."""
    rank = np.full(len(w.hash), -1, np.int64)
    at = _look_up(plan.hashes, w.hash)
    rank[at >= 0] = plan.ranks[at[at >= 0]]
    known = np.flatnonzero(rank >= 0)
    fold = ascii_lower()
    rows = len(w.first) - 1
    n, first, last = np.zeros(rows, np.int64), np.full(rows, -1, np.int64), np.full(rows, -1, np.int64)
    base = [set() for _ in range(rows)]
    more = [set() for _ in range(rows)]
    score = np.zeros(rows)
    for phrase, label in plan.phrases:
        hit = known[rank[known] == phrase[0]]
        hit = hit[hit + len(phrase) <= len(w.hash)]
        for k, r in enumerate(phrase):
            hit = hit[(rank[hit + k] == r) & (w.doc[hit + k] == w.doc[hit])]
        for i in hit.tolist():
            if all(fold[w.data[w.start[i + k] : w.end[i + k]]].tobytes() == plan.words[r] for k, r in enumerate(phrase)):
                doc = int(w.doc[i])
                place = i - int(w.first[doc])
                n[doc] += 1
                first[doc] = place if first[doc] < 0 else min(first[doc], place)
                last[doc] = max(last[doc], place)
                base[doc].add(label)
    # blocks: distinct template words of each, rarest first
    key = np.unique(lines[known] * (len(plan.hashes) + 1) + rank[known])
    line, r = np.divmod(key, len(plan.hashes) + 1)
    begin = np.flatnonzero(np.diff(line, prepend=-1))
    size = np.diff(np.append(begin, len(line)))
    row_of_line = np.zeros(int(lines.max()) + 1 if len(lines) else 0, np.int64)
    row_of_line[lines] = w.doc
    for label, own, need, prefix, span, naming in plan.templates:
        for doc, met in zip(*(v.tolist() for v in best_windows(rank, w.doc, own, need, prefix, span, naming)), strict=True):
            more[doc].add(label)
            score[doc] = max(score[doc], met / len(own))
        lead = np.flatnonzero(np.isin(r, own[:prefix]))  # prefix filter
        if not len(lead):
            continue
        block = np.searchsorted(begin, lead, "right") - 1
        block, first_lead = np.unique(block, return_index=True)
        lead = lead[first_lead]
        rest = begin[block] + size[block] - lead - 1
        left = len(own) - np.searchsorted(own, r[lead]) - 1
        fit = (size[block] >= need) & (1 + np.minimum(rest, left) >= need)  # length and positional filters
        for b in block[fit].tolist():
            block_words = r[begin[b] : begin[b] + size[b]]
            met = int(np.isin(block_words, own, assume_unique=True).sum())
            if met >= need and np.isin(naming, block_words).all():
                doc = int(row_of_line[line[begin[b]]])
                more[doc].add(label)
                score[doc] = max(score[doc], met / len(own))
    score[n > 0] = np.maximum(score[n > 0], 1.0)
    return n, first, last, base, more, score


def line_numbers(w: Words) -> np.ndarray:
    """The block of each word: line feeds and row starts begin a new one."""
    feeds = np.cumsum(w.data == 10)
    return feeds[w.start] + w.doc if len(w.start) else np.zeros(0, np.int64)


def scan(docs: DataFrame, keep: list[str], plan: Plan, text: str = "text") -> DataFrame:
    """Columns ``keep`` with n_words, n_base, first_word, last_word, base_labels, labels and score
    (1 with a base phrase, else the largest containment among templates that are met, else 0).
    Null text counts as empty: no words, no labels, null places."""
    results = (("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double"))
    keep = kept(keep, [name for name, _ in results])
    rows = docs.select(*keep, F.coalesce(text, F.lit("")).alias("__text"))
    schema = rows.select(*keep).schema
    for name, kind in results:
        schema = schema.add(name, kind)
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "__text"):
                w = words_of(*utf8(batch.column("__text")))
                n, first, last, base, more, score = scan_words(shared.value, w, line_numbers(w))
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in keep), pa.array(np.diff(w.first).astype(np.int64)), pa.array(n),
                        pa.array(first, mask=none), pa.array(last, mask=none),
                        pa.array([",".join(sorted(b)) for b in base], pa.string()), pa.array([",".join(sorted(b | m)) for b, m in zip(base, more, strict=True)], pa.string()), pa.array(score),
                    ],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scan(docs, ["doc_id"], make_plan(word_frequencies(docs, _vocabulary(TEMPLATES))))
