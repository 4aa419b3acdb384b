"""License scans: phrases, and an exact set-similarity join of text blocks with license templates (operator 13).

Words are runs of digits, letters a-z (A-Z lower-cased) and all characters beyond ASCII.  A template is the set of the
distinct words of a license notice.  For a template of w words a document is cut into blocks of the least power of two of
words that is at least 2 * w (at least ``LEAST_BLOCK``), one block starting at every half block, so that each passage of
w words lies whole in some block.  The join finds every block that holds at least ``CONTAINED`` percent of a template's
words:

* template words are ordered by the number of documents that hold them, rarest first, counted over the whole corpus in a
  first pass (words of no template cannot matter for an overlap, so a block is its template words only);
* prefix: a template of n words that needs o of them shares one of its n - o + 1 rarest with the block, and one of the
  block's b - o + 1 rarest; only blocks around such words are looked at;
* length: b >= o; position: what follows the first shared word in both orders must still reach o;
* the blocks that are left are compared in full.

The templates are a fixed set of ``TEMPLATES`` (or the caller's); they go into the tasks with their words' order, so no
text is shuffled.  Every document is one row, its blocks never leave its task.

Defined cases: null text counts as empty and has no words; a document without places has null first_word and last_word,
empty label strings and score 0; repeated rows are each scanned; very long texts are scanned whole; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

CONTAINED = 90
LEAST_BLOCK = 16

# The phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Notices of public licenses and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("creative-commons", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SCHEMA = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
           "labels string, score double, matches array<struct<template: int, block: bigint, shared: int>>")


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())  # bytes.lower: A-Z alone


@dataclass(frozen=True)
class Template:
    """A template's words as ranks in the global order, ascending: the rarest first."""

    label: str
    ranks: tuple[int, ...]
    block: int
    needed: int

    @property
    def prefix(self) -> tuple[int, ...]:
        return self.ranks[:len(self.ranks) - self.needed + 1]


def block_words(words: int) -> int:
    """The block length of a template of so many words."""
    return max(LEAST_BLOCK, 1 << (2 * words - 1).bit_length())


def needed(distinct: int, percent: int) -> int:
    return max(1, -(-percent * distinct // 100))


def template_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> Counter:
    """The number of documents that hold each template word; a row a word comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                held.update(vocabulary.intersection(words_of(text.as_py())))
        yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in held], pa.string()),
                                          "n": pa.array(held.values(), pa.int64())})

    counts = docs.select(text_of(docs).alias("text")).mapInArrow(run, "word string, n bigint")
    return Counter({r.word.encode(): r.n for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()})


def ordered(templates: Sequence[tuple[str, str]], frequencies: Counter, percent: int
            ) -> tuple[dict[bytes, int], list[Template]]:
    """(rank of each template word, templates by ranks)."""
    words = [words_of(text) for _, text in templates]
    if not all(words):
        raise ValueError("a template needs words")
    rank = {w: k for k, w in enumerate(sorted({w for ws in words for w in ws}, key=lambda w: (frequencies[w], w)))}
    return rank, [Template(label, tuple(sorted({rank[w] for w in ws})), block_words(len(ws)),
                           needed(len(set(ws)), percent)) for (label, _), ws in zip(templates, words, strict=True)]


def matches(ranks: np.ndarray, templates: Sequence[Template]) -> list[tuple[int, int, int]]:
    """(template, first word of the block, shared words) for every block that holds enough of a template; ``ranks`` are
    those of a document's words, -1 for words of no template."""
    out = []
    blocks: dict[tuple[int, int], list[int]] = {}
    for t, template in enumerate(templates):
        half = template.block // 2
        spots = np.flatnonzero(np.isin(ranks, template.prefix))
        starts = np.unique(np.concatenate([spots // half, spots // half - 1]))
        for k in starts[starts >= 0].tolist():
            at = k * half
            if (at, template.block) not in blocks:
                held = np.unique(ranks[at:at + template.block])
                blocks[at, template.block] = held[held >= 0].tolist()
            block, o = blocks[at, template.block], template.needed
            if len(block) < o:
                continue
            lead = {r: j for j, r in enumerate(block[:len(block) - o + 1])}
            first = next(((i, lead[r]) for i, r in enumerate(template.prefix) if r in lead), None)
            if first is None or min(len(template.ranks) - first[0], len(block) - first[1]) < o:
                continue
            shared = len(set(template.ranks).intersection(block))
            if shared >= o:
                out.append((t, at, shared))
    return out


def phrase_places(words: list[bytes], phrases: Sequence[tuple[str, str]] = PHRASES) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand one after the other."""
    line, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases:
        spaced = f" {phrase} ".encode()
        at = line.find(spaced)
        while at >= 0:
            out.append((line.count(b" ", 0, at), label))
            at = line.find(spaced, at + 1)
    return out


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, percent: int = CONTAINED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 with a
    phrase, else the largest share of a template that a block holds, 0 without one) and matches (template, block: its
    first word, shared: number of template words in it)."""
    vocabulary = frozenset(w for _, text in templates for w in words_of(text))
    rank, known = ordered(templates, template_frequencies(docs, vocabulary), percent)
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _SCHEMA.split(", ")[:9]]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                ranks = np.fromiter((rank.get(w, -1) for w in words), np.int32, len(words))
                found = matches(ranks, known)
                base = phrase_places(words)
                starts = [at for at, _ in base]
                labels = {label for _, label in base}
                best = max((s / len(known[t].ranks) for t, _, s in found), default=0.0)
                out.append((doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None),
                            ",".join(sorted(labels)), ",".join(sorted(labels | {known[t].label for t, _, _ in found})),
                            1.0 if base else best, [{"template": t, "block": at, "shared": s} for t, at, s in found]))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct(
                [("template", pa.int32()), ("block", pa.int64()), ("shared", pa.int32())]))]
            cols = list(zip(*out, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, _SCHEMA)


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.drop("matches")
