"""Licence scan with a positional rare-token index.

Each template is a run of words.  The index keeps, for its rarest words (fewest documents
of the scanned table), postings (word -> template, position).  A document looks up its
words in the index, rarest first; a hit at word p with a posting at position q votes for
the template starting at p - q.  Starts with enough votes are verified: the template's
mandatory phrases must stand word for word at their places, and the share of template
words that stand at theirs becomes the score.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import slices, text_bytes

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# Rarest words of a template that get postings, and the share of these that must vote for a start.
RARE_WORDS = 3
VOTES = 0.6
# Share of a template's words that must stand at their places.
FULL_SHARE = 0.75

# fixed values: phrases the scan is asked for, and their labels
BASE = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
# fixed values: opening words of public licence notices; the phrase after the bar must stand word for word
NOTICES = (
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge"),
    ("mit-release", "released under the mit license", "mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl-notice", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-program", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrase_at: int
    phrase: tuple[bytes, ...]
    base: bool


def templates() -> list[Template]:
    out = [Template(label, w := tuple(text.encode().split()), 0, w, True) for label, text in BASE]
    for label, text, phrase in NOTICES:
        words, key = tuple(text.encode().split()), tuple(phrase.encode().split())
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        out.append(Template(label, words, at, key, False))
    return out


@dataclass
class Index:
    """Postings of the rare words: word -> (template number, position)."""

    templates: list[Template]
    postings: dict[bytes, list[tuple[int, int]]]
    idf: dict[bytes, float]
    needed: list[int]

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, list[str], list[str], float]:
        """n_words, n_base, first and last base start, base labels, all labels, score."""
        words = WORD.findall(text.lower())
        postings = self.postings
        hits = [(i, w) for i, w in enumerate(words) if w in postings]
        votes: dict[tuple[int, int], int] = defaultdict(int)
        for i, w in sorted(hits, key=lambda h: -self.idf[h[1]]):
            for number, at in postings[w]:
                votes[number, i - at] += 1
        places: set[tuple[int, int]] = set()
        labels: dict[str, float] = {}
        base: set[str] = set()
        for (number, start), n in votes.items():
            if start < 0 or n < self.needed[number]:
                continue
            t = self.templates[number]
            at = start + t.phrase_at
            if tuple(words[at : at + len(t.phrase)]) != t.phrase:
                continue
            share = sum(a == b for a, b in zip(words[start : start + len(t.words)], t.words, strict=False)) / len(t.words)
            if share >= FULL_SHARE:
                labels[t.label] = max(labels.get(t.label, 0.0), share)
                if t.base:
                    base.add(t.label)
                    places.add((number, start))
        starts = [s for _, s in places]
        return len(words), len(places), min(starts, default=None), max(starts, default=None), sorted(base), sorted(labels), max(labels.values(), default=0.0)


def build_index(docs: DataFrame, text_col: str = "text", known: list[Template] | None = None) -> Index:
    """Index whose rare words follow from the document frequencies of all of ``docs``."""
    known = templates() if known is None else known
    vocabulary = frozenset(w for t in known for w in t.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for part in slices(batch, "text"):
                for text in text_bytes(part.column(0)):
                    n[b""] += 1
                    for w in vocabulary.intersection(WORD.findall(text.lower())):
                        n[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    seen = {r.word.encode(): r.n for r in rows.toLocalIterator()}  # as many rows as the templates have words
    total = seen.get(b"", 0)
    idf = {w: math.log((total + 1) / (seen.get(w, 0) + 1)) for w in vocabulary}
    postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
    needed = []
    for number, t in enumerate(known):
        rare = sorted(set(t.words), key=lambda w: (-idf[w], w))[: 1 if t.base else RARE_WORDS]
        spots = [(i, w) for i, w in enumerate(t.words) if w in rare]
        for i, w in spots:
            postings[w].append((number, i))
        needed.append(max(1, math.ceil(VOTES * len(spots))))
    return Index(known, dict(postings), idf, needed)


def scan(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row.

    ``score`` is the best share of template words found in place (1 for a whole template, 0
    without any).  A null or empty text has no words, no labels and score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [shared.value.scan(t) for t in text_bytes(part.column(1))]
                cols = list(zip(*found, strict=True)) if found else [[]] * 7
                kinds = (pa.int64(),) * 4 + (pa.list_(pa.string()),) * 2 + (pa.float64(),)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True))],
                    ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    schema = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double"
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {schema}").withColumnRenamed("id", id_col)
