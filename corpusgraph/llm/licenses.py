"""Licence scans by a positional index of rare words.

Licence words are ranked by their inverse document frequency over all files;
wherever the highest of a template's mandatory phrase stands in a file, the
template counts when its phrase stands there and enough of its words agree in
position.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import hash_word, word_hashes

#: Phrases that label a file by themselves.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Fixed values: (label, template words, mandatory phrase in them); wording of the public licences.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "licensed under the gnu general public license version 2", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("proprietary", "all rights reserved", "all rights reserved"),
)
#: Share of a template's IDF that must agree in position.
AGREE = 0.7
_BREAK = np.ones(256, dtype=bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


class Index:
    """Templates by word hash, with the words' places."""

    def __init__(self, templates=TEMPLATES):
        self.labels = [t[0] for t in templates]
        words = [t[1].split() for t in templates]
        self.vocabulary = sorted({w for t in words for w in t})
        self.hashes = np.array([hash_word(w) for w in self.vocabulary], dtype=np.uint64)
        order = np.argsort(self.hashes)
        self.vocabulary, self.hashes = [self.vocabulary[i] for i in order], self.hashes[order]
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.words = [[number[w] for w in t] for t in words]
        self.phrase = []
        for (_, whole, phrase), _t in zip(templates, words, strict=True):
            w, p = whole.split(), phrase.split()
            self.phrase.append(next((i, len(p)) for i in range(len(w)) if w[i : i + len(p)] == p))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The vocabulary's number of each hash, -1 for other words."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def rarest(self, idf: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """The word of highest IDF in each template's mandatory phrase, with the templates and places it has them by."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, (at, n) in enumerate(self.phrase):
            k = max(range(at, at + n), key=lambda k: (idf[self.words[t][k]], -k))
            out[self.words[t][k]].append((t, k))
        return out

    def match(self, places: np.ndarray, numbers: np.ndarray, idf: np.ndarray, probes: dict[int, list[tuple[int, int]]]) -> dict[str, float]:
        """Label to score of a file whose licence words (numbers) stand at places; probes are those of ``rarest``."""
        own = dict(zip(places.tolist(), numbers.tolist(), strict=True))
        found: dict[str, float] = {}
        for place, w in own.items():
            for t, k in probes.get(w, ()):
                words, start = self.words[t], place - k
                at, n = self.phrase[t]
                if all(own.get(start + i) == words[i] for i in range(at, at + n)):
                    score = sum(idf[w] for i, w in enumerate(words) if own.get(start + i) == w) / sum(idf[w] for w in words)
                    if score >= AGREE:
                        found[self.labels[t]] = max(found.get(self.labels[t], 0.0), score)
        return found


def document_frequency(docs: DataFrame, text: str, index: Index) -> tuple[np.ndarray, int]:
    """For each vocabulary word, in how many of all documents it stands, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(index.vocabulary), dtype=np.int64), 0
        for batch in batches:
            hashes, bounds, _, _ = word_hashes(batch.column(0), _BREAK)
            number = index.numbers(hashes)
            hit = np.flatnonzero(number >= 0)
            doc = np.searchsorted(bounds, hit, side="right") - 1
            pairs = np.unique(doc * len(total) + number[hit])
            total += np.bincount(pairs % len(total), minlength=len(total))
            rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(total)), -1]), pa.array([*total.tolist(), rows])], ["word", "n"])

    sums = {r[0]: r[1] for r in docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n")).collect()}
    return np.array([sums.get(i, 0) for i in range(len(index.vocabulary))]), sums.get(-1, 0)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES) -> DataFrame:
    """A row for each row of ``docs``: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of letters and digits.  A null or empty text has none: its
    counts are 0, its labels empty and its score 0.  Keys may be null or
    repeat.  score is the best template's share of agreeing IDF, at least 0.5
    where a base phrase stands.  An empty table gives no rows; other columns
    are not looked at.
    """
    index = Index(templates)
    frequency, n = document_frequency(docs, text, index)
    idf = np.array([math.log((n + 1) / (f + 1)) + 1e-3 for f in frequency])
    probes = index.rarest(idf)
    probed = np.isin(np.arange(len(index.vocabulary)), list(probes))
    base = [([np.uint64(hash_word(w)) for w in phrase.split()], label) for phrase, label in BASE]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, bounds, _, _ = word_hashes(batch.column("_text"), _BREAK)
            rows = batch.num_rows
            count, first, last = np.zeros(rows, np.int64), np.full(rows, -1, np.int64), np.full(rows, -1, np.int64)
            labels: dict[int, set[str]] = defaultdict(set)
            score: dict[int, float] = defaultdict(float)
            for words, label in base:
                size = len(words)
                at = np.flatnonzero(hashes[: max(0, len(hashes) - size + 1)] == words[0])
                for j in range(1, size):
                    at = at[hashes[at + j] == words[j]]
                doc = np.searchsorted(bounds, at, side="right") - 1
                whole = at + size <= bounds[doc + 1]
                for d, i in zip(doc[whole].tolist(), (at - bounds[doc])[whole].tolist(), strict=True):
                    count[d] += 1
                    first[d] = i if first[d] < 0 else min(first[d], i)
                    last[d] = max(last[d], i)
                    labels[d].add(label)
                    score[d] = 0.5
            bases = [",".join(sorted(labels.get(d, ()))) for d in range(rows)]
            number = index.numbers(hashes)
            hit = np.flatnonzero(number >= 0)
            doc = np.searchsorted(bounds, hit, side="right") - 1
            edges = np.searchsorted(doc, np.arange(rows + 1))
            looked_up = np.bincount(doc[probed[number[hit]]], minlength=rows)
            for d in np.flatnonzero(looked_up).tolist():
                a, b = edges[d], edges[d + 1]
                for label, s in index.match(hit[a:b] - bounds[d], number[hit[a:b]], idf, probes).items():
                    labels[d].add(label)
                    score[d] = max(score[d], s)
            none = first < 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(np.diff(bounds)), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none), pa.array(bases), pa.array([",".join(sorted(labels.get(d, ()))) for d in range(rows)]), pa.array([float(min(1.0, score.get(d, 0.0))) for d in range(rows)])],
                ["_key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    out = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return out.withColumnRenamed("_key", key)
