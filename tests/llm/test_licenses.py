import math
import random
import re

from corpusgraph.llm import licenses

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = [
    (200, "This work is licensed under the GNU General Public License, version 3.", "gpl"),
    (201, "Released under the MIT License. mit-license, again: MIT LICENSE", "mit"),
    (202, "Apache  License\n(Version 2.0) and mit license", "apache,mit"),
    (203, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "mit"),
    (204, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "bsd"),
    (205, "Permission was denied. The charge was free of grants to any person, hereby obtaining software.", ""),
    (206, "the general public has a license", ""),
]


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_and_labels(spark, rows):
    df = spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)] + [(10_000 + e[0], e[1]) for e in EXTRA], "doc_id long, text string")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert set(got) == set(texts)
    for k, r in got.items():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[k]), texts[k][:80]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1
    assert {k: got[10_000 + k].labels for k, _, _ in EXTRA} == {k: x for k, _, x in EXTRA}


def test_every_template_of_a_long_file(spark):
    """Third-party notices with all templates, and the words of all others around each one."""
    vocabulary = " ".join(sorted({w for t in licenses.TEMPLATES for w in t[1].split()}))
    made = [(0, " x ".join(t[1] for t in licenses.TEMPLATES))] + [(i, f"{vocabulary} x {t[1]} x {vocabulary}") for i, t in enumerate(licenses.TEMPLATES, 1)]
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got[0] == {t[0] for t in licenses.TEMPLATES}
    for i, t in enumerate(licenses.TEMPLATES, 1):
        assert t[0] in got[i], t


def test_labels_by_brute_force(spark):
    """Every template at every place: its phrase whole, and enough of its words where they should be, by IDF over all files."""
    rng = random.Random(8)
    vocabulary = sorted({w for t in licenses.TEMPLATES for w in t[1].split()})
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(0, 5)):
            words = rng.choice(licenses.TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                words[rng.randrange(len(words))] = rng.choice([*vocabulary, "x", "y"])
            parts.append(" ".join(words))
            parts.append(" ".join(rng.choice([*vocabulary, "z"]) for _ in range(rng.randrange(0, 6))))
        texts.append(" ".join(parts))
    words = [t.split() for t in texts]
    idf = {w: math.log((len(texts) + 1) / (sum(w in t for t in words) + 1)) + 1e-3 for w in vocabulary}
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    for i, own in enumerate(words):
        found = {}
        for label, whole, phrase in licenses.TEMPLATES:
            t, p = whole.split(), phrase.split()
            at = next(k for k in range(len(t)) if t[k : k + len(p)] == p)
            for place in range(len(own) - len(p) + 1):
                if own[place : place + len(p)] == p:
                    start = place - at
                    agree = sum(idf[w] for k, w in enumerate(t) if 0 <= start + k < len(own) and own[start + k] == w) / sum(idf[w] for w in t)
                    if agree >= licenses.AGREE:
                        found[label] = max(found.get(label, 0), agree)
        base = {label for phrase, label in licenses.BASE if f" {phrase} " in f" {' '.join(own)} "}
        assert set(filter(None, got[i].labels.split(","))) == set(found) | base, texts[i]
        assert abs(got[i].score - max([*found.values(), 0.5 * bool(base)])) < 1e-9


def test_edges(clashing, docs, empty, same):
    same(licenses.scan(clashing), licenses.scan(docs))
    assert licenses.scan(empty).count() == 0
