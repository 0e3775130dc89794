import math
import re
from collections import Counter

import numpy as np
import pytest

from corpusgraph.llm import lm

from .conftest import held_out

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def toks(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), "\x02"]


def test_base_scores(docs, rows):
    train = [r for r in rows if not (r[0] is not None and held_out(r[0], 7, 2))]
    counts = Counter(t for r in train for t in toks(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(r[0]), len(toks(r[1])), sum(counts[t] > 0 for t in toks(r[1])), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in toks(r[1])), 6)) for r in rows)
    got = lm.score(docs).collect()
    base = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    for a, b in zip(base, want, strict=True):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], abs=1e-5)
    assert all(r.held_out == (r.doc_id is not None and held_out(r.doc_id, 7, 2)) for r in got)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_blocks_and_ranges_change_no_count(docs, monkeypatch):
    counted = lambda: sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in lm.score(docs).collect())
    before = counted()
    monkeypatch.setattr(lm, "BLOCK", 4000)
    monkeypatch.setattr(lm, "RANGE", 9000)
    assert counted() == before


def test_scores(docs, rows, monkeypatch):
    """score by brute force, for weights that depend on the context's bucket."""
    some = np.random.default_rng(3).dirichlet([1, 1, 1], lm.BUCKETS + 1)
    some[0] = [0, 0.7, 0.3]
    monkeypatch.setattr(lm, "learn", lambda cells, n, v: some)
    train = [toks(r[1]) for r in rows if not (r[0] is not None and held_out(r[0], 7, 2))]
    one, two = Counter(t for d in train for t in d), Counter(p for d in train for p in zip(["\x01", *d[:-1]], d, strict=True))
    n, v, context = sum(one.values()), len(one), {**one, "\x01": len(train)}
    want = []
    for key, text, *_ in rows:
        total, before = 0.0, "\x01"
        for t in toks(text):
            seen = context.get(before, 0)
            a, b, c = some[min(seen.bit_length(), lm.BUCKETS)]
            total += math.log10(a * (two[before, t] / seen if seen else 0) + b * one[t] / n + c / (v + 1))
            before = t
        want.append((str(key), total))
    got = sorted((str(r.doc_id), r.score) for r in lm.score(docs).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-6)


def test_weights_are_those_of_plain_em():
    """On cells of held-out events, against a loop over single events."""
    cells = [(3, -4, 5, 10), (3, -1000, 2, 4), (3, -2, 3, 7), (1, -1000, 4, 5), (1, -3, 1, 2)]
    n, v = 1000, 50
    got = lm.learn([(a, b, c, float(e)) for a, b, c, e in cells], n, v)
    for bucket in (1, 3):
        events = [(min(1, math.exp((b + 0.5) * lm.CELL)) if b > -1000 else 0.0, math.exp((c + 0.5) * lm.CELL) / n) for a, b, c, e in cells if a == bucket for _ in range(e)]
        w = [0.4, 0.4, 0.2]
        for _ in range(lm.ROUNDS):
            sums = [1.0, 1.0, 1.0]
            for p in events:
                parts = [w[0] * p[0], w[1] * p[1], w[2] / (v + 1)]
                sums = [s + x / sum(parts) for s, x in zip(sums, parts, strict=True)]
            w = [s / sum(sums) for s in sums]
        assert np.allclose(got[bucket], w)


def test_repeated_rows_are_dealt_to_all_blocks(spark, tmp_path):
    """Rows of a file and of any other frame get numbers of their own."""
    rows = spark.createDataFrame([(None, None)] * 300 + [(1, "a b")] * 300, "doc_id long, text string")
    rows.write.parquet(str(tmp_path / "t"))
    for frame in (rows, spark.read.parquet(str(tmp_path / "t"))):
        named, place = lm.numbered(frame, ["doc_id", "text"])
        assert named.select(*place).distinct().count() == 600
    assert lm.score(spark.read.parquet(str(tmp_path / "t"))).count() == 600


def test_it_is_a_distribution_that_beats_its_base(spark):
    """On text with an order, held-out perplexity falls well below the unigram's."""
    rng = np.random.default_rng(2)
    follow = {i: rng.permutation(200)[:4] for i in range(200)}
    docs = []
    for k in range(700):
        w, at = [], int(rng.integers(200))
        for _ in range(80):
            w.append(f"w{at}")
            at = int(follow[at][rng.integers(4)])
        docs.append((k, " ".join(w)))
    got = [r for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.held_out]
    n = sum(r.n_tokens for r in got)
    assert 10 ** (-sum(r.score for r in got) / n) < 8 < 100 < 10 ** (-sum(r.base_score for r in got) / n)


def test_weights_sum_to_one():
    w = lm.learn([(3, -4, 5, 10.0), (3, -1000, 2, 4.0), (0, -1000, -1000, 3.0)], 1000, 50)
    assert np.allclose(w.sum(axis=1), 1)
    assert (w >= 0).all() and w[0, 0] == 0


def test_edges(clashing, docs, empty, same):
    keep = ["doc_id", "n_tokens", "n_known", "train_tokens"]
    same(lm.score(clashing).select(keep), lm.score(docs).select(keep))
    assert lm.score(empty).count() == 0
