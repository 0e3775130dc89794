import random

import numpy as np
import pytest

from corpusgraph.llm import decontam

RNG = random.Random(7)


def sentence(n, of=400):
    return " ".join("".join(RNG.choice("abcdefghijklmnoprstuvw") for _ in range(RNG.randrange(2, 9))) for _ in range(n))


ITEMS = [(i, sentence(30).capitalize() + ".") for i in range(12)] + [(50, None), (51, ""), (52, "..."), (0, "Second item of an id that repeats and is found as well.")]


def edited(text, share, seed):
    rng, s = random.Random(seed), list(text)
    for _ in range(int(len(text) * share)):
        at = rng.randrange(len(s))
        what = rng.randrange(3)
        if what == 0:
            s[at] = "q"
        elif what == 1:
            del s[at]
        else:
            s.insert(at, "q")
    return "".join(s)


def planted():
    rows, want = [], set()
    for i in range(60):
        pre, post = sentence(RNG.randrange(0, 120)), sentence(RNG.randrange(0, 120))
        k = i % 12
        kind = i % 5
        passage = [ITEMS[k][1], ITEMS[k][1].upper(), ITEMS[k][1].replace(" ", " \n"), edited(ITEMS[k][1], 0.05, i), ""][kind]
        rows.append((i, f"{pre} {passage} {post}", "x"))
        if kind < 4:
            want.add((i, k))
    rows += [(100, None, "x"), (101, "", "x"), (102, ITEMS[3][1], "x"), (103, f"ñandú 😀 {ITEMS[4][1]} ... {ITEMS[4][1]}", "x"), (None, ITEMS[5][1], "x"), (104, ITEMS[-1][1] + " more", "x")]
    return rows, want | {(102, 3), (103, 4), (None, 5), (104, 0)}


def distance(a, b):
    row = np.arange(len(b) + 1)
    for i, x in enumerate(a):
        new = np.empty_like(row)
        new[0] = i + 1
        for j, y in enumerate(b):
            new[j + 1] = min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1)
        row = new
    return int(row[-1])


def frames(spark):
    rows, want = planted()
    return spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string"), {r[0]: r[1] for r in rows}, want


def test_planted_passages(spark):
    docs, bench, texts, want = frames(spark)
    got = decontam.find(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    items = {}
    for k, t in ITEMS:
        items.setdefault(k, []).append(decontam.normalise(t or ""))
    for r in got:
        piece = decontam.normalise(texts[r.doc_id][r.start : r.end])
        assert min(distance(t, piece) for t in items[r.item_id]) == r.distance
        assert r.distance <= 0.1 * max(map(len, items[r.item_id]))
    assert sum(r.doc_id == 103 for r in got) == 2


def test_filter(spark):
    docs, bench, texts, want = frames(spark)
    kept = {r.doc_id for r in decontam.decontaminate(docs, bench).collect()}
    assert kept == set(texts) - {k for k, _ in want}


def test_embedding_keeps_equal_strings_equal_and_near_ones_near():
    texts = [sentence(40)[:200] for _ in range(30)]
    same = decontam.keys(texts, 195, 0)
    assert (same == decontam.keys(list(texts), 195, 0)).all()
    near = decontam.keys([edited(t, 0.03, i) for i, t in enumerate(texts)], 195, 0)
    far = decontam.keys([sentence(40)[:200] for _ in texts], 195, 0)
    assert (same == near).mean() > 10 * max((same == far).mean(), 0.001)


def test_slices_of_the_benchmark(spark, monkeypatch, same):
    docs, bench, _, _ = frames(spark)
    whole = decontam.find(docs, bench)
    monkeypatch.setattr(decontam, "AT_ONCE", 700)
    same(decontam.find(docs, bench), whole)


def test_edges(spark, docs, clashing, empty, same):
    bench = spark.createDataFrame([(1, docs.filter("doc_id = 60").first().text)], "item_id long, text string")
    same(decontam.find(clashing, bench), decontam.find(docs, bench))
    assert decontam.find(docs, bench).count() >= 1
    assert decontam.find(empty, bench).count() == 0
    assert decontam.find(docs, bench.limit(0)).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert decontam.decontaminate(clashing, bench).columns == clashing.columns


def worst(text, share, seed):
    """One edit inside each of the longest words."""
    rng, parts = random.Random(seed), text.split(" ")
    for i in sorted(range(len(parts)), key=lambda i: -len(parts[i]))[: int(len(text) * share)]:
        k = rng.randrange(len(parts[i]))
        parts[i] = parts[i][:k] + "q" + parts[i][k + 1 :]
    return " ".join(parts)


def recall(items, edit):
    """Share of items found, edited, in one text each."""
    import pyarrow as pa

    index = decontam.Index(list(enumerate(items)))
    texts = pa.array([f"{sentence(20)} {edit(t, i)} {sentence(20)}" for i, t in enumerate(items)])
    found = {(r, n) for r, n, *_ in decontam._search(index, texts)}
    return sum((i, i) in found for i in range(len(items))) / len(items)


def test_recall_at_the_limit():
    items = [sentence(RNG.randrange(20, 60)) for _ in range(60)]
    assert recall(items, lambda t, i: edited(t, 0.1, i)) >= 0.95
    assert recall(items, lambda t, i: worst(t, 0.09, i)) >= 0.95
    short = [sentence(8) for _ in range(60)]
    assert recall(short, lambda t, i: edited(t, 0.1, i)) >= 0.95
    capitals = ["Été à l'Œuvre ÉCOLE Übung Ärger Ñandú Привет Мир Ωμέγα " + sentence(10) for _ in range(10)]
    assert recall(capitals, lambda t, i: edited(t.upper() if i % 2 else t, 0.03, i)) == 1


@pytest.mark.parametrize("kind", ["substitution", "insertion", "deletion"])
@pytest.mark.parametrize("evenly", [True, False])
@pytest.mark.parametrize("share", [0.1, 0.07])
def test_recall_of_each_kind_of_edit(kind, evenly, share):
    items = [sentence(RNG.randrange(20, 70)) for _ in range(60)]
    rng = np.random.default_rng(5)
    assert recall(items, lambda t, i: decontam.changed(t, kind, evenly, int(len(t) * share), rng).replace("x", "z")) >= 0.95


def test_find_against_the_exact_distance_at_every_place():
    """Which items are in which texts, for edits of every number around the limit, at the beginnings and ends of texts too."""
    import pyarrow as pa

    items = [sentence(RNG.randrange(9, 50)) for _ in range(40)]
    index = decontam.Index(list(enumerate(items)))
    rng = np.random.default_rng(8)
    texts = []
    for i, t in enumerate(items):
        for k, kind in enumerate(("substitution", "insertion", "deletion")):
            body = decontam.changed(t, kind, bool((i + k) % 2), max(1, int(len(t) * (0.04 + 0.02 * (i % 5)))), rng)
            texts.append(decontam.normalise(f"{sentence(i % 3 * 8)} {body} {sentence(k * 8)}"))
    found = {(r, n): d for r, n, _, _, d in decontam._search(index, pa.array(texts))}
    want = {(r, n): d for r, text in enumerate(texts) for n, item in enumerate(items) if (d := decontam.best_end(decontam.normalise(item), text)[0]) <= len(decontam.normalise(item)) * decontam.EDITS}
    assert len(want) > 60 and not set(found) - set(want)
    assert len(set(want) - set(found)) <= 0.02 * len(want)
    assert all(found[k] == want[k] for k in found)


def test_possible_loses_nothing():
    items = [sentence(RNG.randrange(3, 20)) for _ in range(50)]
    index = decontam.Index(list(enumerate(items)))
    for i, t in enumerate(items):
        text = edited(index.items[i][1], 0.1, i)
        if decontam.best_end(index.items[i][1], text)[0] <= index.slack[i]:
            assert index.possible(i, f"zzz{text}zzz")


def test_pieces_lose_nothing():
    """Every place within the edit limit is proposed: against the exact distance at all places."""
    items = [sentence(RNG.randrange(3, 12)) for _ in range(30)]
    index = decontam.Index(list(enumerate(items)))
    for i, t in enumerate(items):
        text = f"{sentence(4)} {edited(t, 0.1, i)} {sentence(4)}"
        n, start = index.proposals(decontam.codes(text))
        for k, other in enumerate(items):
            d, a, _ = decontam.align(other, text)
            if d <= index.slack[k]:
                assert any(k == m and abs(a - s) <= index.slack[k] for m, s in zip(n.tolist(), start.tolist(), strict=True))


def test_grams():
    points = np.random.default_rng(1).integers(97, 103, 4000).astype(np.uint32)
    for n in range(1, 14):
        windows = np.lib.stride_tricks.sliding_window_view(points, n)
        assert len(np.unique(decontam.grams(points, n))) == len(np.unique(windows, axis=0))
    assert len(decontam.grams(points[:3], 4)) == 0


def test_only_the_row_with_the_passage_goes(spark):
    clean, passage = sentence(30), ITEMS[0][1]
    rows = [(1, clean), (1, passage), (None, passage), (None, clean), (2, None), (3, "z" * 1_200_000 + " " + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontam.decontaminate(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(1, clean), (None, clean), (2, None)}
    got = decontam.find(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).filter("doc_id = 3").collect()
    assert [(r.start, r.distance) for r in got] == [(1_200_001, 0)]


def test_a_target_that_cannot_be_reached_raises(monkeypatch):
    monkeypatch.setattr(decontam, "MOST", 1)
    monkeypatch.setattr(decontam, "AGREE", 20)
    try:
        decontam.Index([(0, sentence(30))])
        raise AssertionError("no error")
    except ValueError:
        pass
