import re
from itertools import combinations

import numpy as np
import pytest

from corpusgraph.llm import neardup

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows, threshold):
    """(key, text) to (shingles, component), over all pairs."""
    sets = [shingles(r[1]) for r in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= threshold * len(sets[i] | sets[j]):
            top[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("threshold", [85, 80])
def test_against_all_pairs(docs, rows, threshold):
    got = neardup.classes(docs, threshold=threshold).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, threshold)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_hot_buckets_are_compared_in_blocks(spark, monkeypatch):
    """Chains of edits around shared text meet in buckets above HOT."""
    monkeypatch.setattr(neardup, "HOT", 4)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    made = []
    for i in range(70):
        w = list(base)
        for at in rng.integers(0, 60, size=int(rng.integers(0, 4))):
            w[at] = f"z{rng.integers(0, 4)}"
        made.append((i, " ".join(w)))
    got = neardup.classes(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(made, 85)


def common_line(n):
    """Texts of twenty common words and some of their own, and one more of each tenth with a word appended."""
    made = [(i, f"{' '.join(f'c{j}' for j in range(20))} {' '.join(f'v{i}x{j}' for j in range(5 + i % 4))}") for i in range(n)]
    return made + [(n + i, f"{made[i][1]} end") for i in range(0, n, 10)]


def test_common_text_is_not_compared_in_blocks(spark, monkeypatch):
    """Texts that share a common line alone, and no rare shingle, are not compared with each other."""
    seen = []
    monkeypatch.setattr(neardup, "HOT", 4)
    monkeypatch.setattr(neardup, "FEW", 0)
    monkeypatch.setattr(neardup, "stash", lambda df, name, stash=neardup.stash: (seen.append((name, out := stash(df, name))), out)[1])
    monkeypatch.setattr(neardup, "compared_in_blocks", lambda *a: pytest.fail("compared in blocks"))
    monkeypatch.setattr(neardup, "discard", lambda *a: None)
    made = common_line(80)
    got = neardup.classes(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(made, 85)
    hot = [df.count() for name, df in seen if name == "hot"]
    assert len(hot) == 2 and hot[0] > 20 and hot[1] == 0


@pytest.mark.parametrize("few", [0, neardup.FEW])
def test_exploded_rows_are_not_broadcast(spark, docs, monkeypatch, few):
    """Band keys, and members by block: a plan knows nothing of how many they are."""
    plans = []
    monkeypatch.setattr(neardup, "stash", lambda df, name, stash=neardup.stash: (plans.append(df._jdf.queryExecution().executedPlan().toString()), stash(df, name))[1])
    monkeypatch.setattr(neardup, "HOT", 4)
    monkeypatch.setattr(neardup, "FEW", few)
    neardup.classes(docs, threshold=80).count()
    broadcast = [part.split("Exchange", 1)[0] for plan in plans for part in plan.split("BroadcastExchange")[1:]]
    assert sum("explode(" in plan for plan in plans) >= 2 and not any("explode(" in part for part in broadcast)


@pytest.mark.parametrize("threshold", [85, 80])
def test_linked_sets_of_every_size_share_a_key(threshold):
    """Any two sets of up to 130 shingles at the threshold, and ones that one contains; 20 draws of each."""
    rng = np.random.default_rng(7)
    lost = []
    for n in range(1, 131):
        made, sizes = [], []
        for m in range(n, min(130, n * 100 // threshold) + 1):
            common = -(-threshold * (n + m) // (100 + threshold))
            for both in {n, common} if common <= n else ():
                for _ in range(20):
                    pool = rng.integers(0, 1 << 63, size=n + m - both, dtype=np.uint64) << np.uint64(1)
                    made += [np.sort(pool[:n]), np.sort(pool[n - both :])]
                    sizes.append((n, m, both))
        keys = neardup.band_keys(made, neardup.sketch_of(made), threshold)
        lost += [s for s, a, b in zip(sizes, keys[::2], keys[1::2], strict=True) if not set(a.tolist()) & set(b.tolist())]
    assert not lost


def test_short_documents_with_words_appended(spark):
    made = []
    for at, (n, m) in enumerate([(6, 7), (15, 18), (18, 22), (22, 27), (27, 33), (33, 41), (41, 51), (51, 63)]):
        w = [f"v{at}x{i}" for i in range(m + 4)]
        made += [(2 * at, " ".join(w[: n + 4])), (2 * at + 1, " ".join(w))]
    df = spark.createDataFrame(made, "doc_id long, text string")
    for threshold in (80, 85):
        got = neardup.classes(df, threshold=threshold).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(made, threshold)


def test_edges(clashing, docs, empty, same):
    same(neardup.classes(clashing), neardup.classes(docs))
    assert neardup.classes(empty).count() == 0


def test_estimate_is_near_the_truth():
    rng = np.random.default_rng(1)
    for t in (0.3, 0.6, 0.9):
        pool = rng.integers(0, 1 << 63, size=4000, dtype=np.uint64)
        both = int(4000 * t)
        half = both + (4000 - both) // 2
        a, b = np.sort(pool[:half]), np.sort(np.concatenate([pool[:both], pool[half:]]))
        s = neardup.sketch_of([a << np.uint64(1), b << np.uint64(1)])
        j, filled = neardup.estimate(s[0], s[1])
        assert filled == neardup.REGISTERS
        assert abs(j - t) < 0.16
