import math

import numpy as np
import pytest

from corpusgraph.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int"


def vectors(n=400, d=40, seed=4):
    """Rows of uneven variance far from zero, with shared directions."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.logspace(1, -1.2, d) + rng.normal(size=d) * 50
    x[:, 3] = x[:, 1] + x[:, 2]
    return [(i, v.tolist(), i % 3) for i, v in enumerate(x)]


def spoiled():
    good = vectors(5)[0][1]
    bad = [None, [], [None] * 40, good[:39] + [math.nan], good[:39] + [math.inf], [-math.inf] + good[1:], good[:20], [1e300] * 40]
    return [(1000 + i, v, None) for i, v in enumerate(bad)]


def brute(rows):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v, _ in rows], dtype=object)
    n = len(x)
    gap = n * x - x.sum(axis=0)
    centred = gap.astype(float) / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    return (gap * gap).sum(axis=1), values[order], centred @ parts[:, order]


def check(rows, got):
    deviation, values, turned = brute(rows)
    count = len({r.component for r in got})
    assert len(got) == len(rows) * count
    place = {key: i for i, (key, _, _) in enumerate(rows)}
    white = np.zeros((len(rows), count))
    for r in got:
        white[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == len(rows) and r.deviation == deviation[place[r.vec_id]]
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9
    want = turned[:, :count] / np.sqrt(values[:count])
    want *= np.sign((want * white).sum(axis=0))
    assert np.abs(white - want).max() < 1e-6
    true = np.abs(white.T @ white / len(rows) - np.eye(count)).max()
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9 and abs(got[0].identity_error - true) < 1e-12
    return count


@pytest.mark.parametrize("partitions", [1, 7, 50])
def test_brute_force(spark, partitions):
    rows = vectors()
    df = spark.createDataFrame(rows + spoiled(), SCHEMA).repartition(partitions)
    got = whitening.whitened(df, fan=3).collect()
    assert check(rows, got) == 32


def test_fewer_rows_than_dimensions(spark):
    rows = vectors(9, 30)
    assert check(rows, whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(4), fan=2).collect()) == 8


def test_merges_lose_nothing():
    """Any tree of merges has the singular values of all rows at once, to the smallest."""
    rng = np.random.default_rng(1)
    x = rng.integers(-1000, 1000, size=(300, 24)) * np.logspace(4, 0, 24).astype(np.int64) + 10**7
    exact = np.linalg.svd((x - x.mean(axis=0)).astype(float), compute_uv=False)
    for cuts in ([1, 2, 3, 250], list(range(10, 300, 10)), [299]):
        held = None
        for part in np.split(x, cuts):
            held = whitening.summary(part) if held is None else whitening.merged(held, whitening.summary(part))
        assert held.n == 300 and held.sums == x.sum(axis=0).tolist()
        assert np.allclose(held.scale, exact, rtol=1e-9) and len(held.scale) == 24


def test_large_entries(spark):
    """Deviations are exact where they outgrow doubles; one that no long holds raises."""
    rows = [(i, [float(10**5 + i * k) for k in range(1, 4)], 0) for i in range(50)]
    rows = [(i, [a, b * (1 + i % 7), c], t) for i, (a, b, c), t in rows]
    assert check(rows, whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()) == 2
    for gap in ([[3, -4]], [[2**40 + 7, -(2**51) + 1]], [[2**60, -(2**61) - 1]], [[2**70, -1]]):
        assert whitening.squares(np.array(gap)) == [sum(g * g for g in gap[0])]
    far = spark.createDataFrame([(0, [1e14], 0), (1, [-1e14], 0)], SCHEMA)
    with pytest.raises(Exception, match="OVERFLOW|overflow|range"):
        whitening.whitened(far).collect()


def test_edges(spark, same):
    rows = vectors(60, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    names = ("_key", "_x", "component", "n", "deviation", "whitened", "_i")
    clashing = spark.createDataFrame([(*r, *["?"] * len(names)) for r in rows], SCHEMA + "".join(f", {c} string" for c in names))
    same(whitening.whitened(clashing.coalesce(1)), whitening.whitened(df.coalesce(1)))
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whitened(spark.createDataFrame(spoiled()[:3], SCHEMA)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0], 0)] * 5, SCHEMA)).count() == 0
    repeated = rows + [(7, rows[7][1], 0), (None, rows[8][1], 0), (None, rows[8][1], 0)]
    got = whitening.whitened(spark.createDataFrame(repeated, SCHEMA)).collect()
    assert len(got) == 63 * 5 and {r.n for r in got} == {63} and sum(r.vec_id is None for r in got) == 10
    floats = spark.createDataFrame(rows, SCHEMA).selectExpr("cast(vec_id as string) as vec_id", "cast(embedding as array<float>) as embedding")
    assert whitening.whitened(floats).count() == 300
