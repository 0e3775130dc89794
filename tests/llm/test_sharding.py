import zlib
from collections import Counter, defaultdict

import numpy as np

from corpusgraph.llm import sharding


def jump_one(key, shards):
    """The published loop, for one key."""
    at, nxt = -1, 0
    while nxt < shards:
        at = nxt
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        nxt = int((at + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return at


def test_jump():
    keys = np.random.default_rng(0).integers(0, 1 << 63, size=2000, dtype=np.uint64)
    for n in (1, 2, 8, 100):
        assert sharding.jump(keys, n).tolist() == [jump_one(int(k), n) for k in keys]
    a, b = sharding.jump(keys, 8), sharding.jump(keys, 9)
    assert set(b[a != b].tolist()) == {8}
    assert abs((a != b).mean() - 1 / 9) < 0.03


def test_rows_and_slots(docs, rows):
    got = sharding.assign_shards(docs).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 8
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    home = defaultdict(set)
    for r in got:
        home[r.doc_id].add((r.shard, r.grown_shard))
    assert all(len(x) == 1 for x in home.values())


def test_many_equal_rows(spark):
    df = spark.range(3000).selectExpr("7L as doc_id", "'same' as text")
    got = sharding.assign_shards(df).collect()
    assert sorted(r.slot for r in got) == list(range(3000))


def test_edges(clashing, docs, empty, same):
    same(sharding.assign_shards(clashing).drop("slot"), sharding.assign_shards(docs).drop("slot"))
    assert sharding.assign_shards(empty).count() == 0
