import json
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corpusgraph.llm import packing


def reference_ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*t.encode(x, add_special_tokens=False).ids, 1] for x in texts]


def unpack(pieces):
    """Each document's ids, put together from its pieces, and the sequences' fill."""
    own, fill = defaultdict(list), defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length > 0
        own[r.doc_id, r.doc_tokens].append((r.start, ids))
        fill[r.sequence_id].append((r.offset, r.length))
    return own, fill


def check(pieces, rows, sequence):
    own, fill = unpack(pieces)
    want = defaultdict(list)
    for r, ids in zip(rows, reference_ids([r[1] or "" for r in rows]), strict=True):
        want[r[0], len(ids)].append(ids)
    assert set(own) == set(want)
    for k, parts in own.items():
        if len(want[k]) == 1:
            assert [i for _, ids in sorted(parts) for i in ids] == want[k][0]
            assert [s for s, _ in sorted(parts)] == np.cumsum([0, *[len(i) for _, i in sorted(parts)]])[:-1].tolist()
        else:
            assert sum(len(i) for _, i in parts) == sum(len(i) for i in want[k])
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= sequence
    total = sum(len(i) for w in want.values() for i in w)
    assert len(fill) == -(-total // sequence)


def test_round_trip(docs, rows):
    check(packing.pack(docs).collect(), rows, 2048)
    check(packing.pack(docs, sequence=64, window=2).collect(), rows, 64)


def test_special_strings(spark):
    texts = ["<|endoftext|>", "a <|endoftext|> b", "don't  stop\n\n  now \u00a0x 12345 ½ ²", "\u0000\u0007", "👩‍👩‍👧 ﬁ"]
    rows = [(i, t) for i, t in enumerate(texts)]
    check(packing.pack(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")).collect(), rows, 2048)


def test_very_long_white_space(spark):
    rows = [(0, " " * 1_000_000), (1, "a" + "\n" * 1_000_000 + "b"), (2, "word " * 9), (3, "b" * 100_000)]
    check(packing.pack(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")).collect(), rows, 2048)


def test_ids_above_16_bits(spark, tmp_path):
    with open(packing.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["vocab"] = {w: i + 70_000 for w, i in spec["model"]["vocab"].items()}
    (tmp_path / "wide.json").write_text(json.dumps(spec), encoding="utf-8")
    df = spark.createDataFrame([(0, "some words, more words", "s")], "doc_id long, text string, source string")
    ids = [np.frombuffer(packing.pack(df, tokenizer=t).first().ids, dtype="<u4")[:-1].tolist() for t in (None, str(tmp_path / "wide.json"))]
    assert ids[1] == [i + 70_000 for i in ids[0]]


def test_windows_keep_the_mixture(spark):
    rows = [(i, "word " * 30, "abc"[min(i % 6, 2)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for weights in (None, {"a": 0.5, "b": 0.3, "c": 0.2}):
        got = packing.pack(df, sequence=64, window=20, weights=weights).groupBy("window", "source").sum("length").collect()
        by = defaultdict(dict)
        for w, s, n in got:
            by[w][s] = n
        share = weights or {"a": 1 / 6, "b": 1 / 6, "c": 4 / 6}
        full = [x for x in by.values() if len(x) == 3]
        assert len(full) >= 10
        running = defaultdict(float)
        for w in sorted(by)[: 10]:
            for s in share:
                running[s] += by[w].get(s, 0)
        total = sum(running.values())
        assert all(abs(running[s] / total - share[s]) < 0.02 for s in share)


def test_edges(clashing, docs, empty, same):
    keep = ["doc_id", "doc_tokens", "source"]
    same(packing.pack(clashing).select(keep).distinct(), packing.pack(docs).select(keep).distinct())
    assert packing.pack(empty).count() == 0
