import math
import random

import numpy as np
import pyarrow as pa

from corpusgraph.llm import langid

from .conftest import held_out

# fixed values: frequent words of four languages
VOCABULARY = {
    "en": "the of and to in that was for with this have from they which would there their what about".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es werden".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus pas avec sont être".split(),
    "es": "de la que el en y los del se las por un para con no una su al lo como más pero sus".split(),
}


def text(rng, lang, n):
    return " ".join(rng.choice(VOCABULARY[lang]) for _ in range(n)).capitalize() + "."


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, rng.randrange(5, 60)), lang) for i, lang in enumerate(list(VOCABULARY) * 100)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].held_out == held_out(i, 4, 2) for i, _, _ in rows)
    unseen = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert len(unseen) > 60
    assert sum(a == b for a, b in unseen) >= 0.97 * len(unseen)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_teach_nothing(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang, 20), "xx" if held_out(i, 4, 2) else lang) for i, lang in enumerate(["en", "fr"] * 60)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"en", "fr"}


def test_edges(docs, clashing, empty, same):
    same(langid.identify(clashing), langid.identify(docs))
    got = langid.identify(docs).collect()
    assert {r.lang_pred for r in got if r.doc_id in (100, 101, 102)} == {"und"}
    assert langid.identify(empty).count() == 0


def test_one_language_or_none(spark):
    one = langid.identify(spark.createDataFrame([(1, "abc", "en"), (2, "12", "en")], "doc_id long, text string, lang string")).collect()
    assert {r.doc_id: r.lang_pred for r in one} == {1: "en", 2: "und"}
    none = langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert none[0].lang_pred == "und"


def test_prediction_by_brute_force():
    """Shares of n-grams, margins, votes and scores of a model, text by text in plain Python."""
    rng, draw = random.Random(5), np.random.default_rng(5)
    langs = ["de", "en", "es", "fr"]
    families = sorted({langid.family_of(x) for x in langs})
    machines = [("family", a, b) for i, a in enumerate(families) for b in families[i + 1 :]]
    machines += [(langid.family_of(a), a, b) for i, a in enumerate(langs) for b in langs[i + 1 :] if langid.family_of(a) == langid.family_of(b)]
    weights = draw.normal(size=(len(machines), 1 << langid.BITS)).astype(np.float32) * 20
    model = langid.Model(langs, machines, weights, draw.normal(size=len(machines)), np.full(len(machines), 1.5))
    texts = [text(rng, x, rng.randrange(3, 30)) for x in langs * 5] + ["ÀÉÜ 12 \u4e16!", "a"]

    def vote(level, names, m):
        if len(names) == 1:
            return names[0], 1.0
        wins, sure = {x: 0.0 for x in names}, {x: 1.0 for x in names}
        for k, (lv, a, b) in enumerate(machines):
            if lv == level and a in names and b in names:
                p = 1 / (1 + math.exp(-min(30, max(-30, model.slope[k] * m[k]))))
                for name, q in ((a, p), (b, 1 - p)):
                    wins[name] += (q > 0.5) + q / len(names)
                    sure[name] = min(sure[name], q)
        best = max(names, key=lambda x: wins[x])
        return best, sure[best]

    got, scores = model.predict(pa.array(texts))
    for t, lang, score in zip(texts, got, scores, strict=True):
        row = langid.featurize(pa.array([t]))[0]
        low = "".join(c.lower() if "A" <= c <= "Z" or 0xC0 <= ord(c) <= 0xDE else c for c in t)
        plain = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in low.encode())
        grams = [plain[i - n + 1 : i + 1] for n in langid.ORDERS for i in range(n - 1, len(plain))]
        share = np.zeros(1 << langid.BITS)
        for g in grams:
            code = sum(b << 8 * j for j, b in enumerate(reversed(g)))
            share[(code + len(g) * 0x01000193) * 2654435761 % 2**32 >> (32 - langid.BITS)] += 1 / len(grams)
        assert np.allclose(row, share, atol=1e-6)
        m = weights.astype(np.float64) @ row + model.bias
        family, sure = vote("family", families, m)
        want, own = vote(family, [x for x in langs if langid.family_of(x) == family], m)
        assert lang == want and abs(score - sure * own) < 1e-3


def test_long_texts_are_read_in_slices():
    """A text of three slices is predicted as its parts are, all bytes counted."""
    from corpusgraph.llm.text import SLICE, slices

    raw, at = np.zeros(3 * SLICE + 5, np.uint8), np.array([0, 3 * SLICE + 5])
    assert slices(raw, at, None) == [(0, SLICE), (SLICE, 2 * SLICE), (2 * SLICE, 3 * SLICE), (3 * SLICE, 3 * SLICE + 5)]
