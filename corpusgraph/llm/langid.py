"""Language identification in two levels.

Linear support vector machines over byte n-grams first choose the language
family, one against one, and within the family machines of one language
against one other choose the language.  A text's features are the shares of
its hashed n-grams, so a decision is a mean of weights over its n-grams and a
text of any length is read in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import SLICE, buffer_of, slices

BITS = 13
ORDERS = (2, 3, 4)
#: Labelled documents of each language that the machines learn from, at most.
SAMPLE = 600
UNKNOWN = "und"
#: ISO 639-1 codes by family.  A code that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no is af".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bg mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky".split(),
    "indic": "hi bn mr ne pa gu ur".split(),
    "semitic": "ar he mt am".split(),
    "sinitic": "zh yue".split(),
}
_HOME = {lang: family for family, langs in FAMILIES.items() for lang in langs}

_CLEAN = np.full(256, 32, dtype=np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    return _HOME.get(lang.split("-")[0].lower(), f"={lang}")


def _codes(raw: np.ndarray, at: np.ndarray, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the bucket of the n-gram that ends at each byte of raw[lo:hi], and whether it lies in one text."""
    part = _CLEAN[raw[lo:hi]]
    lead = np.flatnonzero(part[:-1] == 0xC3) + 1
    big = lead[(part[lead] >= 0x80) & (part[lead] <= 0x9E)]
    part[big] += 0x20  # capital letters of the Latin-1 supplement
    starts = at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] - lo
    wide = part.astype(np.uint32)
    code = wide.copy()
    for n in range(2, max(ORDERS) + 1):
        code[n - 1 :] |= wide[: len(wide) - n + 1] << np.uint32(8 * (n - 1))
        if n in ORDERS:
            ok = np.ones(len(part), dtype=bool)
            ok[: n - 1] = False
            for j in range(n - 1):
                s = starts + j
                ok[s[s < len(ok)]] = False
            yield ((code + np.uint32(n * 0x01000193)) * np.uint32(2654435761)) >> np.uint32(32 - BITS), ok


def featurize(texts: pa.Array) -> np.ndarray:
    """A row of n-gram shares for each text."""
    raw, at = buffer_of(texts)
    out = np.zeros((len(texts), 1 << BITS), dtype=np.float32)
    for i in range(len(texts)):
        own = at[i : i + 2]
        for lo, hi in slices(raw, own, None):
            for code, ok in _codes(raw, own, lo, hi):
                out[i] += np.bincount(code[ok], minlength=1 << BITS)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1)


def margins(texts: pa.Array, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The decision values of all machines (rows of ``weights``) for each text."""
    raw, at = buffer_of(texts)
    total, count = np.zeros((len(texts), len(weights))), np.zeros(len(texts))
    for lo, hi in slices(raw, at, None):
        a, b = np.searchsorted(at, lo, side="right") - 1, np.searchsorted(at, hi)
        cuts = np.maximum(at[a:b], lo) - lo
        full = np.flatnonzero(np.diff(np.append(cuts, hi - lo)))
        for code, ok in _codes(raw, at, lo, hi):
            count[a + full] += np.add.reduceat(ok.astype(np.int64), cuts[full])
            for m, w in enumerate(weights):
                total[a + full, m] += np.add.reduceat(w[code] * ok, cuts[full], dtype=np.float64)
    return total / np.maximum(count, 1)[:, None] + bias


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 40) -> tuple[np.ndarray, float, float]:
    """Weights, bias and slope of the margin's sigmoid of a linear SVM with hinge loss, by dual coordinate descent.

    Rare and frequent n-grams are brought to one scale first, which the
    returned weights already contain.
    """
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-5)
    z = np.hstack([x * scale, np.ones((len(x), 1))])
    gram = (z @ z.T).astype(np.float64)
    alpha, f, order = np.zeros(len(y)), np.zeros(len(y)), np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * f[i] - 1) / gram[i, i], 0.0), c)
            if new != alpha[i]:
                f += (new - alpha[i]) * y[i] * gram[i]
                alpha[i] = new
    w = z.T @ (alpha * y)
    slope, m = 1.0, y * f
    for _ in range(50):  # Newton's method on the log loss of the slope, held back by a prior
        p = 1 / (1 + np.exp(np.clip(slope * m, -30, 30)))
        slope += (np.sum(m * p) - 0.01 * slope) / (np.sum(m * m * p * (1 - p)) + 0.01 + 1e-3 * len(m))
        slope = min(max(slope, 0.1), 20.0)
    return (w[:-1] * scale).astype(np.float32), float(w[-1]), float(slope)


class Model:
    """The machines: (level, one, other) with weights, bias and slope."""

    def __init__(self, langs: list[str], machines: list[tuple[str, str, str]], weights: np.ndarray, bias: np.ndarray, slope: np.ndarray):
        self.langs, self.machines, self.weights, self.bias, self.slope = langs, machines, weights, bias, slope

    def _vote(self, level: str, names: list[str], m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner among names for each text, and its least certain duel."""
        if len(names) == 1:
            return np.zeros(len(m), dtype=int), np.ones(len(m))
        wins, sure = np.zeros((len(m), len(names))), np.ones((len(m), len(names)))
        for k, (lv, a, b) in enumerate(self.machines):
            if lv == level and a in names and b in names:
                p = 1 / (1 + np.exp(-np.clip(self.slope[k] * m[:, k], -30, 30)))
                for name, q in ((a, p), (b, 1 - p)):
                    j = names.index(name)
                    wins[:, j] += (q > 0.5) + q / len(names)
                    sure[:, j] = np.minimum(sure[:, j], q)
        best = wins.argmax(axis=1)
        return best, sure[np.arange(len(m)), best]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        m = margins(texts, self.weights, self.bias)
        families = sorted({family_of(x) for x in self.langs})
        home, score = self._vote("family", families, m)
        out = np.empty(len(texts), dtype=object)
        for j, family in enumerate(families):
            rows = np.flatnonzero(home == j)
            if len(rows):
                langs = [x for x in self.langs if family_of(x) == family]
                best, sure = self._vote(family, langs, m[rows])
                out[rows] = np.array(langs, dtype=object)[best]
                score[rows] *= sure
        return list(out), np.clip(score, 0.0, 1.0)


def fit(labelled: DataFrame, key: str, text: str, lang: str, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` documents of each language, chosen by hash of the key.

    Each machine is trained in a task of its own.  The driver gets one row of
    counts for each language and 32 KB for each machine.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    langs = sorted(counts)
    families = sorted({family_of(x) for x in langs})
    duels = [("family", a, b) for a, b in combinations(families, 2)]
    duels += [(f, a, b) for f in families for a, b in combinations([x for x in langs if family_of(x) == f], 2)]
    if not duels:
        return Model(langs, [], np.zeros((0, 1 << BITS), np.float32), np.zeros(0), np.zeros(0))
    scale = 1 << 30
    limit = F.element_at(F.create_map(*[F.lit(v) for x in langs for v in (x, min(scale, 1 + 2 * sample * scale // counts[x]))]), F.col(lang))
    draw = F.xxhash64(F.col(key), F.lit("langid"))
    thin = rows.filter(F.pmod(draw, F.lit(scale)) < limit).filter(F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), draw.alias("_draw"))
    few = thin.withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("_draw", "_text"))).filter(F.col("_n") <= sample)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                x = featurize(part.column("_text"))
                names = part.column("_lang").to_pylist()
                level, one, other, sign, data = [], [], [], [], []
                for i, name in enumerate(names):
                    for lv, a, b in duels:
                        own = family_of(name) if lv == "family" else name
                        if own in (a, b) and (lv == "family" or family_of(name) == lv):
                            level.append(lv), one.append(a), other.append(b), sign.append(1 if own == a else -1)
                            data.append(x[i].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(level, pa.string()), pa.array(one, pa.string()), pa.array(other, pa.string()), pa.array(sign, pa.int32()), pa.array(data, pa.binary())], ["level", "one", "other", "sign", "x"])

    def train(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("sign").to_pylist(), table.column("x").to_pylist(), strict=True))  # rows come in any order
        x = np.vstack([np.frombuffer(b, dtype=np.float32) for _, b in rows])
        y = np.array([s for s, _ in rows], dtype=np.float64)
        w, bias, slope = train_svm(x, y)
        first = table.slice(0, 1)
        return pa.table({"level": first.column("level"), "one": first.column("one"), "other": first.column("other"), "w": pa.array([w.tobytes()], pa.binary()), "bias": [bias], "slope": [slope]})

    sampled = few.select("_lang", "_text").mapInArrow(features, "level string, one string, other string, sign int, x binary")
    trained = sampled.groupBy("level", "one", "other").applyInArrow(train, "level string, one string, other string, w binary, bias double, slope double").collect()
    trained.sort(key=lambda r: (r.level, r.one, r.other))
    return Model(langs, [(r.level, r.one, r.other) for r in trained], np.vstack([np.frombuffer(r.w, dtype=np.float32) for r in trained]), np.array([r.bias for r in trained]), np.array([r.slope for r in trained]))


def predict(model: Model, text: Column) -> Column:
    """struct<lang_pred, score> of a text; ``und`` and 0 for a null, for a text without letters, and where no language was learned."""

    @F.arrow_udf("lang_pred string, score double")
    def of(texts: pa.Array) -> pa.Array:
        langs, score = model.predict(texts) if model.langs else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score)], ["lang_pred", "score"])

    # a deterministic function would be run again by each filter on its result
    of = of.asNondeterministic()
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return F.when(lettered, of(F.when(lettered, text).otherwise(""))).otherwise(none)


def held_out(key: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """A row for each row of ``docs``: key, held_out, lang_pred, score.

    Learns from documents with a non-null key and language outside the
    held-out part.  A null key counts as not held out and teaches nothing.
    Text decides alone: equal texts get equal answers, and a text of any
    length is read whole.  An empty table gives no rows; other columns are
    not looked at.
    """
    out = held_out(F.col(key))
    model = fit(docs.filter(F.col(key).isNotNull() & ~out).select(key, text, lang), key, text, lang, sample)
    rows = docs.select(F.col(key), out.alias("held_out"), F.col(text).alias("_text"))
    return rows.withColumn("_p", predict(model, F.col("_text"))).select(key, "held_out", "_p.lang_pred", "_p.score")
