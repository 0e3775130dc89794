import re
from collections import Counter
from math import comb

from pyspark.sql import functions as F

from corpusgraph.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


EXTRA = [(300, "a b c a b c a b c x y z\na b c\na b c\n\n \n", "en"), (301, "aaa aaa aaa aaa", "en"), (302, "# * $ | < > & %%% \x0bq", "en"), (303, " ".join(f"w{i}" for i in range(60)) + " 😀 ñ", "en"), (304, "x y\n" * 40, None)]
LABELS = "doc_id long, quality int, toxic int"


def test_measures(spark, rows):
    df = spark.createDataFrame([(i, r[1], r[2]) for i, r in enumerate(rows)] + [(1000 + i, t, x) for i, t, x in EXTRA], "doc_id long, text string, lang string")
    texts = {r.doc_id: r.text for r in df.collect()}
    got = quality.judge(df, spark.createDataFrame([], LABELS)).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id]), texts[r.doc_id][:60]
        assert r.kept != r.base_failed  # nothing but base rules without labels


def test_binomial_tail(spark):
    cases = [(0, 100, 0.05), (3, 100, 0.05), (2, 2000, 0.005), (150, 40_000, 0.005), (5, 20, 0.2), (9, 20, 0.3)]
    got = spark.createDataFrame(cases, "k int, n int, p double").select("k", "n", "p", quality.binomial_tail(F.col("k"), F.col("n"), F.col("p")).alias("t")).collect()
    for r in got:
        exact = sum(comb(r.n, j) * r.p**j * (1 - r.p) ** (r.n - j) for j in range(r.k + 1)) if r.k < r.n * r.p and r.n < 5000 else None
        if exact is not None:
            assert abs(r.t - exact) < 1e-9
        elif r.k >= r.n * r.p:
            assert r.t == 1.0
    assert 0 < next(r.t for r in got if r.n == 40_000) < 1e-3


def corpus(n, bad_from):
    """Documents of one stratum; those from bad_from on are full of symbols."""
    return [(i, " ".join(f"w{i}x{j}" + ("#" * 9 if i >= bad_from else "") for j in range(60)), "en") for i in range(n)]


def test_cutoffs_reject_bad_and_hold_the_risk(spark):
    rows = corpus(2600, 2400)
    labels = [(i, int(i < 2400), 0) for i in range(2600)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, LABELS)).collect()
    assert {r.doc_id for r in got if not r.kept} == set(range(2400, 2600))


def test_few_labels_give_no_cutoff(spark):
    rows = corpus(100, 80)
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1, 0) for i in range(50)], LABELS)).collect()
    assert all(r.kept for r in got)


def test_good_documents_with_symbols_loosen_the_cutoff(spark):
    rows = corpus(2600, 2000)
    labels = [(i, 1, 0) for i in range(2600)]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, LABELS)).collect()
    assert all(r.kept for r in got)


def test_contradicting_labels_are_not_used(spark):
    rows = corpus(10, 10)
    labels = [(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (99, 1, 0)]
    assert quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, LABELS)).count() == 10


def test_native_plan(docs, spark):
    plan = quality.judge(docs, spark.createDataFrame([(1, 1, 0)], LABELS))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_edges(docs, clashing, empty, spark, same):
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    same(quality.judge(clashing, labels), quality.judge(docs, labels))
    assert quality.judge(empty, labels).count() == 0
