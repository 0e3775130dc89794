"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Fixed base rules reject first.  The method then reads labelled documents: for
each stratum and rule it walks a grid of cutoffs from the loosest on and keeps
the tightest whose false rejection of good documents is, by an exact binomial
bound, below the rule's share of ``risk``.  Walking the nested cutoffs in a
fixed order needs no correction among them; over strata and rules the error
``delta`` is divided (Bonferroni).  A stratum with too few labels gets no
cutoff, so its documents pass.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stash

RISK, DELTA = 0.02, 0.05
#: Rule: score that grows with badness, and its cutoffs from loose to tight; a document above the cutoff is rejected.
GRID: dict[str, tuple[float, ...]] = {
    "symbols": (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03),
    "dup_lines": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeats": (0.45, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "upper": (0.9, 0.7, 0.5, 0.4, 0.3, 0.2),
}
_GAP = r"[\x20\x09-\x0D]+"
#: Bits of a packed window that hold its position.
_POS = 20


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1 by Stirling's series at x + 8."""
    y = x + 8
    shift = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7)
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    return (y - 0.5) * F.ln(y) - y + 0.9189385332046727 + series - F.ln(shift)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) where k < n * p; 1 elsewhere.

    Terms are added from k downwards, where they shrink: after
    40 * sqrt(n * p) + 200 of them the rest is below double precision.
    """
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * F.ln(p) + (n - k) * F.ln(1 - p))
    steps = F.least(k, F.ceil(40 * F.sqrt(n * p)) + 200).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def down(acc: Column, i: Column) -> Column:
        term = acc["term"] * (k - i + 1) / (n - k + i) * (1 - p) / p
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    terms = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, lambda a, i: F.when(i <= steps, down(a, i)).otherwise(a), lambda a: a["sum"])
    return F.when(k < n * p, F.least(F.lit(1.0), top * terms)).otherwise(1.0)


def _window_hash(words: Column, i: Column) -> Column:
    return F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, and upper (share of words in capitals).

    A null text has no words.  Equal windows of three words are found in two
    steps: packed longs (hash bits over position bits) are sorted, which
    yields every window that may have an equal; these few are then compared
    by their words, so a hash collision changes nothing.  Texts of more than
    2**20 words compare all windows by words.
    """
    keep = [c for c in docs.columns if c != text]
    one = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    two = one.select(*keep, "_t", F.array_remove(F.split("_t", _GAP), "").alias("_w"))
    size = F.size("_w")
    places = F.when(size >= 3, F.sequence(F.lit(0), size - 3)).otherwise(F.array().cast("array<int>"))
    low = F.lit((1 << _POS) - 1).cast("long")
    packed = F.when(
        size <= (1 << _POS),
        F.sort_array(F.transform(places, lambda i: _window_hash(F.col("_w"), i).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    three = two.select(
        *keep,
        "_w",
        size.alias("n_words"),
        F.length(F.array_join("_w", "")).alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        lines.alias("_lines"),
        packed.alias("_packed"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).alias("_upper"),
    )
    same = lambda a, b: F.shiftright(a, _POS) == F.shiftright(b, _POS)
    maybe = F.filter(
        "_packed",
        lambda x, i: F.coalesce((i > 0) & same(x, F.get(F.col("_packed"), i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(F.col("_packed"), i + 1)), F.lit(False)),
    )
    four = three.select(*keep, "_w", "n_words", "word_chars", "n_symbols", "_upper", (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"), maybe.alias("_maybe"))
    spots = F.when(F.col("n_words") > (1 << _POS), F.sequence(F.lit(0), F.col("n_words") - 3)).otherwise(F.transform("_maybe", lambda x: x.bitwiseAND(low).cast("int")))
    exact = F.array_sort(F.transform(spots, lambda i: F.struct(F.concat_ws(" ", F.get(F.col("_w"), i), F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2)).alias("g"), i.alias("i"))))
    five = four.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "_upper", exact.alias("_x"))
    hit = F.filter(
        "_x",
        lambda x, i: F.coalesce((i > 0) & (x["g"] == F.get(F.col("_x"), i - 1)["g"]), F.lit(False)) | F.coalesce(x["g"] == F.get(F.col("_x"), i + 1)["g"], F.lit(False)),
    )
    six = five.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "_upper", F.sort_array(F.transform(hit, lambda x: x["i"])).alias("_p"))
    covered = F.aggregate(F.transform("_p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get(F.col("_p"), i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    long = lambda c: F.col(c).cast("long").alias(c)
    return six.select(*keep, long("n_words"), long("word_chars"), long("n_symbols"), long("n_dup_lines"), covered.cast("long").alias("n_repeat_words"), (F.col("_upper") / F.greatest(F.col("word_chars"), F.lit(1))).alias("upper"))


def scores(measured: DataFrame) -> DataFrame:
    """``measured`` with a map from each rule to its score."""
    share = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    by = {"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_words") * 10, "repeats": share("n_repeat_words", "n_words"), "upper": F.col("upper").cast("double")}
    return measured.withColumn("_scores", F.create_map(*[x for k, v in by.items() for x in (F.lit(k), v)]))


def certify(scored: DataFrame, good: DataFrame, key: str, stratum: str, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: the tightest cutoffs that the labelled good documents allow.

    ``good`` has the keys of good documents, once each.  Only sums for each
    stratum, rule and cutoff leave the tasks.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff")) for r, cuts in GRID.items() for i, c in enumerate(cuts)]))
    held = scored.join(good.select(key), key, "left_semi").select(stratum, "_scores", grid.alias("g"))
    cells = held.groupBy(stratum, "g.rule", "g.step", "g.cutoff").agg(F.count("*").alias("n"), F.count_if(F.element_at("_scores", F.col("g.rule")) > F.col("g.cutoff")).alias("k"))
    cells = stash(cells, "cells")
    tests = cells.agg(F.count_distinct(F.coalesce(F.col(stratum), F.lit("")))).first()[0] * len(GRID)
    tested = cells.withColumn("_p", binomial_tail(F.col("k"), F.col("n"), F.lit(risk / len(GRID)))).withColumn("_ok", (F.col("_p") <= delta / max(tests, 1)).cast("int"))
    chain = Window.partitionBy(stratum, "rule").orderBy("step")
    passed = tested.withColumn("_all", F.min("_ok").over(chain)).filter("_all = 1")
    return passed.groupBy(stratum, "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """A row for each row of ``docs``: key, the measures, base_failed, kept.

    ``labels`` has key and quality; a key whose labels disagree, or are null,
    is not used.  Documents with a null key get the base rules and the cutoffs
    of their stratum; a null stratum is one of its own.  No labels: base rules
    alone.  An empty table gives no rows; further columns are not looked at.
    """
    measured = stash(measure(docs.select(F.col(key).alias("_key"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"), F.col(text).alias("text")), "text"), "quality")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = scores(measured).withColumn("base_failed", base)
    good = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min("quality").alias("a"), F.max("quality").alias("b")).filter("a = 1 and b = 1")
    cuts = certify(scored.filter(~F.col("base_failed")), good, "_key", "_stratum", risk, delta)
    # a row for each stratum: as many as the stratum column has values
    by = cuts.groupBy("_stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cuts"))
    joined = scored.join(by, "_stratum", "left")
    over = [F.coalesce(F.element_at("_scores", r) > F.element_at("_cuts", r), F.lit(False)) for r in GRID]
    bad = reduce(or_, over)
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return joined.select(F.col("_key").alias(key), *out, (~F.col("base_failed") & ~bad).alias("kept"))
