"""Lists that must fit a budget (rows W10, W11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The sizes that a bundle is cut to, one after the other, until it fits; and how a consumer's bundle shrinks.
CONTENT_STEPS = (
    {"patterns": 14, "evidence": 16, "hyperedges": 24, "mechanism": 12, "gaps": 8, "operators": 8},
    {"patterns": 10, "evidence": 12, "hyperedges": 18, "mechanism": 10, "gaps": 6, "operators": 6},
    {"patterns": 8, "evidence": 8, "hyperedges": 12, "mechanism": 8, "gaps": 5, "operators": 4},
    {"patterns": 6, "evidence": 6, "hyperedges": 8, "mechanism": 6, "gaps": 4, "operators": 4},
    {"patterns": 4, "evidence": 4, "hyperedges": 6, "mechanism": 4, "gaps": 3, "operators": 3},
    {"patterns": 3, "evidence": 3, "hyperedges": 4, "mechanism": 3, "gaps": 2, "operators": 2},
)
CONTENT_CHARS, CONSUMER_CHARS, SEPARATOR = 55000, 120000, 2
CONSUMER = {"hyperedges": (90, 30, 10), "patterns": (24, 8, 4)}
Shape = dict[str, "int | Column"]


def _length(items: Column, n: Column) -> Column:
    """Characters of the first n texts with separators between them."""
    taken = F.slice(items, F.lit(1), F.greatest(F.lit(0), n))
    return F.aggregate(taken, F.lit(0), lambda a, x: a + F.length(x)) + SEPARATOR * F.greatest(F.lit(0), F.size(taken) - 1)


def ladder(rows: DataFrame, lists: dict[str, str], fixed: Column, shapes: list[Shape], most: int) -> DataFrame:
    """``rows`` with each list (column of rendered texts, by its name in the shapes) cut to the first shape that fits, or to the last.

    ``fixed`` is the length of all that is never cut.  Adds step, chars and
    truncated (that even the last shape is too long).  Null lists are empty.
    """
    filled = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in dict.fromkeys(lists.values())})
    size = lambda shape: fixed + sum((_length(F.col(c), F.least(F.size(c), F.lit(shape[n]) if isinstance(shape[n], int) else shape[n])) for n, c in lists.items()), F.lit(0))
    sized = filled.withColumn("_sizes", F.array(*[F.struct(F.lit(i).alias("step"), size(s).cast("long").alias("chars")) for i, s in enumerate(shapes)]))
    last = F.element_at("_sizes", -1)
    told = sized.withColumn("_fit", F.coalesce(F.get(F.filter("_sizes", lambda x: x["chars"] <= most), F.lit(0)), last))
    cut = {}
    for n, c in lists.items():
        kept = F.get(F.array(*[F.lit(s[n]) if isinstance(s[n], int) else s[n] for s in shapes]), F.col("_fit.step"))
        cut[c] = F.slice(c, F.lit(1), F.greatest(F.lit(0), kept.cast("int")))
    return told.withColumns(cut | {"step": F.col("_fit.step"), "chars": F.col("_fit.chars"), "truncated": F.col("_fit.chars") > most}).drop("_sizes", "_fit")


def consumer_shapes(hyperedges: Column, patterns: Column) -> list[Shape]:
    """The shapes of a consumer's bundle with so many of each: hyperedges go by tens while there are more than 30, then patterns by fours while there are more than 8."""
    start, steps, most = {}, {}, {}
    for name, n in (("hyperedges", hyperedges), ("patterns", patterns)):
        top, floor, by = CONSUMER[name]
        start[name] = F.least(n, F.lit(top))
        steps[name] = F.greatest(F.lit(0), F.ceil((start[name] - floor) / by)).cast("int")
        most[name] = -(-(top - floor) // by)
    out = []
    for s in range(sum(most.values()) + 1):
        first = F.least(F.lit(s), steps["hyperedges"])
        out.append({"hyperedges": start["hyperedges"] - CONSUMER["hyperedges"][2] * first, "patterns": start["patterns"] - CONSUMER["patterns"][2] * F.least(F.lit(s) - first, steps["patterns"])})
    return out


def targets(limit: int, *lists: DataFrame) -> DataFrame:
    """Key, place of the first ``limit`` distinct keys of several lists (key, pos), the earlier list first; empty keys go."""
    rows = None
    for i, df in enumerate(lists):
        part = df.filter(F.coalesce("key", F.lit("")) != "").select("key", F.struct(F.lit(i).alias("list"), "pos").alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    # counted in parts, and only ``limit`` rows are ordered in one
    first = rows.groupBy("key").agg(F.min("at").alias("at")).orderBy("at", "key").limit(limit)
    return first.select("key", F.row_number().over(Window.orderBy("at", "key")).alias("place"))
