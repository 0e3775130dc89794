"""Citation tracing: a bounded breadth-first walk with a budget (row G18).

The walk goes level by level; what a level may look at is bounded by the
budget, not by the graph: of each reached paper the first ``most`` relevant
references, of at most ``most`` papers.  Those few rows pass through one task
in the order of the walk, which spends the budget as a queue would.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import stash

#: Share of the topic terms' characters that a record must hold.
TOPIC_SHARE = 0.1


def identity() -> Column:
    """What a record is known by: key, DOI or title, in lower case."""
    first = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("paper_key", "doi", "title")])
    return F.lower(T.strip(F.coalesce(first, F.lit(""))))


def relevant(topic: list[str], required: list[str], share: float = TOPIC_SHARE) -> Column:
    """Any of the required terms, and enough of the topic's characters, in title, abstract or keywords."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "abstract", "keywords")]))
    terms, needed = [t.strip().lower() for t in topic if t.strip()], [t.strip().lower() for t in required if t.strip()]
    good = F.lit(True)
    if needed:
        good = good & T.contains_any(text, needed)
    if terms:
        held = sum((F.when(text.contains(t), len(t)).otherwise(0) for t in terms), F.lit(0))
        good = good & (held / float(sum(map(len, terms))) >= share)
    return good


def _spent(level: DataFrame, seen: DataFrame, base: int, most: int) -> DataFrame:
    """The level's rows that a queue would take: (place, identity, source), in order of (rank, pos), ``base`` of ``most`` having been taken."""
    kinds = "place long, identity string, source string"
    known = level.join(seen.select(F.col("identity").alias("_k")), F.col("identity") == F.col("_k"), "left").withColumn("_seen", F.col("_k").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: dict[str, tuple[int, str]] = {}
        parent, looked, budget = None, 0, 0
        for batch in batches:
            for rank, name, source, old in zip(*[batch.column(c).to_pylist() for c in ("rank", "identity", "source", "_seen")], strict=True):
                if rank != parent:
                    parent, looked, budget = rank, 0, most - base - len(taken)
                looked += 1
                if looked <= budget and not old and name not in taken:
                    taken[name] = (base + len(taken) + 1, source)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in taken.values()], pa.int64()), pa.array(list(taken), pa.string()), pa.array([s for _, s in taken.values()], pa.string())], ["place", "identity", "source"])

    # at most ``most`` rows of each of ``most`` papers
    one = known.select("rank", "pos", "identity", "source", "_seen").repartition(1).sortWithinPartitions("rank", "pos", "identity")
    return one.mapInArrow(run, kinds)


def trace(references: DataFrame, seeds: list[str], topic: list[str] = (), required: list[str] = (), max_depth: int = 1, max_results: int = 200, max_seeds: int = 20) -> DataFrame:
    """Place, identity, depth, source of papers reached from the seeds, in the order of a queue.

    ``references`` has source, pos, paper_key, doi, title, abstract, keywords:
    what each paper cites, in order.  A record counts once, where it is first
    met; records by which nothing is known, and those that are not relevant,
    count for nothing.  Of each paper only as many relevant references are
    looked at as the budget has left, met before or not.
    """
    spark = references.sparkSession
    names = list(dict.fromkeys(s.strip() for s in list(seeds)[:max_seeds] if s and s.strip()))
    first = spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "place long, identity string")
    rows = references.withColumn("identity", identity()).filter((F.col("identity") != "") & relevant(list(topic), list(required))).select("source", "pos", "identity")
    seen = first.select("identity")
    frontier = first.select(F.col("place").alias("rank"), F.col("identity").alias("source"))
    found, out = 0, None
    for depth in range(1, max(1, max_depth) + 1):
        ahead = rows.join(F.broadcast(frontier), "source")  # max_seeds or max_results rows
        best = ahead.withColumn("_n", F.row_number().over(Window.partitionBy("rank").orderBy("pos", "identity"))).filter(F.col("_n") <= max_results).drop("_n")
        level = stash(_spent(best, seen, found, max_results).withColumn("depth", F.lit(depth)), "level")
        out = level if out is None else out.unionByName(level)
        count = level.count()
        found += count
        if not count or found >= max_results:
            break
        seen = seen.unionByName(level.select("identity"))
        frontier = level.select(F.col("place").alias("rank"), F.col("identity").alias("source"))
    return out.select("place", "identity", "depth", "source")


def trace_errors(failed: DataFrame, found: DataFrame, seeds: list[str], max_depth: int, max_seeds: int = 20) -> DataFrame:
    """seed, error: papers of the walk that were asked for references (those above the last depth) and failed (``failed``: source, error)."""
    spark = failed.sparkSession
    names = spark.createDataFrame([(s.strip(),) for s in list(seeds)[:max_seeds] if s and s.strip()], "source string").distinct()
    asked = names.unionByName(found.filter(F.col("depth") < max(1, max_depth)).select(F.col("identity").alias("source")))
    return failed.join(F.broadcast(asked), "source", "left_semi").select(F.col("source").alias("seed"), "error")
