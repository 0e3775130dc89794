"""Evidence mining, verdicts and checks (rows G19, W03-W08, A17-A19, M13, M14, Q06, J18-J20)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# How many hyperedges of each type evidence holds.
QUOTA = {"event": 120, "relation": 30, "mechanism": 40, "reaction": 40}
# marks behind which, and before which, sentences are joined without a space
CJK_TAIL, CJK_HEAD = tuple("。！？；，、：）》」"), "，。！？；：、）"
LOW_VALUE = ("is_a", "cites", "published_in", "authored_by", "developed_by")


def ranked(df: DataFrame, limit: int) -> DataFrame:
    """The best patterns by relevance, support and rounded confidence, then by confidence; ties by edge."""
    keys = [F.desc("relevance"), F.desc("support"), F.desc(F.round("confidence", 3)), F.desc("confidence"), F.asc("relation_type"), F.asc("source_node"), F.asc("target_node")]
    return df.orderBy(*keys).limit(limit)


def top_by_type(df: DataFrame, kind: str, score: str, ident: str, quota: dict[str, int], fallback: int) -> DataFrame:
    """The best rows of each type up to its quota; ties by id, the latest first."""
    limit = F.lit(fallback)
    for name, n in quota.items():
        limit = F.when(F.col(kind) == name, n).otherwise(limit)
    most = max([fallback, *quota.values()])
    order = Window.partitionBy(kind).orderBy(F.desc(score), F.desc(ident))
    # the constant bound lets each task drop rows before the shuffle
    best = df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= most)
    return best.filter(F.col("_n") <= limit).withColumnRenamed("_n", "rank_in_type")


def coverage(patterns: int | Column, hyperedges: int | Column, average: Column, least: int = 5) -> Column:
    """A18."""
    return F.round(F.least(F.lit(1.0), F.greatest((patterns + hyperedges) / F.lit(least), average / 3.0)), 3)


def low_support(patterns: DataFrame, least: int, limit: int) -> DataFrame:
    """Patterns that need more evidence, without relations of little value."""
    return patterns.filter((F.col("support") < least) & ~F.col("relation_type").isin(*LOW_VALUE)).orderBy(F.asc("support"), F.desc("confidence"), F.asc("source_node"), F.asc("target_node")).limit(limit)


def support_histogram(edges: DataFrame) -> DataFrame:
    """A19."""
    return edges.groupBy("support").agg(F.count("*").alias("n"))


def verdict(dimensions: DataFrame, threshold: float, rounds_done: int, most: int) -> DataFrame:
    """Weighted mean of (dimension, score, weight, required); a required dimension below the threshold caps it.

    Decides sufficient, insufficient, or exhausted after the last round.
    """
    mean = F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight"))
    failed = F.bool_or(F.col("required") & (F.col("score") < threshold))
    out = dimensions.agg(F.coalesce(mean, F.lit(0.0)).alias("_mean"), F.coalesce(failed, F.lit(False)).alias("gated"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("score") < threshold, F.col("dimension")))), ",").alias("unmet"))
    total = F.when(F.col("gated"), F.least("_mean", F.lit(threshold - 0.001))).otherwise(F.col("_mean"))
    decision = F.when(F.round(total, 6) >= threshold, "sufficient").when(F.lit(rounds_done) >= most, "exhausted").otherwise("insufficient")
    return out.select(F.round(total, 6).alias("score"), "gated", "unmet", decision.alias("decision"))


def first_owner(ids: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Owners of listed ids (pos, id) in order of first appearance."""
    return ids.join(owners, "id").groupBy(key).agg(F.min("pos").alias("pos"))


def bind_citations(texts: DataFrame, key: str, text: str, materials: DataFrame) -> DataFrame:
    """Cited numbers with the material at that place, or invalid."""
    cited = texts.select(key, F.explode(T.citation_indices(F.col(text))).alias("n"))
    return cited.join(materials.select(F.col("ordinal").alias("n"), "material"), "n", "left").withColumn("valid", F.col("material").isNotNull())


def fact_check(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Q06: claims (claim_id, text, evidence_id) whose evidence does not exist, or whose numbers it does not hold."""
    joined = claims.join(evidence.select("evidence_id", F.col("sentence").alias("_s")), "evidence_id", "left")
    numbers = F.regexp_extract_all("text", F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    absent = F.array_sort(F.array_distinct(F.filter(numbers, lambda x: ~F.contains(F.col("_s"), x))))
    issue = F.when(F.col("_s").isNull(), "fabricated").when(F.size(absent) > 0, "number")
    return joined.select("claim_id", "evidence_id", issue.alias("issue"), F.when(F.col("_s").isNotNull(), F.array_join(absent, ",")).alias("absent")).filter("issue is not null")


def best_of_cluster(df: DataFrame, signature: list[str], order: list[Column]) -> DataFrame:
    """The best row of each signature, with the number of its duplicates."""
    w = Window.partitionBy(*signature)
    return df.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("duplicates", F.count("*").over(w) - 1).filter("_n = 1").drop("_n")


def select_final(df: DataFrame, qualified: Column, score: str, ident: str, limit: int) -> DataFrame:
    """Qualified rows by score, then others."""
    return df.withColumn("_q", qualified.cast("int")).orderBy(F.desc("_q"), F.desc(score), F.asc(ident)).limit(limit).drop("_q")


def pack_parts(parts: list[list[str]], size: int) -> list[list[str]]:
    """Paragraphs, each a list of its sentences, in chunks of at most ``size`` characters.

    A paragraph of one sentence is taken whole where it fits.  Sentences of a
    longer one are joined up to the size, with a space unless a CJK mark ends
    the first or begins the second; a sentence that is longer itself is cut.
    """
    whole: list[str] = []
    for sentences in parts:
        held = ""
        for s in sentences:
            if len(s) > size:
                whole += [held] * bool(held) + [s[i : i + size] for i in range(0, len(s), size)]
                held = ""
                continue
            if held and len(held) + len(s) > size:
                whole.append(held)
                held = ""
            held += s if not held or held.endswith((" ", "\n", *CJK_TAIL)) or s[:1] in CJK_HEAD else f" {s}"
        whole += [held] * bool(held)
    chunks: list[list[str]] = []
    total = 0
    for text in whole:
        if not chunks or total + len(text) > size:
            chunks.append([])
            total = 0
        chunks[-1].append(text)
        total += len(text)
    return chunks


def pack_paragraphs(df: DataFrame, key: str, text: str, size: int, most: int) -> DataFrame:
    """Key, n_chunks, n_dropped, chunk, paragraphs: paragraphs packed in order into chunks of at most ``size`` characters (200 at least); a long one is split at sentences.

    Chunks beyond ``most`` are counted and left out.  Packing is a running sum
    that starts again, which no window function expresses; it runs on Arrow
    batches.
    """
    size = max(200, size)

    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = [pack_parts(p or [], size) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chunks, pa.list_(pa.list_(pa.string())))], ["_key", "_c"])

    parts = F.transform(T.paragraphs(F.col(text)), lambda p: F.when(F.length(p) > size, T.sentences(p)).otherwise(F.array(p)))
    rows = df.select(F.col(key).alias("_key"), parts.alias("_p")).mapInArrow(run, f"_key {kind}, _c array<array<string>>").withColumnRenamed("_key", key)
    return rows.select(key, F.size("_c").alias("n_chunks"), F.greatest(F.lit(0), F.size("_c") - most).alias("n_dropped"), F.posexplode_outer(F.slice("_c", 1, most)).alias("chunk", "paragraphs"))


def number_by_appearance(df: DataFrame, document: str, order: list[str], key: str) -> DataFrame:
    """Within each document, a number for each key by where it first appears."""
    first = df.groupBy(document, key).agg(F.min(F.struct(*order)).alias("_at"))
    return first.select(document, key, F.row_number().over(Window.partitionBy(document).orderBy("_at", key)).alias("number"))


def suffixes(df: DataFrame, stem: str, order: list[str]) -> DataFrame:
    """Repeated cite keys get a, b, c and so on, numbers past z."""
    n = F.row_number().over(Window.partitionBy(stem).orderBy(*order)) - 1
    mark = F.when(n == 0, "").when(n <= 26, F.char(F.lit(96) + n)).otherwise(F.concat(F.lit("-"), n.cast("string")))
    return df.withColumn("cite_key", F.concat(stem, mark))
