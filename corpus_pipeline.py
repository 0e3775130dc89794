"""The corpus pipeline: five stages over documents, each an operator of corpusgraph.llm.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but
the last return the columns of documents.  A stage works on all rows that its
predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm import decontam, langid, linededup, neardup, packing
from corpusgraph.llm.scratch import stash, unused


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a null lang becomes the language that is predicted.

    Documents with a null text, or one without letters, are rejected; where no
    document has a language to learn from, all others stay as they are.
    Repeated rows and null keys are treated alike; an empty table stays empty.
    """
    model = langid.fit(docs.filter(F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), "doc_id", "text", "lang")
    if not model.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    told = unused(docs, "_told")
    judged = docs.withColumn(told, langid.predict(model, F.col("text"))["lang_pred"]).filter(F.col(told) != langid.UNKNOWN)
    return judged.select(*[F.coalesce("lang", told).alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the least doc_id.

    A null doc_id ranks last; rows with that same key, or repeated rows, stay
    together.  Texts without a word are no duplicates of each other, so null
    and empty ones stay; an empty table stays empty.
    """
    judged = neardup.classes(docs, threshold=80)
    key, text = unused(docs, "_id"), unused(docs, "_hash")
    dropped = judged.filter("not kept").select(F.col("doc_id").alias(key), F.col("_hash").alias(text)).distinct()
    # as many rows as there are copies, so that the join is a shuffle at every size
    return docs.join(dropped.hint("merge"), F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text)), "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines and passages that an earlier document has.

    Rows of equal key and text are one document and lose the same; null and
    empty texts stay as they are, and so does an empty table.
    """
    return linededup.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Each row is judged by its own text, whatever its key; null and empty texts
    stay, and all rows where the benchmark is empty.
    """
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences.

    Null and empty texts are the end id alone; repeated rows and null keys are
    documents each; an empty table gives no pieces.
    """
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source", "window")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: No stage but the third can be expressed in SQL; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
