"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chatrepair, decontam, langid, licenses, linededup, lm, neardup, packing, quality, sharding, sql, urlfilter, warc, whitening
from .scratch import documents


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document. Null and letterless texts are ``und``; repeated rows and equal texts get equal answers; no documents, no rows."""
    return langid.identify(documents(spark, sf_dir))


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document under the law ``key``. Null texts have size 1; a null key is a key, and its rows share a shard; ties in a shard are ordered by text checksum."""
    return sharding.assign_shards(documents(spark, sf_dir), shards=8)


def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 2048 tokens. Null and empty texts are the end id alone; repeated rows and null keys are documents each."""
    pieces = packing.pack(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source", "window")


def op4_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page. A null url has an empty host, which no rule fits; repeated rows are judged alike."""
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document. Null, empty and blank texts are linked with nothing; a null key ranks behind all others."""
    return neardup.classes(documents(spark, sf_dir)).drop("_hash")


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document. Null and empty texts are their end token; repeated rows are documents each; a null key is not held out."""
    return lm.score(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every document. Null and empty texts have no words, labels or score."""
    return licenses.scan(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages of every document. Null and empty texts and items match nothing; equal items are found each; rows with equal keys are searched each."""
    return decontam.find(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("_hash")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that stood before. Null and empty texts have none; rows of equal key and text are one document; a null key ranks last."""
    return linededup.repeated(documents(spark, sf_dir)).drop("_hash")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every document. A null text has no words and fails; a null language is a stratum; keys without an agreeing label teach nothing."""
    return quality.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage and repair of every conversation. Null roles and texts are one space, null turns come first, a null conversation is one; repeated rows are duplicates."""
    return chatrepair.audit(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record, written, normalised and read back. Null html is empty, a null page_id stays null and comes last; of equal pages one is the response."""
    return warc.roundtrip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding. Null vectors and such with null or non-finite entries are left out; repeated rows and null keys are rows each."""
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_jump_sharding, op3_mixture_packing, op4_host_trust, op5_hyperminhash, op6_deleted_interpolation, op7_license_scan, op8_decontamination, op9_line_dedup, op10_quality_rules, op11_chat_repair, op12_warc, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    """The others run Python models or hashes that SQL lacks; tests compare those with brute force."""
    return {"op4_host_trust": sql.host_trust(), "op9_line_dedup": sql.line_dedup(), "op10_quality_rules": sql.quality_rules(), "op11_chat_repair": sql.chat_repair(), "op12_warc": sql.warc()}
