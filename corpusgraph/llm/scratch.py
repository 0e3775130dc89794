"""Intermediate tables and free names, as the core has them, and the table that the queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import discard, scratch_dir, stash, unused

__all__ = ["discard", "documents", "scratch_dir", "stash", "unused"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
