"""Arriving papers: polling by watermark, replay-safe handling, log following, event-time windows (rows R01-R07, S23)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def poll(papers: DataFrame, acked: DataFrame, watermark: str | None, key: str = "paper_key", created: str = "created_at") -> tuple[DataFrame, DataFrame]:
    """What arrived since the watermark and was not acknowledged, and the watermark from then on.

    Rows of the watermark's own second are looked at again, so none that was
    written late in it is lost.  Without news the watermark stays.
    """
    since = papers if watermark is None else papers.filter(F.col(created) >= F.lit(watermark).cast(papers.schema[created].dataType))
    fresh = since.join(acked.select(key), key, "left_anti")
    return fresh, since.agg(F.max(created).alias("watermark"))


def acknowledge(acked: DataFrame, keys: DataFrame, key: str = "paper_key") -> DataFrame:
    """The acknowledged keys with more of them."""
    return acked.select(key).unionByName(keys.select(key)).filter(F.col(key).isNotNull()).distinct()


def release(acked: DataFrame, keys: DataFrame, key: str = "paper_key") -> DataFrame:
    """The acknowledged keys without those that are to be tried again."""
    return acked.join(keys.select(key), key, "left_anti")


def arrivals(stream: DataFrame, key: str = "paper_key", created: str = "created_at", delay: str = "1 hour") -> DataFrame:
    """R01 as a stream: each key once within the delay; state older than that is let go."""
    return stream.withWatermark(created, delay).dropDuplicatesWithinWatermark([key])


def deliver(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True):
    """Each micro-batch's results under a folder of its own; a batch that runs again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        handle(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def follow(spark: SparkSession, folder: str, schema: str, files: int = 100, level: str | None = None) -> DataFrame:
    """A folder of JSON-lines logs as a stream, ``files`` at a time."""
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)
    return lines if level is None else lines.filter(F.col("level") == level)


def windowed(events: DataFrame, ts: str, width: str, slide: str | None = None, delay: str = "10 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts by event-time window; on a stream, rows later than the delay are left out."""
    late = events.withWatermark(ts, delay) if events.isStreaming else events
    return late.groupBy(F.window(ts, width, slide), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(events: DataFrame, ts: str, gap: str, by: str, delay: str = "10 minutes") -> DataFrame:
    """Sessions of a key, ended by a gap."""
    late = events.withWatermark(ts, delay) if events.isStreaming else events
    return late.groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")
