"""Joins of two streams, and late rows as an output of their own (row R07)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def joined(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, delay: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Rows of both streams with one key, the right one's time at most ``within`` behind the left one's.

    Both sides have watermarks, so that state is let go; with ``how`` "left"
    a left row without a partner comes out once none can come any more.  The
    right side's columns must have names of their own, but for the key.
    """
    a = left.withWatermark(left_ts, delay) if left.isStreaming else left
    b = right.withColumnRenamed(key, "_key")
    b = b.withWatermark(right_ts, delay) if b.isStreaming else b
    near = (F.col(key) == F.col("_key")) & (F.col(right_ts) >= F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.expr(f"interval {within}"))
    return a.join(b, near, how).drop("_key")


def mark_before(spark: SparkSession, marks: str, batch: int):
    """The largest event time of the batches before this one, or None."""
    try:
        rows = spark.read.schema("mark timestamp, batch long").parquet(marks)
        return rows.filter(F.col("batch") < batch).agg(F.max("mark")).first()[0]
    except AnalysisException:  # no batch has been written yet
        return None


def split_late(stream: DataFrame, ts: str, delay: str, path: str, checkpoint: str, once: bool = True):
    """Each micro-batch's rows under ``path``/on_time and ``path``/late, in a folder for each batch.

    A row is late if its time is further than ``delay`` behind the largest time
    of the batches before its own, as a watermark has it; rows without a time
    are late.  The marks of batches stand beside the rows, so that a batch
    that runs again, or a query that is started again, splits as before and
    replaces what it wrote.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        mark = mark_before(spark, f"{path}/marks", number)
        late = F.col(ts).isNull() if mark is None else F.col(ts).isNull() | (F.col(ts) < F.lit(mark) - F.expr(f"interval {delay}"))
        batch.filter(~late).write.mode("overwrite").parquet(f"{path}/on_time/batch={number}")
        batch.filter(late).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        batch.agg(F.max(ts).cast("timestamp").alias("mark")).write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
