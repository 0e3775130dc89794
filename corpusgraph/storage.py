"""Intermediate tables on the storage that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a folder of our own is made, which only a
    local master may do: on a cluster executors could not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), "checkpoints", "corpusgraph")
    os.makedirs(path, exist_ok=True)
    return path


def stash(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet under the scratch folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables that ``stash`` wrote for these frames; others are left alone.

    Only for tables that no frame in use is still to be computed from: what
    has been written from them stands by itself.
    """
    for df in frames:
        path = getattr(df, "_stashed", None)
        if path:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            df._stashed = None


#: Rows that a task of a large shuffle gets.
ROWS = 1 << 20


def tasks(spark: SparkSession, rows: int) -> int:
    """As many tasks as ``rows`` rows need, at least those of any shuffle: what a task holds stays the same as tables grow."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or where ``df`` has such a column already, the name behind as many underscores as it takes."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
