"""Text of pages from positioned lines (rows T09, T10, T12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# What page numbers and margin notes look like, and where margins lie.
PAGE_NUMBER = r"^(\d{1,4}|[-–—]\s*\d{1,4}\s*[-–—]?|\d+\s*/\s*\d+)$"
METADATA = (r"^(?:arXiv|doi|DOI|https?://\S+|www\.\S+)\S*$", r"(?i)\bdoi\s*[:.]?\s*10\.\d{4,9}/\S+", r"^©\s?\d{4}.{0,80}$", r"(?i)^Copyright\s.+$")
HEADER, FOOTER, GAP = 0.08, 0.92, 0.7


def classify(lines: DataFrame) -> DataFrame:
    """``lines`` (doc_id, page, text, x0, y0, y1, page_height) with kind: page-number, metadata, running-header, running-footer or text.

    A line in a margin that stands in the same margin of its document twice is
    a running head; page numbers and notes are told before those are counted.
    """
    text = T.strip(F.coalesce("text", F.lit("")))
    zone = F.when(F.col("page_height") <= 0, None).when(F.col("y1") < F.col("page_height") * HEADER, "header").when(F.col("y0") > F.col("page_height") * FOOTER, "footer")
    note = text.rlike(METADATA[0]) | text.rlike(METADATA[1]) | text.rlike(METADATA[2]) | text.rlike(METADATA[3])
    first = F.when(text.rlike(PAGE_NUMBER), "page-number").when(zone.isNotNull() & note, "metadata")
    marked = lines.withColumn("_zone", zone).withColumn("_first", first).withColumn("_norm", F.substring(F.lower(T.squeeze(text)), 1, 120))
    same = F.count(F.when(F.col("_first").isNull(), 1)).over(Window.partitionBy("doc_id", "_zone", "_norm"))
    running = F.when(F.col("_zone").isNotNull() & (same >= 2), F.concat(F.lit("running-"), "_zone"))
    return marked.withColumn("kind", F.coalesce("_first", running, F.lit("text"))).drop("_zone", "_first", "_norm")


def paragraphs(lines: DataFrame) -> DataFrame:
    """doc_id, page, paragraph, text: lines joined until a gap of more than 0.7 line heights; a hyphen at a line's end joins its word."""
    page = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "text")
    height = F.greatest(F.lit(1.0), F.lag("y1").over(page) - F.lag("y0").over(page))
    opens = F.coalesce((F.col("y0") - F.lag("y1").over(page) > GAP * height).cast("int"), F.lit(0))
    placed = lines.filter(T.strip(F.col("text")) != "").withColumn("_o", opens).withColumn("paragraph", F.sum("_o").over(page)).withColumn("_n", F.row_number().over(page))
    parts = placed.groupBy("doc_id", "page", "paragraph").agg(F.array_sort(F.collect_list(F.struct("_n", T.strip(F.col("text")).alias("t")))).alias("_p"))
    joined = F.array_join(F.transform("_p", lambda x: x["t"]), "\n")
    whole = F.regexp_replace(joined, r"(?<!-)-\n", "")
    return parts.select("doc_id", "page", "paragraph", T.squeeze(F.replace(whole, F.lit("\n"), F.lit(" "))).alias("text")).filter("text != ''")


def clean(lines: DataFrame) -> DataFrame:
    """doc_id, text: the paragraphs of all pages without margins and page numbers, up to the references."""
    kept = paragraphs(classify(lines).filter("kind = 'text'").drop("kind"))
    whole = kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "paragraph", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return whole.select("doc_id", T.cut_references(F.col("text")).alias("text"))
