"""Answers of literature services as a data source: a partition for each service and page, or for some pages where there are many, failures as rows (rows S01, S09).

``spark.read.format("literature").option("path", folder)`` reads the pages that
were fetched to ``folder``/service=NAME/page=N.  A page is a JSON object with a
list ``items``.  What cannot be read is a row with its error and no failed job,
so that one service's fault costs its own page.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .records import merged_hits, sources_of

NAME = "literature"
# Fixed value: about how many partitions there are where pages are many; fewer pages have one each.
PARTITIONS = 500
SCHEMA = "service string, page int, pos int, record string, error string"


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class Batch(InputPartition):
    """Some pages (number, path) of a service."""

    def __init__(self, service: str, pages: list[tuple[int, str]]):
        super().__init__((service, pages[0][0]))
        self.service, self.pages = service, pages


class Pages(DataSourceReader):
    """Reads a folder of pages; a filter on the service leaves its other partitions unread."""

    def __init__(self, path: str):
        self.path = path
        self.services: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) and f.attribute == ("service",) else set(f.value) if isinstance(f, In) and f.attribute == ("service",) else None
            if wanted is None:
                yield f
            else:
                self.services = wanted if self.services is None else self.services & wanted

    def partitions(self) -> list[Batch]:
        store, root = _opened(self.path)
        found: dict[str, list[tuple[int, str]]] = {}
        for info in store.get_file_info(pafs.FileSelector(root, recursive=True)):
            parts = dict(p.split("=", 1) for p in info.path.split("/") if "=" in p)
            name = info.path.rsplit("/", 1)[-1]
            if info.type == pafs.FileType.File and {"service", "page"} <= set(parts) and name[0] not in "._" and (self.services is None or parts["service"] in self.services):
                found.setdefault(parts["service"], []).append((int(parts["page"]), info.path))
        ordered = [(service, sorted(found[service])) for service in sorted(found)]
        size = -(-sum(len(pages) for _, pages in ordered) // PARTITIONS) or 1
        return [Batch(service, pages[i : i + size]) for service, pages in ordered for i in range(0, len(pages), size)]

    def read(self, partition: Batch) -> Iterator[pa.RecordBatch]:
        for page, path in partition.pages:
            yield from self._read(partition.service, page, path)

    def _read(self, service: str, page: int, path: str) -> Iterator[pa.RecordBatch]:
        try:
            store, _ = _opened(self.path)
            with store.open_input_stream(path) as f:
                items = json.loads(f.read())["items"]
            if not isinstance(items, list):
                raise TypeError("items is no list")
            rows = [(i, json.dumps(x, ensure_ascii=False), None) for i, x in enumerate(items) if isinstance(x, dict)]
        except (OSError, ValueError, KeyError, TypeError) as e:
            rows = [(None, None, f"{type(e).__name__}: {e}")]
        if rows:
            pos, records, errors = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([service] * len(rows)), pa.array([page] * len(rows), pa.int32()), pa.array(pos, pa.int32()), pa.array(records, pa.string()), pa.array(errors, pa.string())], ["service", "page", "pos", "record", "error"])


class Literature(DataSource):
    """The format ``literature``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Pages:
        return Pages(self.options["path"])


def pages(spark: SparkSession, path: str) -> DataFrame:
    """All pages under a folder: service, page, pos, record (JSON), error."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Literature)
    return spark.read.format(NAME).option("path", path).load()


def search(spark: SparkSession, path: str, query: str, source: str | None, most: int) -> tuple[DataFrame, DataFrame]:
    """Hits and report of a search over a set of services, whose pages have been fetched for the queries that ``query`` (a JSON path in a record) names.

    hits: query, service, page, pos, paper_key, doi, record: each query's in
    the order of the set, without those whose key or DOI an earlier one has, up
    to ``most``.  report: service, hits, errors, for every service of the set,
    also one that has no pages.
    """
    wanted = sources_of(source)
    rows = pages(spark, path).filter(F.col("service").isin(wanted))
    field = lambda p: F.get_json_object("record", p)
    rank = F.array_position(F.array(*[F.lit(s) for s in wanted]), F.col("service"))
    found = rows.filter("error is null").select(field(query).alias("query"), rank.alias("rank"), "service", "page", "pos", field("$.paper_key").alias("paper_key"), field("$.doi").alias("doi"), "record")
    hits = merged_hits(found, "query", ["rank", "page", "pos"], most).drop("rank")
    every = spark.createDataFrame([(s,) for s in wanted], "service string")
    told = rows.groupBy("service").agg(F.count("record").alias("hits"), F.count("error").alias("errors"), F.min("error").alias("first_error"))
    report = every.join(F.broadcast(told), "service", "left").fillna(0, ["hits", "errors"])  # a row for each service
    return hits, report
