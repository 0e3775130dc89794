"""The literature format, and budgets against plain loops."""

import json
import random

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from corpusgraph.operators import budgets
from corpusgraph.sources import readers


def folder(tmp_path):
    pages = {
        ("arxiv", 1): json.dumps({"items": [{"paper_key": "arxiv:1", "doi": "10.1/A", "q": "x"}, "no object", {"paper_key": None, "q": "x"}]}),
        ("arxiv", 2): '{"items": [{"paper_key": ',
        ("pubmed", 1): json.dumps({"items": [{"paper_key": "pubmed:9", "doi": " 10.1/a ", "q": "x"}, {"paper_key": "pubmed:9", "q": "y", "title": "é"}]}),
        ("europepmc", 1): json.dumps({"found": 0}),
        ("europepmc", 2): json.dumps({"items": {}}),
        ("europepmc", 3): json.dumps([1]),
        ("openalex", 1): json.dumps({"items": []}),
    }
    for (service, page), text in pages.items():
        (tmp_path / f"service={service}/page={page}").mkdir(parents=True)
        (tmp_path / f"service={service}/page={page}/part-0.txt").write_text(text, encoding="utf-8")
        (tmp_path / f"service={service}/page={page}/_SUCCESS").write_text("")
    return str(tmp_path)


def test_pages(spark, tmp_path):
    path = folder(tmp_path)
    rows = readers.pages(spark, path).collect()
    assert {(r.service, r.page, r.pos) for r in rows if r.record} == {("arxiv", 1, 0), ("arxiv", 1, 2), ("pubmed", 1, 0), ("pubmed", 1, 1)}
    assert {(r.service, r.page) for r in rows if r.error} == {("arxiv", 2), ("europepmc", 1), ("europepmc", 2), ("europepmc", 3)}
    assert json.loads(next(r.record for r in rows if r.service == "pubmed" and r.pos == 1))["title"] == "é"
    one = readers.pages(spark, f"file://{path}").filter("service = 'pubmed' and page = 1")
    assert one.count() == 2


def test_filters_leave_partitions_out(tmp_path):
    reader = readers.Pages(folder(tmp_path))
    assert len(reader.partitions()) == 7
    other = GreaterThan(("page",), 1)
    assert list(reader.pushFilters([In(("service",), ("arxiv", "pubmed")), other])) == [other]
    assert [p.value for p in reader.partitions()] == [("arxiv", 1), ("arxiv", 2), ("pubmed", 1)]
    assert list(reader.pushFilters([EqualTo(("service",), "pubmed"), EqualTo(("error",), None)])) == [EqualTo(("error",), None)]
    assert [p.value for p in reader.partitions()] == [("pubmed", 1)]


def test_search(spark, tmp_path):
    hits, report = readers.search(spark, folder(tmp_path), "$.q", "both", 5)
    assert {(r.query, r.service, r.paper_key) for r in hits.collect()} == {("x", "pubmed", "pubmed:9"), ("x", "arxiv", None), ("y", "pubmed", "pubmed:9")}
    assert {(r.service, r.hits, r.errors) for r in report.collect()} == {("pubmed", 2, 0), ("arxiv", 2, 1)}
    hits, report = readers.search(spark, str(tmp_path), "$.q", "all", 1)
    assert {(r.query, r.paper_key) for r in hits.collect()} == {("x", "pubmed:9"), ("y", "pubmed:9")}
    assert {r.service: (r.hits, r.errors) for r in report.collect()} == {"europepmc": (0, 3), "pubmed": (2, 0), "arxiv": (2, 1), "semantic_scholar": (0, 0), "openalex": (0, 0)}


def test_ladder(spark):
    rng = random.Random(1)
    rows = [(i, ["x" * rng.randrange(1, 60) for _ in range(rng.randrange(0, 30))], ["é" * rng.randrange(1, 90) for _ in range(rng.randrange(0, 120))]) for i in range(60)] + [(900, None, None), (901, [], ["y" * 9000])]
    df = spark.createDataFrame(rows, "k int, patterns array<string>, hyperedges array<string>")
    size = lambda p, h: 10 + sum(sum(map(len, x)) + 2 * max(0, len(x) - 1) for x in (p, h))
    for most in (200, 900, 2500):
        got = {r.k: r for r in budgets.ladder(df, {"patterns": "patterns", "hyperedges": "hyperedges"}, F.lit(10), budgets.consumer_shapes(F.coalesce(F.size("hyperedges"), F.lit(0)), F.coalesce(F.size("patterns"), F.lit(0))), most).collect()}
        for k, p, h in rows:
            p, h = (p or [])[:24], (h or [])[:90]
            while size(p, h) > most and (len(h) > 30 or len(p) > 8):
                if len(h) > 30:
                    h = h[:-10]
                else:
                    p = p[:-4]
            assert (got[k].patterns, got[k].hyperedges, got[k].chars, got[k].truncated) == (p, h, size(p, h), size(p, h) > most)


def test_targets(spark):
    frame = lambda rows: spark.createDataFrame(rows, "key string, pos long")
    got = budgets.targets(4, frame([("b", 2), ("a", 1), ("", 0), (None, 0), ("a", 5)]), frame([("z", 3), ("b", 0), ("y", 1), ("x", 9)]))
    assert [(r.key, r.place) for r in got.orderBy("place").collect()] == [("a", 1), ("b", 2), ("y", 3), ("z", 4)]
