"""Raw records and streams, on small rows."""

from datetime import datetime

from pyspark.sql import functions as F

from corpusgraph.sources import records as R
from corpusgraph.streaming import monitor as W

XML = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">77</PMID><Article PubModel="Print">
<Journal><ISSN IssnType="Print">1234-5678</ISSN><JournalIssue><PubDate>{date}</PubDate></JournalIssue><Title>J. of  Things</Title></Journal>
<ArticleTitle>On <i>small</i> things &amp; more</ArticleTitle><ELocationID EIdType="doi" ValidYN="Y">10.1/e</ELocationID>
<Abstract><AbstractText Label="AIM">To  see.</AbstractText><AbstractText>Seen <b>it</b>.</AbstractText><AbstractText> </AbstractText></Abstract>
<AuthorList><Author><LastName>Doe</LastName><ForeName>Jo</ForeName><AffiliationInfo><Affiliation>X</Affiliation></AffiliationInfo><AffiliationInfo><Affiliation>X</Affiliation></AffiliationInfo></Author>
<Author><CollectiveName>The Group</CollectiveName></Author><Author></Author></AuthorList></Article></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pmc">PMC5</ArticleId>{doi}</ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"""


def test_pubmed(spark):
    answers = [
        (XML.format(date="<Year>2023</Year><Month>Feb</Month><Day>3</Day>", doi='<ArticleId IdType="doi">10.1/a</ArticleId>'),),
        (XML.format(date="<MedlineDate>2024 Sep-Oct</MedlineDate>", doi=""),),
        ("<PubmedArticleSet/>",),
        (None,),
    ]
    a, b = R.pubmed(spark.createDataFrame(answers, "xml string")).orderBy("pub_year").collect()
    assert (a.paper_key, a.title, a.abstract) == ("pubmed:77", "On small things & more", "AIM: To see.\n\nSeen it.")
    assert (a.doi, a.pmcid, a.venue, a.venue_issn, a.pub_year, a.pub_date) == ("10.1/a", "PMC5", "J. of Things", "1234-5678", 2023, "2023-02-03")
    assert [(x.name, x.affiliations) for x in a.authors] == [("Jo Doe", ["X"]), ("The Group", []), ("Unknown", [])]
    assert (b.doi, b.pub_year, b.pub_date) == ("10.1/e", 2024, "2024-01-01")


def test_jats_and_index(spark):
    xml = "<article><title>Intro</title><p>INTRO</p><p>Some <i>text</i>  here.</p><p>no</p><caption>Fig</caption></article>"
    row = spark.createDataFrame([(xml, {"b": [1, 3], "a": [0, 2], "z": None})], "x string, m map<string, array<int>>").select(R.jats_text(F.col("x")).alias("t"), R.abstract_of(F.col("m")).alias("a"), R.abstract_of(F.lit(None).cast("map<string, array<int>>")).alias("n")).first()
    assert (row.t, row.a, row.n) == ("Intro\n\nSome text here.\n\nFig", "a b a b", "")


def test_ncpssd(spark):
    fields = "id title creator date years remark subject doi pdfurl beginpage endpage cbw_name".split()
    rows = [
        ("9", "<b>题</b>", "甲；乙, 丙", "2021-05-06T00:00:00", "", "r", "s", "https://doi.org/10.1/x", "https://evil.org/a.pdf", "1", "9", "刊"),
        (None, None, None, "1999", "2001", None, None, None, "https://www.ncpssd.cn/a", "3", None, None),
    ]
    a, b = R.ncpssd(spark.createDataFrame(rows, ", ".join(f"{f} string" for f in fields)).coalesce(1)).collect()
    assert (a.paper_key, a.title, a.doi, a.pub_year, a.pub_date, a.pages, a.pdf_url) == ("ncpssd:9", "题", "10.1/x", 2021, "2021-05-06", "1-9", None)
    assert [x.name for x in a.authors] == ["甲", "乙", "丙"]
    assert (b.paper_key, b.pub_year, b.pub_date, b.pages, b.doi) == (None, 2001, "2001-01-01", "3", None)
    assert b.pdf_url == "https://www.ncpssd.cn/a" and b.authors == []


def test_merged_hits(spark):
    rows = [("q", 1, "a", "10.1/X"), ("q", 2, "b", " 10.1/x "), ("q", 3, "b", None), ("q", 4, "a", "10.1/z"), ("q", 5, "c", "10.1/z"), ("q", 6, "d", None), ("p", 1, "b", None)]
    hits = spark.createDataFrame(rows, "q string, seq int, paper_key string, doi string")
    got = R.merged_hits(hits, "q", ["seq"], 3).collect()
    assert sorted((r.q, r.seq) for r in got) == [("p", 1), ("q", 1), ("q", 3), ("q", 5)]
    assert R.sources_of("nope") == R.sources_of(None) == R.SOURCE_SETS["fulltext"]


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('\n# note\n{"a": 1}\n{"a": \n[1]\n  {"a": 2, "b": "x"}\n')
    got = R.jsonl(spark, str(tmp_path / "x.jsonl"), "a int, b string").collect()
    assert sorted((r.a, r.b or "") for r in got) == [(1, ""), (2, "x")]


def test_poll(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    papers = spark.createDataFrame([("a", at(1)), ("b", at(2)), ("c", at(2)), ("d", at(3))], "paper_key string, created_at timestamp")
    acked = spark.createDataFrame([("a",), ("b",)], "paper_key string")
    fresh, mark = W.poll(papers, acked, "2024-01-01 00:00:02")
    assert {r.paper_key for r in fresh.collect()} == {"c", "d"} and mark.first().watermark == at(3)
    more = W.acknowledge(acked, fresh)
    assert {r.paper_key for r in more.collect()} == set("abcd")
    assert {r.paper_key for r in W.release(more, acked).collect()} == {"c", "d"}
    assert W.poll(papers.limit(0), acked, None)[0].count() == 0


def test_stream(spark, tmp_path):
    """Each key is delivered once, also over a restart; logs are followed; windows close."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text('{"paper_key": "a", "created_at": "2024-01-01T00:00:01", "level": "INFO"}\n{"paper_key": "b", "created_at": "2024-01-01T00:00:02", "level": "WARN"}\n')
    schema = "paper_key string, created_at timestamp, level string"
    run = lambda: W.deliver(W.arrivals(W.follow(spark, str(folder), schema)), lambda df: df.select("paper_key"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    (folder / "2.json").write_text('{"paper_key": "b", "created_at": "2024-01-01T00:00:03", "level": "INFO"}\n{"paper_key": "c", "created_at": "2024-01-01T00:00:04", "level": "INFO"}\n')
    run()
    assert sorted(r.paper_key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
    counted = W.windowed(W.follow(spark, str(folder), schema, level="INFO"), "created_at", "1 minute").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    counted.awaitTermination()
    assert [r.n for r in spark.table("w").collect()] == [3]
