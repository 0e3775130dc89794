"""Raw records of literature services, as files, to rows of papers (rows S01-S18, D02).

A service's answers are expected as files; every projection is made of
built-in functions, so that a scan of many answers stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

# Sets of services, months.
SOURCE_SETS = {
    "pubmed": ["pubmed"],
    "arxiv": ["arxiv"],
    "both": ["pubmed", "arxiv"],
    "europepmc": ["europepmc"],
    "semantic_scholar": ["semantic_scholar"],
    "openalex": ["openalex"],
    "ncpssd": ["ncpssd"],
    "fulltext": ["europepmc", "arxiv", "semantic_scholar", "openalex"],
    "all": ["europepmc", "pubmed", "arxiv", "semantic_scholar", "openalex"],
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def sources_of(name: str | None) -> list[str]:
    """The services of a set; an unknown name stands for full text."""
    return SOURCE_SETS.get((name or "").lower(), SOURCE_SETS["fulltext"])


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines file; blank lines, # comments and what is no object are skipped."""
    lines = spark.read.text(path).select(F.trim("value").alias("_l")).filter(F.col("_l").startswith("{"))
    whole = F.try_parse_json("_l").isNotNull()
    return lines.filter(whole).select(F.from_json("_l", schema).alias("r")).select("r.*")


def merged_hits(hits: DataFrame, query: str, order: list[str], most: int) -> DataFrame:
    """Each query's hits in order, without those whose key or DOI an accepted one has, up to ``most``.

    A query's hits are few by construction: a page from each service of a set.
    """
    doi = F.lower(F.trim(F.coalesce("doi", F.lit(""))))
    row = F.struct(*order, F.coalesce("paper_key", F.lit("")).alias("k"), doi.alias("d"), F.struct(*[c for c in hits.columns if c != query]).alias("r"))
    lists = hits.groupBy(query).agg(F.array_sort(F.collect_list(row)).alias("_h"))
    start = F.filter("_h", lambda _: F.lit(False))

    def take(acc: Column, x: Column) -> Column:
        known = F.exists(acc, lambda y: (y["k"] == x["k"]) | ((x["d"] != "") & (y["d"] == x["d"])))
        return F.when(known | (F.size(acc) >= most), acc).otherwise(F.concat(acc, F.array(x)))

    return lists.select(query, F.explode(F.aggregate("_h", start, take)).alias("h")).select(query, "h.r.*")


def abstract_of(index: Column) -> Column:
    """The text of an inverted index map<word, positions>; null or empty: the empty text."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(F.coalesce(e["value"], F.array().cast("array<int>")), lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " "), F.lit(""))


def _plain(c: Column) -> Column:
    """An element's text: without tags, the entities that ``resolve_entities`` left as characters, white space collapsed; null where nothing is left."""
    return F.nullif(T.squeeze(T.markup_characters(F.regexp_replace(c, "<[^>]+>", ""))), F.lit(""))


def _element(c: Column, tag: str, attribute: str = "") -> Column:
    found = F.regexp_extract(c, rf"(?s)<{tag}(?=[\s>])[^>]*{attribute}[^>]*>(.*?)</{tag}>", 1)
    return _plain(found)


def _elements(c: Column, tag: str) -> Column:
    """Elements of a tag, with their tags."""
    return F.regexp_extract_all(c, F.lit(rf"(?s)<{tag}(?=[\s>])[^>]*>.*?</{tag}>"), F.lit(0))


def pub_date(year: Column, month: Column, day: Column) -> Column:
    """Year, month by name and day to a date; the first of January where one of them is missing."""
    low = F.lower(F.substring(month, 1, 3))
    number = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), low), F.lit(0).cast("long"))
    full = F.format_string("%d-%02d-%02d", year, number, F.expr("0") + day.try_cast("int"))
    return F.when(year.isNull(), F.lit(None)).otherwise(F.when(number.isNotNull() & day.try_cast("int").isNotNull(), full).otherwise(F.format_string("%d-01-01", year)))


def pubmed(answers: DataFrame, xml: str = "xml") -> DataFrame:
    """A paper of each answer (an article's XML); answers without an article go."""
    x = F.col(xml)
    article = F.regexp_extract(x, r"(?s)<Article(?=[\s>])[^>]*>(.*)</Article>", 1)
    issue = F.regexp_extract("_a", r"(?s)<PubDate>(.*?)</PubDate>", 1)
    year = F.coalesce(_element(F.col("_d"), "Year"), F.nullif(F.regexp_extract(_element(F.col("_d"), "MedlineDate"), r"\b((19|20)\d{2})\b", 1), F.lit(""))).try_cast("int")
    label = lambda e: F.nullif(F.regexp_extract(e, r'^<AbstractText[^>]*\bLabel="([^"]*)"', 1), F.lit(""))
    part = lambda e: F.when(_plain(e).isNotNull(), F.concat(F.coalesce(F.concat(label(e), F.lit(": ")), F.lit("")), _plain(e)))
    abstract = F.array_join(F.array_compact(F.transform(_elements(F.col("_a"), "AbstractText"), part)), "\n\n")
    person = lambda e: F.coalesce(F.nullif(F.concat_ws(" ", _element(e, "ForeName"), _element(e, "LastName")), F.lit("")), F.lit("Unknown"))
    homes = lambda e: F.array_distinct(F.array_compact(F.transform(_elements(e, "Affiliation"), _plain)))
    group = lambda e: _element(e, "CollectiveName")
    author = lambda e: F.struct(F.coalesce(group(e), person(e)).alias("name"), F.when(group(e).isNotNull(), F.array().cast("array<string>")).otherwise(homes(e)).alias("affiliations"))
    cut = answers.withColumn(xml, T.resolve_entities(x)).filter(x.rlike(r"<PubmedArticle[\s>]")).withColumn("_a", F.coalesce(F.nullif(article, F.lit("")), x)).withColumn("_d", issue)
    out = cut.select(
        F.concat(F.lit("pubmed:"), _element(x, "PMID")).alias("paper_key"),
        F.lit("pubmed").alias("source"),
        _element(F.col("_a"), "ArticleTitle").alias("title"),
        F.nullif(abstract, F.lit("")).alias("abstract"),
        F.coalesce(_element(x, "ArticleId", 'IdType="doi"'), _element(F.col("_a"), "ELocationID", 'EIdType="doi"')).alias("doi"),
        _element(x, "ArticleId", 'IdType="pmc"').alias("pmcid"),
        F.coalesce(_element(F.regexp_extract("_a", r"(?s)<Journal>(.*?)</Journal>", 1), "Title"), _element(F.col("_a"), "ISOAbbreviation")).alias("venue"),
        _element(F.col("_a"), "ISSN").alias("venue_issn"),
        year.alias("pub_year"),
        pub_date(year, _element(F.col("_d"), "Month"), _element(F.col("_d"), "Day")).alias("pub_date"),
        F.transform(_elements(F.col("_a"), "Author"), author).alias("authors"),
    )
    return out


def jats_text(xml: Column) -> Column:
    """Paragraphs, titles and captions of more than two characters, in order, without what repeats the one before it in any case."""
    tag = r"(?:[a-z]+:)?(p|title|caption)"
    bare = lambda c: T.squeeze(F.regexp_replace(c, "<[^>]+>", ""))
    found = F.transform(F.regexp_extract_all(xml, F.lit(rf"(?is)<{tag}(?=[\s>])[^>]*>.*?</(?:[a-z]+:)?\1>"), F.lit(0)), bare)
    # an entity is one character
    long = F.filter(found, lambda x: F.length(F.regexp_replace(x, r"&#?\w+;", "x")) > 2)
    kept = F.filter(long, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.get(long, i - 1))))
    return T.unescape(F.array_join(kept, "\n\n"))


def ncpssd(rows: DataFrame) -> DataFrame:
    """Rows of strings (id, title, creator, date, years, remark, subject, doi, pdfurl, beginpage, endpage, cbw_name) to papers."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    year = F.coalesce(F.when(F.substring(text("years"), 1, 4).rlike(r"^\d+$"), F.substring(text("years"), 1, 4).cast("int")), F.nullif(F.regexp_extract(text("date"), r"^\s*(\d{4})", 1), F.lit("")).cast("int"))
    day = F.replace(F.substring(text("date"), 1, 10), F.lit("T"), F.lit(" "))
    date = F.coalesce(F.when(F.length(day) == 10, day), F.when(year.isNotNull(), F.format_string("%d-01-01", year)))
    names = F.filter(F.transform(F.split(text("creator"), "[;；,，、]+"), lambda n: F.trim(n)), lambda x: x != "")
    pages = F.when((text("beginpage") != "") & (text("endpage") != ""), F.concat_ws("-", text("beginpage"), text("endpage"))).otherwise(text("beginpage"))
    return rows.select(
        F.when(text("id") != "", F.concat(F.lit("ncpssd:"), text("id"))).alias("paper_key"),
        F.lit("ncpssd").alias("source"),
        T.html_text(text("title")).alias("title"),
        T.html_text(text("remark")).alias("abstract"),
        F.nullif(F.regexp_replace(text("doi"), r"(?i)^https?://(dx\.)?doi\.org/", ""), F.lit("")).alias("doi"),
        T.html_text(text("cbw_name")).alias("venue"),
        year.alias("pub_year"),
        date.alias("pub_date"),
        F.transform(names, lambda n: F.struct(n.alias("name"), F.array().cast("array<string>").alias("affiliations"))).alias("authors"),
        pages.alias("pages"),
        T.html_text(text("subject")).alias("keywords"),
        F.when(text("pdfurl").startswith("https://www.ncpssd.cn"), text("pdfurl")).alias("pdf_url"),
    )
