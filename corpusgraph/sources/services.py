"""Answers of literature services, read from files as JSON, to papers; and what one record adds to another (rows S03, S04, S06, S09-S14, S19, J21, J22)."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .records import abstract_of

_PERSON = "struct<name:string,given:string,family:string,orcid:string,h_index:double,affiliations:array<string>>"
_PLACE = "struct<pdf_url:string,source:struct<display_name:string,type:string,issn_l:string>>"
#: The fields of the services' answers that are read.
SCHEMAS = {
    "arxiv": "short_id string, title string, summary string, doi string, published string, authors array<struct<name:string>>, pdf_url string",
    "openalex": f"id string, doi string, title string, publication_year int, publication_date string, cited_by_count int, primary_location {_PLACE}, best_oa_location {_PLACE}, authorships array<struct<author:struct<id:string,display_name:string,orcid:string>,institutions:array<struct<display_name:string>>,raw_affiliation_strings:array<string>>>, open_access struct<is_oa:boolean,oa_url:string>, ids struct<pmcid:string>, abstract_inverted_index map<string,array<int>>",
    "crossref": "DOI string, title array<string>, author array<struct<given:string,family:string,ORCID:string,affiliation:array<struct<name:string>>>>, `container-title` array<string>, type string, `published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>",
    "europepmc": "source string, id string, pmid string, pmcid string, authorString string, title string, abstractText string, doi string, journalTitle string, journalInfo struct<journal:struct<title:string>>, pubYear string, pubDate string, firstPublicationDate string, isOpenAccess string, fullTextUrlList struct<fullTextUrl:array<struct<documentStyle:string,availability:string,url:string>>>",
    "semantic_scholar": "paperId string, title string, abstract string, year int, venue string, publicationVenue struct<name:string>, publicationDate string, authors array<struct<name:string>>, externalIds struct<DOI:string,ArXiv:string,PubMed:string>, openAccessPdf struct<url:string>, isOpenAccess boolean",
    "unpaywall": "doi string, is_oa boolean, oa_status string, best_oa_location struct<url_for_pdf:string,url:string>",
}
#: What every service's papers have, absent values being null.
PAPER = {
    "paper_key": "string", "source": "string", "title": "string", "abstract": "string", "doi": "string", "venue": "string", "venue_issn": "string", "source_type": "string", "pub_year": "int", "pub_date": "string",
    "publication_status": "string", "citation_count": "int", "avg_h_index": "double", "authors": f"array<{_PERSON}>", "pdf_url": "string", "is_open_access": "boolean", "pmid": "string", "pmcid": "string",
}
FIELDS = {"all": ("IKTE", "IKST", "IKET")}


def _paper(df: DataFrame, keep: list[str], **values: Column) -> DataFrame:
    return df.select(*keep, *[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in PAPER.items()])


def _person(name: Column, given: Column | None = None, family: Column | None = None, orcid: Column | None = None, homes: Column | None = None, h: Column | None = None) -> Column:
    none = F.lit(None)
    parts = {"name": (name, "string"), "given": (given, "string"), "family": (family, "string"), "orcid": (orcid, "string"), "h_index": (h, "double"), "affiliations": (F.array().cast("array<string>") if homes is None else homes, "array<string>")}
    return F.struct(*[(none if c is None else c).cast(t).alias(k) for k, (c, t) in parts.items()])


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _line(c: Column) -> Column:
    return F.replace(T.strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))


def _names(c: Column) -> Column:
    return F.transform(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda n: F.trim(n)), lambda n: n != ""), lambda n: _person(n))


def read(answers: DataFrame, service: str, answer: str = "answer") -> tuple[DataFrame, list[str]]:
    """``answers`` with the parsed answer as r, and its other columns; what is no JSON object goes."""
    keep = [c for c in answers.columns if c != answer]
    return answers.withColumn("r", F.from_json(answer, SCHEMAS[service])).filter(F.schema_of_variant(F.try_parse_json(answer)).startswith("OBJECT")).drop(answer), keep


def arxiv(answers: DataFrame) -> DataFrame:
    """Papers of arXiv entries."""
    df, keep = read(answers, "arxiv")
    r = F.col("r")
    return _paper(df, keep, paper_key=F.concat(F.lit("arxiv:"), r["short_id"]), source=F.lit("arxiv"), title=_line(r["title"]), abstract=_line(r["summary"]), doi=r["doi"], venue=F.lit("arXiv"), source_type=F.lit("repository"), pub_year=F.substring(r["published"], 1, 4).try_cast("int"),
                  pub_date=F.substring(r["published"], 1, 10), publication_status=F.lit("Preprint"), authors=F.transform(r["authors"], lambda a: _person(a["name"])), pdf_url=F.coalesce(r["pdf_url"], F.concat(F.lit("https://arxiv.org/pdf/"), r["short_id"])))


def openalex(answers: DataFrame) -> DataFrame:
    """Papers of OpenAlex works."""
    df, keep = read(answers, "openalex")
    r = F.col("r")
    place = F.coalesce(r["best_oa_location"], r["primary_location"])
    homes = lambda a: F.filter(F.transform(F.coalesce(a["institutions"], F.array().cast("array<struct<display_name:string>>")), lambda i: i["display_name"]), lambda x: F.coalesce(x, F.lit("")) != "")
    ident = F.substring_index(F.regexp_replace(r["id"], "/+$", ""), "/", -1)
    return _paper(df, keep, paper_key=F.when(F.coalesce(r["id"], F.lit("")) != "", F.concat(F.lit("openalex:"), ident)), source=F.lit("openalex"), title=T.strip(F.coalesce(r["title"], F.lit(""))), abstract=abstract_of(r["abstract_inverted_index"]), doi=r["doi"], venue=place["source"]["display_name"],
                  venue_issn=place["source"]["issn_l"], source_type=place["source"]["type"], pub_year=r["publication_year"], pub_date=r["publication_date"], publication_status=F.when(r["publication_date"].isNotNull(), "Published"), citation_count=r["cited_by_count"],
                  authors=F.transform(r["authorships"], lambda a: _person(a["author"]["display_name"], orcid=a["author"]["orcid"], homes=homes(a))), is_open_access=F.coalesce(r["open_access"]["is_oa"], F.lit(False)), pdf_url=F.coalesce(_some(r["best_oa_location"]["pdf_url"]), r["primary_location"]["pdf_url"]), pmcid=r["ids"]["pmcid"])


def author_h(papers: DataFrame, h: DataFrame) -> DataFrame:
    """Papers with their authors' h indices (orcid, h_index), and the mean of those that are known."""
    people = papers.select("paper_key", F.posexplode_outer("authors").alias("_n", "_a"))
    known = people.join(h.select(F.col("orcid").alias("_o"), F.col("h_index").alias("_h")), F.col("_a.orcid") == F.col("_o"), "left")
    person = F.col("_a").withField("h_index", F.coalesce("_h", F.col("_a.h_index")))
    one = known.groupBy("paper_key").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_a").isNotNull(), F.struct("_n", person.alias("a"))))), lambda x: x["a"]).alias("_authors"), F.avg("_h").alias("_mean"))
    return papers.join(one, "paper_key", "left").withColumns({"authors": F.coalesce("_authors", "authors"), "avg_h_index": F.coalesce("_mean", "avg_h_index")}).select(*papers.columns)


def crossref(answers: DataFrame) -> DataFrame:
    """Papers of Crossref messages, which have no key of their own."""
    df, keep = read(answers, "crossref")
    r = F.col("r")
    dates = F.coalesce(r["published-print"], r["published-online"])["date-parts"][0]
    year = dates[0]
    homes = lambda a: F.filter(F.transform(F.coalesce(a["affiliation"], F.array().cast("array<struct<name:string>>")), lambda x: x["name"]), lambda x: F.coalesce(x, F.lit("")) != "")
    author = lambda a: _person(F.trim(F.concat_ws(" ", a["given"], a["family"])), a["given"], a["family"], F.replace(F.coalesce(a["ORCID"], F.lit("")), F.lit("http://orcid.org/"), F.lit("")), homes(a))
    return _paper(df, keep, source=F.lit("crossref"), title=F.get(r["title"], F.lit(0)), doi=r["DOI"], venue=F.get(r["container-title"], F.lit(0)), source_type=F.when(r["type"] == "journal-article", "journal").otherwise(r["type"]), pub_year=year,
                  pub_date=F.when(F.size(dates) > 1, F.concat(year.cast("string"), F.lit("-01-01"))).otherwise(year.cast("string")), publication_status=F.lit("Published"), authors=F.transform(r["author"], author))


def title_matches(hits: DataFrame, ref: str, asked: str, title: str, order: str) -> DataFrame:
    """Of each reference's hits, the first whose title is similar to the one asked for."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    a, b = norm(F.col(asked)), norm(F.col(title))
    words = lambda c: F.array_distinct(F.split(c, " "))
    overlap = F.size(F.array_intersect(words(a), words(b))) / F.least(F.size(words(a)), F.size(words(b)))
    similar = (F.length(a) >= 10) & (F.length(b) >= 10) & (F.contains(a, b) | F.contains(b, a) | (overlap >= 0.7))
    cols = [c for c in hits.columns if c != ref]
    return hits.filter(similar).groupBy(ref).agg(F.min_by(F.struct(*cols), order).alias("_h")).select(ref, "_h.*")


def europepmc(answers: DataFrame) -> DataFrame:
    """Papers of Europe PMC results; the first open PDF is theirs."""
    df, keep = read(answers, "europepmc")
    r = F.col("r")
    open_pdf = F.filter(r["fullTextUrlList"]["fullTextUrl"], lambda u: (F.lower(u["documentStyle"]) == "pdf") & F.lower(u["availability"]).contains("open access") & (F.coalesce(u["url"], F.lit("")) != ""))
    said = lambda c: T.strip(F.coalesce(r[c], F.lit("")))
    return _paper(df, keep, paper_key=F.concat_ws(":", F.lit("europepmc"), F.coalesce(_some(r["source"]), F.lit("EPMC")), F.coalesce(r["id"], F.lit(""))), source=F.lit("europepmc"), title=said("title"), abstract=said("abstractText"), doi=r["doi"], venue=F.coalesce(_some(r["journalTitle"]), r["journalInfo"]["journal"]["title"]),
                  source_type=F.when(F.coalesce(r["journalTitle"], F.lit("")) != "", "journal"), pub_year=r["pubYear"].try_cast("int"), pub_date=F.coalesce(_some(r["pubDate"]), r["firstPublicationDate"]), publication_status=F.lit("Published"), authors=_names(r["authorString"]),
                  pmid=r["pmid"], pmcid=r["pmcid"], is_open_access=F.coalesce(r["isOpenAccess"], F.lit("")) != "", pdf_url=F.get(open_pdf, F.lit(0))["url"])


def open_access_query(q: Column) -> Column:
    """A query that asks for open access, unless it does."""
    text = F.coalesce(q, F.lit(""))
    return F.when(F.contains(F.upper(text), F.lit("OPEN_ACCESS")), text).otherwise(F.concat(F.lit("("), text, F.lit(") AND (OPEN_ACCESS:Y)")))


def source_id(paper_key: Column, pmid: Column, pmcid: Column) -> Column:
    """struct<source, id> under which Europe PMC knows a paper; null where it does not."""
    parts = F.split(paper_key, ":", 3)
    own = paper_key.startswith("europepmc:") & (F.size(parts) == 3) & (F.get(parts, F.lit(1)) != "") & (F.get(parts, F.lit(2)) != "")
    pair = lambda a, b: F.struct(a.alias("source"), b.alias("id"))
    return F.when(own, pair(F.upper(F.get(parts, F.lit(1))), F.get(parts, F.lit(2)))).when(F.coalesce(pmid, F.lit("")) != "", pair(F.lit("MED"), pmid)).when(F.coalesce(pmcid, F.lit("")) != "", pair(F.lit("PMC"), F.regexp_replace(pmcid, "^[PMC]+", "")))


def reference_key(r: Column) -> Column:
    """The key of a cited work (source, id, pmid, pmcid, title)."""
    said = lambda c: F.trim(F.coalesce(r[c], F.lit("")))
    ident = F.coalesce(_some(said("id")), _some(said("pmid")), said("pmcid"))
    source = F.upper(F.coalesce(_some(r["source"]), F.lit("MED")))
    source = F.when(source.isin("MED", "PMC"), source).when(said("pmid") != "", "MED").otherwise("PMC")
    return F.when(ident != "", F.concat_ws(":", F.lit("europepmc"), source, ident)).when(said("title") != "", F.concat(F.lit("europepmc:title:"), F.substring(F.lower(said("title")), 1, 120)))


def citation_edges(lists: DataFrame) -> DataFrame:
    """Src, dst, direction of papers' lists (paper_key, references, citations); a cited work without a key goes."""
    edge = lambda c, direction: lists.select("paper_key", F.explode(c).alias("r")).select("paper_key", reference_key(F.col("r")).alias("other"), F.lit(direction).alias("direction"))
    both = edge("references", "references").unionByName(edge("citations", "citations")).filter("other is not null")
    cites = F.col("direction") == "references"
    return both.select(F.when(cites, F.col("paper_key")).otherwise(F.col("other")).alias("src"), F.when(cites, F.col("other")).otherwise(F.col("paper_key")).alias("dst"), "direction").distinct()


def semantic_scholar(answers: DataFrame) -> DataFrame:
    """Papers of Semantic Scholar results."""
    df, keep = read(answers, "semantic_scholar")
    r = F.col("r")
    said = lambda c: T.strip(F.coalesce(r[c], F.lit("")))
    people = F.filter(r["authors"], lambda a: F.coalesce(a["name"], F.lit("")) != "")
    return _paper(df, keep, paper_key=F.when(F.coalesce(r["paperId"], F.lit("")) != "", F.concat(F.lit("semantic_scholar:"), r["paperId"])), source=F.lit("semantic_scholar"), title=said("title"), abstract=said("abstract"), doi=r["externalIds"]["DOI"], venue=F.coalesce(r["publicationVenue"]["name"], r["venue"]),
                  source_type=F.when(r["publicationVenue"].isNotNull(), "journal"), pub_year=r["year"], pub_date=r["publicationDate"], publication_status=F.when(r["publicationDate"].isNotNull(), "Published"), authors=F.transform(people, lambda a: _person(a["name"])),
                  is_open_access=F.coalesce(r["isOpenAccess"], F.lit(False)), pdf_url=r["openAccessPdf"]["url"], pmid=r["externalIds"]["PubMed"])


def unpaywall(answers: DataFrame) -> DataFrame:
    """Doi, pdf_url, is_oa, oa_status of Unpaywall answers; a plain url counts where it is a PDF's."""
    df, keep = read(answers, "unpaywall")
    r, best = F.col("r"), F.col("r.best_oa_location")
    pdf = F.coalesce(_some(best["url_for_pdf"]), F.when(F.lower(best["url"]).endswith(".pdf"), best["url"]))
    return df.select(*keep, r["doi"].alias("doi"), pdf.alias("pdf_url"), F.coalesce(r["is_oa"], F.lit(False)).alias("is_oa"), r["oa_status"].alias("oa_status"))


def term_query(terms: list[str], fields: tuple[str, ...] = FIELDS["all"]) -> str:
    """All terms, each in any of the fields, as a service's query."""
    return " AND ".join("(" + " OR ".join(f'{f}="{t}"' for f in fields) + ")" for t in terms if t)


def term_filter(terms: list[str], columns: list[str]) -> Column:
    """The same over the columns of a table."""
    return reduce(and_, [reduce(or_, [F.coalesce(F.contains(F.lower(c), F.lit(t.lower())), F.lit(False)) for c in columns]) for t in terms if t], F.lit(True))


def distinct_rows(rows: DataFrame, most: int, order: list[str]) -> DataFrame:
    """The first rows in order, one for each id and cleaned title."""
    key = F.concat_ws("|", "id", T.html_text(F.col("title")))
    first = rows.withColumn("_k", key).groupBy("_k").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_r")).select("_r.*")
    return first.orderBy(*order).limit(max(1, most))


def merge(base: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Papers with what ``extra`` (matched by key) adds: fields that are null or empty, and of the authors, place by place, names, homes, h index and orcid."""
    a, b = base.alias("a"), extra.dropDuplicates([key]).alias("b")
    fields = ["title", "abstract", "doi", "venue", "venue_issn", "source_type", "pub_year", "pub_date", "publication_status", "citation_count", "avg_h_index", "pdf_url"]
    empty = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    homes = lambda x: F.when(F.size(x) > 0, x)
    none = F.array().cast("array<string>")

    def person(x: Column, i: Column) -> Column:
        y = F.get(F.col("b.authors"), i)
        return F.struct(F.coalesce(_some(x["name"]), y["name"]).alias("name"), x["given"].alias("given"), x["family"].alias("family"), F.coalesce(_some(x["orcid"]), y["orcid"]).alias("orcid"), F.coalesce(x["h_index"], y["h_index"]).alias("h_index"), F.coalesce(homes(x["affiliations"]), homes(y["affiliations"]), none).alias("affiliations"))

    fresh = F.transform("b.authors", lambda y: y.withField("name", F.coalesce(_some(y["name"]), _some(F.concat_ws(" ", y["given"], y["family"])), F.lit("Unknown"))))
    authors = F.when(F.coalesce(F.size("a.authors"), F.lit(0)) <= 0, F.coalesce(fresh, F.col("a.authors"))).otherwise(F.transform("a.authors", person))
    pick = lambda c: F.coalesce(empty(f"a.{c}"), F.col(f"b.{c}")) if c in fields and c in extra.columns and c != key else authors if c == "authors" else F.col(f"a.{c}")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left").select(*[pick(c).alias(c) for c in base.columns])


def enrich(papers: DataFrame, alex: DataFrame, ref: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Papers (with a doi) after OpenAlex, then Crossref where doi, venue or authors are missing, then Unpaywall where there is no PDF; all matched by DOI."""
    keyed = lambda df: df.withColumn("doi", F.nullif(T.doi_key(F.col("doi")), F.lit("")))
    first = merge(keyed(papers), keyed(alex).filter("doi is not null"), "doi")
    lacking = (F.coalesce("venue", F.lit("")) == "") | (F.coalesce(F.size("authors"), F.lit(0)) <= 0)
    second = merge(first.filter(lacking), keyed(ref).filter("doi is not null"), "doi").unionByName(first.filter(~lacking))
    free = keyed(pdfs).filter("pdf_url is not null and doi is not null").groupBy("doi").agg(F.min_by("pdf_url", "pdf_url").alias("_pdf"), F.bool_or("is_oa").alias("_oa"))
    wanted = F.coalesce("pdf_url", F.lit("")) == ""
    found = second.join(free, "doi", "left")
    return found.withColumn("is_open_access", F.when(wanted & F.col("_pdf").isNotNull(), F.col("_oa")).otherwise(F.col("is_open_access"))).withColumn("pdf_url", F.when(wanted, F.coalesce("_pdf", "pdf_url")).otherwise(F.col("pdf_url"))).select(*papers.columns)
