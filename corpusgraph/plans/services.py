"""Queries of the services' answers, which are made from the part table as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import services as V
from . import bindings as B
from .registry import query



def _odd():
    return F.col("p_partkey") % 2 == 1


def _none():
    return F.lit(None).cast("string")


def _answers(spark, d, answer):
    """id and JSON of each part; some answers are broken and count for nothing."""
    p = B.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 50 == 0, "{broken").when(F.col("p_partkey") % 50 == 1, "[1]").otherwise(F.to_json(answer)).alias("answer"))


def _s(**fields):
    return F.struct(*[(f if hasattr(f, "alias") else F.lit(f)).alias(k) for k, f in fields.items()])


def _who(c="authors"):
    return F.array_join(F.transform(c, lambda a: F.concat(F.coalesce(a["name"], F.lit("?")), F.lit("@"), F.array_join(a["affiliations"], "+"))), "|")


_KEPT = "p_partkey % 50 not in (0, 1)"
_K = "cast(p_partkey as varchar)"


@query("s03_arxiv", f"select p_partkey as id, 'arxiv:' || {_K} || 'v1' as paper_key, p_name || ' on two lines' as title, 'Sum' as abstract, 2000 + p_size as pub_year, cast(2000 + p_size as varchar) || '-03-04' as pub_date, p_brand || '@' as authors, 'https://arxiv.org/pdf/' || {_K} || 'v1' as pdf_url from part where {_KEPT}")
def s03(spark, d):
    key = F.concat(F.col("p_partkey").cast("string"), F.lit("v1"))
    found = V.arxiv(_answers(spark, d, _s(short_id=key, title=F.concat(F.lit(" "), "p_name", F.lit(" on\ntwo lines\n")), summary=" Sum\n", published=F.concat(2000 + F.col("p_size"), F.lit("-03-04T05:06:07Z")), authors=F.array(_s(name=F.col("p_brand"))))))
    return found.select("id", "paper_key", "title", "abstract", "pub_year", "pub_date", _who().alias("authors"), "pdf_url")


def _alex(spark, d):
    place = lambda name, url: _s(pdf_url=url, source=_s(display_name=name, type="journal", issn_l="1-2"))
    people = F.array(_s(author=_s(id="A1", display_name=F.col("p_brand"), orcid=F.concat(F.lit("o"), F.col("p_size"))), institutions=F.array(_s(display_name=F.col("p_type")), _s(display_name=_none()))), _s(author=_s(id="A2", display_name="Ada", orcid=_none()), institutions=F.array(_s(display_name=_none()))))
    index = F.map_from_arrays(F.array(F.lit("world"), F.lit("hello")), F.array(F.array(F.lit(1), F.lit(3)), F.array(F.lit(0), F.lit(2))))
    work = _s(id=F.concat(F.lit("https://openalex.org/W"), F.col("p_partkey"), F.lit("/")), doi=F.concat(F.lit("https://doi.org/10.1/"), F.col("p_partkey")), title=F.concat("p_name", F.lit(" ")), publication_year=1990 + F.col("p_size"), publication_date=F.when(_odd(), "1999-01-02"), cited_by_count=F.col("p_size"),
              primary_location=place(F.col("p_name"), "http://first"), best_oa_location=F.when(_odd(), place(F.col("p_brand"), "http://best")), authorships=people, open_access=_s(is_oa=_odd()), abstract_inverted_index=index)
    return V.openalex(_answers(spark, d, work))


@query("s04_openalex", f"select p_partkey as id, 'openalex:W' || {_K} as paper_key, p_name as title, 'hello world hello world' as abstract, case when p_partkey % 2 = 1 then p_brand else p_name end as venue, 1990 + p_size as pub_year, case when p_partkey % 2 = 1 then 'Published' end as publication_status, p_brand || '@' || p_type || '|Ada@' as authors, case when p_size % 2 = 0 then cast(p_size as double) end as avg_h_index, p_partkey % 2 = 1 as is_open_access, case when p_partkey % 2 = 1 then 'http://best' else 'http://first' end as pdf_url from part where {_KEPT}")
def s04(spark, d):
    h = spark.range(1, 100).filter("id % 2 = 0").select(F.concat(F.lit("o"), "id").alias("orcid"), F.col("id").cast("double").alias("h_index"))
    found = V.author_h(_alex(spark, d), h)
    return found.select("id", "paper_key", "title", "abstract", "venue", "pub_year", "publication_status", _who().alias("authors"), "avg_h_index", "is_open_access", "pdf_url")


def _ref(spark, d):
    message = _s(DOI=F.concat(F.lit("10.1/"), F.col("p_partkey")), title=F.array("p_name"), author=F.array(_s(given="Ada", family=F.col("p_brand"), ORCID="http://orcid.org/1", affiliation=F.array(_s(name=F.col("p_type"))))), **{"container-title": F.array(F.lit("Organic Letters")), "type": F.when(_odd(), "journal-article").otherwise("book"), "published-online": _s(**{"date-parts": F.array(F.when(_odd(), F.array(1980 + F.col("p_size"), F.lit(2))).otherwise(F.array(1980 + F.col("p_size"))))})})
    return V.crossref(_answers(spark, d, message))


@query("s06_crossref", f"select p_partkey as id, '10.1/' || {_K} as doi, p_name as title, 'Organic Letters' as venue, case when p_partkey % 2 = 1 then 'journal' else 'book' end as source_type, 1980 + p_size as pub_year, cast(1980 + p_size as varchar) || case when p_partkey % 2 = 1 then '-01-01' else '' end as pub_date, 'Ada ' || p_brand || '@' || p_type as authors from part where {_KEPT}")
def s06(spark, d):
    return _ref(spark, d).select("id", "doi", "title", "venue", "source_type", "pub_year", "pub_date", _who().alias("authors"))


@query("s06_title_match", "select p_partkey as ref, case when length(p_name) < 10 then null when p_size % 2 = 0 then 2 else 3 end as n from part where length(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'))) >= 10")
def s06_match(spark, d):
    p = B.table(spark, d, "part")
    hits = p.select(F.col("p_partkey").alias("ref"), F.col("p_name").alias("asked"), F.explode(F.array(_s(n=F.lit(1), title=F.lit("zzzzzz yyyyyy xxxxxx")), _s(n=F.lit(2), title=F.when(F.col("p_size") % 2 == 0, F.concat(F.upper("p_name"), F.lit("!"))).otherwise("no such thing at all")), _s(n=F.lit(3), title=F.concat(F.lit("On "), "p_name")))).alias("h"))
    return V.title_matches(hits.select("ref", "asked", "h.*"), "ref", "asked", "title", "n").select("ref", "n")


@query("s10_europepmc", f"select p_partkey as id, 'europepmc:' || case when p_partkey % 2 = 1 then 'MED' else 'EPMC' end || ':' || {_K} as paper_key, p_name as title, case when p_partkey % 2 = 1 then p_brand else 'Other' end as venue, 1990 + p_size as pub_year, 'A B@|C@' as authors, 'http://pdf' as pdf_url, case when p_partkey % 2 = 1 then 'MED' else 'EPMC' end || '/' || {_K} as known_as, '(' || p_name || ') AND (OPEN_ACCESS:Y)' as q from part where {_KEPT}")
def s10(spark, d):
    urls = F.array(_s(documentStyle="html", availability="Open access", url="http://page"), _s(documentStyle="PDF", availability="Subscription", url="http://paid"), _s(documentStyle="pdf", availability="Open access", url="http://pdf"))
    found = V.europepmc(_answers(spark, d, _s(source=F.when(_odd(), "MED"), id=F.col("p_partkey").cast("string"), authorString="A B, C, ", title=F.concat(F.lit(" "), "p_name"), journalTitle=F.when(_odd(), F.col("p_brand")), journalInfo=_s(journal=_s(title="Other")), pubYear=(1990 + F.col("p_size")).cast("string"), fullTextUrlList=_s(fullTextUrl=urls))))
    known = V.source_id(F.col("paper_key"), F.col("pmid"), F.col("pmcid"))
    return found.select("id", "paper_key", "title", "venue", "pub_year", _who().alias("authors"), "pdf_url", F.concat_ws("/", known["source"], known["id"]).alias("known_as"), V.open_access_query(F.col("title")).alias("q"))


@query("s11_citation_edges", """select distinct case direction when 'references' then 'k' || l_orderkey else other end as src, case direction when 'references' then other else 'k' || l_orderkey end as dst, direction from
 (select l_orderkey, unnest(['references', 'citations']) as direction, case l_suppkey % 4 when 0 then 'europepmc:MED:' || l_partkey when 1 then 'europepmc:PMC:PMC' || l_partkey when 2 then 'europepmc:title:title ' || l_partkey end as other from lineitem where l_linenumber <= 2) where other is not null""")
def s11(spark, d):
    s, k = F.col("l_suppkey") % 4, F.col("l_partkey").cast("string")
    work = F.struct(F.when(s == 0, "med").when(s == 1, "AGR").alias("source"), F.when(s == 0, k).alias("id"), F.lit(None).cast("string").alias("pmid"), F.when(s == 1, F.concat(F.lit("PMC"), k)).alias("pmcid"), F.when(s == 2, F.concat(F.lit("Title "), k)).alias("title"))
    lists = B.table(spark, d, "lineitem").filter("l_linenumber <= 2").groupBy(F.concat(F.lit("k"), "l_orderkey").alias("paper_key")).agg(F.collect_list(work).alias("references"), F.collect_list(work).alias("citations"))
    return V.citation_edges(lists)


@query("s12_semantic_scholar", f"select p_partkey as id, 'semantic_scholar:s' || {_K} as paper_key, p_name as title, case when p_partkey % 2 = 1 then p_brand else p_type end as venue, case when p_partkey % 2 = 1 then 'journal' end as source_type, '10.2/' || {_K} as doi, 'Ada@' as authors, 'http://s' as pdf_url from part where {_KEPT}")
def s12(spark, d):
    found = V.semantic_scholar(_answers(spark, d, _s(paperId=F.concat(F.lit("s"), F.col("p_partkey")), title=F.col("p_name"), venue=F.col("p_type"), publicationVenue=F.when(_odd(), _s(name=F.col("p_brand"))), authors=F.array(_s(name="Ada"), _s(name="")), externalIds=_s(DOI=F.concat(F.lit("10.2/"), F.col("p_partkey"))), openAccessPdf=_s(url="http://s"))))
    return found.select("id", "paper_key", "title", "venue", "source_type", "doi", _who().alias("authors"), "pdf_url")


def _pdfs(spark, d):
    where = F.when(_odd(), _s(url_for_pdf=_none(), url="http://x/A.PDF")).otherwise(_s(url_for_pdf=_none(), url="http://x/page"))
    return V.unpaywall(_answers(spark, d, _s(doi=F.concat(F.lit("10.1/"), F.col("p_partkey")), is_oa=True, oa_status="gold", best_oa_location=where)))


@query("s13_unpaywall", f"select p_partkey as id, '10.1/' || {_K} as doi, case when p_partkey % 2 = 1 then 'http://x/A.PDF' end as pdf_url, true as is_oa, 'gold' as oa_status from part where {_KEPT}")
def s13(spark, d):
    return _pdfs(spark, d)


@query("s14_terms", "select event_id, event_type from events where (event_type ilike '%cl%' or props ilike '%cl%') and (event_type ilike '%7%' or props ilike '%7%')")
def s14(spark, d):
    assert V.term_query(["a", "", "b"], ("X", "Y")) == '(X="a" OR Y="a") AND (X="b" OR Y="b")'
    return B.table(spark, d, "events").filter(V.term_filter(["CL", "", "7"], ["event_type", "props"])).select("event_id", "event_type")


@query("s14_distinct_rows", "select id, title, place from (select p_size as id, p_name as title, p_partkey as place, row_number() over (partition by p_size, p_name order by p_partkey) as n from part) where n = 1 order by place limit 500")
def s14_rows(spark, d):
    rows = B.table(spark, d, "part").select(F.col("p_size").alias("id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<b>"), "p_name", F.lit("</b>"))).otherwise(F.col("p_name")).alias("title"), F.col("p_partkey").alias("place"))
    return V.distinct_rows(rows, 500, ["place"]).select("id", F.regexp_replace("title", "</?b>", "").alias("title"), "place")


def _bare(spark, d):
    person = F.struct(*[F.lit(x).cast(t).alias(c) for c, x, t in (("name", "", "string"), ("given", None, "string"), ("family", None, "string"), ("orcid", "own", "string"), ("h_index", None, "double"), ("affiliations", None, "array<string>"))])
    values = {"paper_key": F.concat(F.lit("k"), F.col("p_partkey")), "source": F.lit("own"), "doi": F.concat(F.lit("doi:10.1/"), F.col("p_partkey")), "title": F.lit(""), "pub_year": F.when(F.col("p_size") % 2 == 0, 1), "authors": F.when(F.col("p_size") % 3 == 0, F.array(person)), "venue": F.lit(None)}
    return B.table(spark, d, "part").select(F.col("p_partkey").alias("id"), *[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in V.PAPER.items()])


@query("j21_merge_metadata", f"select p_partkey as id, case when {_KEPT} then p_name else '' end as title, case when p_size % 2 = 0 then 1 when {_KEPT} then 1990 + p_size end as pub_year, case when p_size % 3 = 0 then case when {_KEPT} then p_brand || '@' || p_type || '@own' else '@@own' end when {_KEPT} then p_brand || '@' || p_type || '@o' || p_size || '|Ada@@' end as authors from part")
def j21(spark, d):
    from ..functions import text as T

    tidy = lambda df: df.withColumn("doi", T.doi_key(F.col("doi")))
    got = V.merge(tidy(_bare(spark, d)), tidy(_alex(spark, d)), "doi")
    people = F.array_join(F.transform("authors", lambda a: F.concat_ws("@", F.coalesce(a["name"], F.lit("")), F.array_join(a["affiliations"], "+"), F.coalesce(a["orcid"], F.lit("")))), "|")
    return got.select("id", F.coalesce("title", F.lit("")).alias("title"), "pub_year", people.alias("authors"))


@query("j22_enrich", f"select p_partkey as id, case when {_KEPT} then case when p_partkey % 3 = 0 then case when p_partkey % 2 = 1 then p_brand else p_name end else 'Organic Letters' end end as venue, case when {_KEPT} then case when p_partkey % 3 = 0 then case when p_partkey % 2 = 1 then 'http://best' else 'http://first' end else case when p_partkey % 2 = 1 then 'http://x/A.PDF' end end end as pdf_url from part")
def j22(spark, d):
    found = V.enrich(_bare(spark, d), _alex(spark, d).filter("id % 3 = 0"), _ref(spark, d), _pdfs(spark, d))
    return found.select("id", "venue", "pdf_url")
