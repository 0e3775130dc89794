"""Queries of citation styles and exports over works made from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citing as C
from ..operators import library as L
from . import bindings as B
from .registry import query

OVERRIDES = {"organic letters": ("Organic Letters", "Org. Lett.")}
_AUTHORS = ('["Ada Lovelace","Turing, Alan M.","张 三","Grace B. Hopper"]', "Li Wei; 王五", '[{"name":"Jean-Paul Sartre"},{"full_name":"Núñez"}]')
_SOURCES = ("journal-article", "proceedings-article", "book_chapter")


def _pick(n: str, values: tuple[str, ...]) -> str:
    return f"case {n} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


_COLUMNS = {
    "grp": "p_size", "id": "p_partkey", "title": "p_name", "authors_meta": _pick("p_partkey % 4", _AUTHORS),
    "venue": "case when p_size % 3 = 0 then 'Organic  Letters (Online)' else p_brand end", "journal": "cast(null as string)", "publisher": "'Zed Núñez'",
    "pub_year": "case when p_size = 7 then null else 1990 + p_size end", "volume": "cast(p_size as string)", "issue": "case when p_partkey % 2 = 1 then '3' end",
    "pages": "case when p_partkey % 5 = 0 then '12-20' end", "doi": "case when p_partkey % 3 <> 0 then concat('10.1/', p_partkey) end", "url": "concat('http://x/', p_partkey)",
    "source_type": _pick("cast(floor(p_partkey / 4) as int) % 4", _SOURCES), "abstract": "case when p_partkey % 6 = 0 then 'About it' end",
}


def records(spark, d):
    return B.table(spark, d, "part").selectExpr(*[f"{e} as {c}" for c, e in _COLUMNS.items()])


_SHOWN = {
    "gb7714": ("Ada Lovelace, Turing, Alan M., 张三, 等", "Li Wei, 王五", "Jean-Paul Sartre, Núñez", "无"),
    "apa": ("Lovelace, A., Turing, A. M., 三, 张., & Hopper, G. B.", "Wei, L., & 王五", "Sartre, J. P., & Núñez", "n.d."),
    "acs": ("Lovelace, A.; Turing, A. M.; 三, 张.; Hopper, G. B.", "Wei, L. and 王五", "Sartre, J. P. and Núñez", "n.d."),
    "bibtex": ("Ada Lovelace and Turing, Alan M. and 张 三 and Grace B. Hopper", "Li Wei and 王五", "Jean-Paul Sartre and Núñez", "n.d."),
    "ris": ("AU  - Ada Lovelace\nAU  - Turing, Alan M.\nAU  - 张 三\nAU  - Grace B. Hopper\n", "AU  - Li Wei\nAU  - 王五\n", "AU  - Jean-Paul Sartre\nAU  - Núñez\n", ""),
    "markdown": ("\n作者：Ada Lovelace；Turing, Alan M.；张 三；Grace B. Hopper\n", "\n作者：Li Wei；王五\n", "\n作者：Jean-Paul Sartre；Núñez\n", ""),
}
_REC = f"with r as (select *, case when id % 5 = 0 then ', ' || pages else '' end as pp, ', ' || volume || case when issue is null then '' else '(' || issue || ')' end as vp, case when grp % 3 = 0 then 'Organic Letters' else venue end as vl, case when grp % 3 = 0 then 'Org. Lett.' else venue end as va, row_number() over (partition by grp order by id) as n from (select {', '.join(f'{e} as {c}' for c, e in _COLUMNS.items())} from part))"
_Y = "coalesce(cast(pub_year as varchar), '{}')"


def _fill(expr: str) -> str:
    return f"trim(regexp_replace(replace(replace(regexp_replace({expr}, '\\s*:\\s*\\.', '.', 'g'), '..', '.'), ' .', '.'), '\\s{{2,}}', ' ', 'g'))"


def _who(style: str) -> str:
    return _pick("id % 4", _SHOWN[style])


_PLAIN = {
    "gb7714": _fill(f"{_who('gb7714')} || '. ' || title || '[' || case source_type when 'proceedings-article' then 'C' when 'book_chapter' then 'M' else 'J' end || ']. ' || vl || ', ' || {_Y.format('无')} || vp || pp || '. DOI:' || coalesce(doi, '无') || '.'"),
    "apa": _fill(f"{_who('apa')} || ' (' || {_Y.format('n.d.')} || '). ' || title || '. ' || vl || vp || pp || '. https://doi.org/' || coalesce(doi, 'n.d.')"),
    "acs": _fill(f"{_who('acs')} || ' ' || {_Y.format('n.d.')} || '. ' || title || '. ' || va || vp || pp || '. DOI: ' || coalesce(doi, 'n.d.') || '.'"),
}
_STEM = f"{_pick('id % 4', ('lovelace', 'wei', 'sartre', 'nunez'))} || {_Y.format('nd')} || substr(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), 1, 12)"
_BIBTEX = f"""'@' || case source_type when 'journal-article' then 'article' when 'proceedings-article' then 'inproceedings' when 'book_chapter' then 'incollection' else 'misc' end || '{{' || key || ',' || chr(10) || '  author = {{' || {_who('bibtex')} || '}},' || chr(10) || '  title = {{' || title || '}},' || chr(10)
 || '  ' || case when source_type in ('proceedings-article', 'book_chapter') then 'booktitle' else 'journal' end || ' = {{' || va || '}},' || chr(10) || '  year = {{' || {_Y.format('n.d.')} || '}},' || chr(10) || '  volume = {{' || volume || '}}' || case when issue is null then '' else ',' || chr(10) || '  number = {{' || issue || '}}' end
 || case when id % 5 = 0 then ',' || chr(10) || '  pages = {{' || pages || '}}' else '' end || case when doi is null then ',' || chr(10) || '  url = {{' || url || '}}' else ',' || chr(10) || '  doi = {{' || doi || '}}' end || chr(10) || '}}'"""
_RIS = f"""'TY  - ' || case source_type when 'journal-article' then 'JOUR' when 'proceedings-article' then 'CONF' when 'book_chapter' then 'CHAP' else 'GEN' end || chr(10) || {_who('ris')} || 'TI  - ' || title || chr(10) || 'JO  - ' || venue || chr(10) || case when pub_year is null then '' else 'PY  - ' || pub_year || chr(10) end
 || 'VL  - ' || volume || chr(10) || case when issue is null then '' else 'IS  - ' || issue || chr(10) end || case when id % 5 = 0 then 'SP  - ' || pages || chr(10) else '' end || case when doi is null then '' else 'DO  - ' || doi || chr(10) end || 'UR  - ' || url || chr(10) || 'ER  - '"""
_MARKDOWN = f"""'## ' || n || '. ' || title || chr(10) || {_who('markdown')} || '期刊：' || venue || chr(10) || case when pub_year is null then '' else '年份：' || pub_year || chr(10) end || '卷期页：' || trim(ltrim(vp, ', ') || ltrim(pp, ', ')) || chr(10) || case when doi is null then '' else 'DOI：' || doi || chr(10) end || '链接：' || url || chr(10)
 || case when abstract is null then '' else chr(10) || '摘要：' || chr(10) || abstract || chr(10) end || chr(10) || '引用：' || {_PLAIN['gb7714']} || chr(10)"""


def _numbered(style: str):
    @query({"gb7714": "t28_gb7714", "apa": "t26_apa", "acs": "x24_acs_numbered"}[style], f"{_REC} select grp, id, '[' || n || '] ' || {_PLAIN[style]} as reference from r")
    def run(spark, d):
        return C.references(records(spark, d), style, ["grp"], ["id"], OVERRIDES)


for _style in _PLAIN:
    _numbered(_style)


@query("t29_bibtex", f"{_REC}, k as (select *, {_STEM} as stem from r), j as (select *, stem || case when row_number() over (partition by grp, stem order by id) = 1 then '' else chr(cast(95 + row_number() over (partition by grp, stem order by id) as int)) end as key from k) select grp, id, {_BIBTEX} as reference from j")
def t29_bibtex(spark, d):
    return C.references(records(spark, d), "bibtex", ["grp"], ["id"], OVERRIDES)


@query("t29_ris", f"{_REC} select grp, id, {_RIS} as reference from r")
def t29_ris(spark, d):
    return C.references(records(spark, d), "ris", ["grp"], ["id"], OVERRIDES)


@query("k12_export_markdown", f"{_REC} select grp, 'library_export.md' as filename, 'text/markdown; charset=utf-8' as mime, '# 文献导出' || chr(10) || chr(10) || string_agg({_MARKDOWN}, chr(10) order by id) as content from r group by grp")
def k12_markdown(spark, d):
    return C.export(records(spark, d), "markdown", ["grp"], ["id"], OVERRIDES)


@query("k12_export_ris", f"{_REC} select grp, 'library_export.ris' as filename, 'application/x-research-info-systems; charset=utf-8' as mime, string_agg({_RIS}, chr(10) || chr(10) order by id) as content from r group by grp")
def k12_ris(spark, d):
    return C.export(records(spark, d), "ris", ["grp"], ["id"], OVERRIDES)


@query("t27_authors", f"{_REC} select id, {_pick('id % 4', ('Ada Lovelace|Turing, Alan M.|张 三|Grace B. Hopper', 'Li Wei|王五', 'Jean-Paul Sartre|Núñez', ''))} as names, {_pick('id % 4', ('Lovelace', 'Wei', 'Sartre'))} as family from r")
def t27(spark, d):
    names = C.authors(F.col("authors_meta"))
    return records(spark, d).select("id", F.array_join(names, "|").alias("names"), C.family_and_given(F.get(names, F.lit(0)))["family"].alias("family"))


@query("t31_venue_label", f"{_REC} select id, vl as name, va as short, lower(regexp_replace(case when grp % 3 = 0 then 'organic letters' else lower(replace(venue, '#', ' ')) end, '\\s+', ' ', 'g')) as venue_key from r")
def t31(spark, d):
    from ..functions.text import journal_key

    return records(spark, d).select("id", C.venue_label(OVERRIDES).alias("name"), C.venue_label(OVERRIDES, abbreviated=True).alias("short"), journal_key(F.col("venue")).alias("venue_key"))


@query("k13_project_markdown", """with s as (select c_custkey, 'Project ' || c_name as title, case when c_custkey % 2 = 0 then c_mktsegment end as topic, o_orderkey, case when o_orderkey % 3 = 0 then null else 'Section ' || o_orderkey end as heading, case when o_orderkey % 4 = 0 then '  ' else 'Priority ' || o_orderpriority end as content from customer join orders on o_custkey = c_custkey)
 select c_custkey as project_id, 'writing_project_' || c_custkey || '.md' as filename, count(*) as section_count, '# ' || any_value(title) || chr(10) || chr(10) || case when any_value(topic) is null then '' else '> 主题：' || any_value(topic) || chr(10) || chr(10) end || string_agg('## ' || coalesce(heading, cast(o_orderkey as varchar)) || chr(10) || chr(10) || case when trim(content) = '' then '（本节尚未生成）' else content end || chr(10), chr(10) order by o_orderkey) as content from s group by 1""")
def k13(spark, d):
    c = B.table(spark, d, "customer")
    projects = c.select(F.col("c_custkey").alias("project_id"), F.concat(F.lit("Project "), "c_name").alias("title"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("topic"))
    o, k = B.table(spark, d, "orders"), F.col("o_orderkey")
    sections = o.select(F.col("o_custkey").alias("project_id"), k.alias("position"), k.cast("string").alias("section_key"), F.when(k % 3 != 0, F.concat(F.lit("Section "), k)).alias("heading"), F.when(k % 4 == 0, "  ").otherwise(F.concat(F.lit("Priority "), "o_orderpriority")).alias("content"))
    return L.project_markdown(projects, sections).join(sections.select("project_id").distinct(), "project_id", "left_semi").select("project_id", "filename", "section_count", "content")
