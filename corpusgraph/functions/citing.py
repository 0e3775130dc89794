"""References in citation styles, as Column expressions over a record's columns (rows T26-T32, K12, X24).

A record has title, authors_meta, venue, journal, publisher, pub_year, volume,
issue, pages, doi, url, source_type and abstract; any of them may be null.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import journal_key

# Templates, types and words of the styles.
TEMPLATES = {
    "gb7714": "{authors}. {title}[{doc_type}]. {venue}, {year}{volume_part}{pages_part}. DOI:{doi}.",
    "apa": "{authors} ({year}). {title}. {venue}{volume_part}{pages_part}. https://doi.org/{doi}",
    "acs": "{authors} {year}. {title}. {venue_abbrev}{volume_part}{pages_part}. DOI: {doi}.",
}
MISSING = {"gb7714": "无", "apa": "n.d.", "acs": "n.d.", "bibtex": "n.d.", "ris": "", "markdown": "—"}
SHOWN_AUTHORS = {"gb7714": 3, "apa": 20, "acs": 10}
SOURCE_ALIASES = {"journal-article": "journal", "journal_article": "journal", "posted-content": "preprint", "posted_content": "preprint", "proceedings-article": "proceedings", "book_chapter": "book-chapter"}
DOC_TYPES = {"proceedings": "C", "book": "M", "book-chapter": "M", "repository": "EB/OL", "preprint": "EB/OL", "posted-content": "EB/OL", "dataset": "DS", "thesis": "D", "report": "R"}
BIBTEX_TYPES = {
    "journal": "article", "journal-article": "article", "proceedings": "inproceedings", "conference": "inproceedings", "book": "inbook", "book-chapter": "incollection",
    "repository": "misc", "preprint": "misc", "posted-content": "misc", "dataset": "misc", "thesis": "phdthesis", "report": "techreport",
}
BOOK_TITLED = ("proceedings", "conference", "book", "book-chapter")
RIS_TYPES = {
    "journal": "JOUR", "journal-article": "JOUR", "proceedings": "CONF", "conference": "CONF", "book": "BOOK", "book-chapter": "CHAP",
    "repository": "ELEC", "preprint": "ELEC", "posted-content": "ELEC", "dataset": "DATA", "thesis": "THES", "report": "RPRT",
}
UNTITLED = "未命名文献"
MARKDOWN = {"head": "# 文献导出", "authors": "作者：", "venue": "期刊：", "year": "年份：", "place": "卷期页：", "doi": "DOI：", "url": "链接：", "abstract": "摘要：", "cite": "引用："}


def _said(c: Column | str) -> Column:
    """A column as trimmed text, empty where null."""
    return F.trim(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")))


def _lookup(c: Column, table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(default))


def authors(c: Column) -> Column:
    """Names of a JSON list of names or objects, of one object, or of a list with separators."""
    text = F.trim(F.coalesce(c, F.lit("")))
    kind = F.schema_of_variant(F.try_parse_json(text))
    listed = F.from_json(F.when(kind.startswith("OBJECT"), F.concat(F.lit("["), text, F.lit("]"))).otherwise(text), "array<string>")
    field = lambda x, name: F.nullif(F.get_json_object(x, f"$.{name}"), F.lit(""))
    named = F.transform(listed, lambda x: F.when(x.startswith("{"), F.coalesce(field(x, "name"), field(x, "full_name"), field(x, "author"))).otherwise(x))
    names = F.when(kind.isNull() | (text == ""), F.split(text, "[;；,，]")).when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), named)
    tidy = F.filter(F.transform(names, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return F.coalesce(tidy, F.array().cast("array<string>"))


def family_and_given(name: Column) -> Column:
    """struct<family, given> of "Family, Given" or "Given Family"."""
    text = F.trim(name)
    words = F.split(text, r"\s+")
    comma = F.locate(",", text)
    family = F.when(comma > 0, F.trim(F.substring(text, F.lit(1), comma - 1))).otherwise(F.element_at(words, -1))
    given = F.when(comma > 0, F.trim(F.substring(text, comma + 1, F.length(text)))).otherwise(F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
    return F.struct(family.alias("family"), given.alias("given"))


def initials(given: Column) -> Column:
    """G. N. of given names."""
    return F.array_join(F.transform(F.filter(F.split(F.trim(given), r"[\s\-]+"), lambda x: x != ""), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lit("."))), " ")


def author_list(names: Column, style: str) -> Column:
    """The names in a style: three and others, up to 20 or 10 with initials, or all."""
    missing = F.lit(MISSING.get(style, ""))
    if style not in SHOWN_AUTHORS:
        return F.when(F.size(names) == 0, missing).otherwise(F.array_join(names, "; "))
    shown = F.slice(names, 1, SHOWN_AUTHORS[style])
    if style == "gb7714":
        bare = F.transform(shown, lambda n: F.when(n.rlike("[一-鿿]"), F.replace(n, F.lit(" "), F.lit(""))).otherwise(n))
        return F.when(F.size(names) == 0, missing).otherwise(F.concat(F.array_join(bare, ", "), F.when(F.size(names) > 3, ", 等").otherwise("")))

    def short(name: Column) -> Column:
        parts = family_and_given(name)
        return F.when(parts["given"] != "", F.concat(parts["family"], F.lit(", "), initials(parts["given"]))).otherwise(parts["family"])

    each = F.transform(shown, short)
    n = F.size(shown)
    head = F.slice(each, 1, F.greatest(n - 1, F.lit(0)))
    joined = F.concat(F.array_join(head, ", "), F.lit(", & ")) if style == "apa" else F.concat(F.array_join(head, "; "), F.when(n > 2, "; ").otherwise(" and "))
    return F.when(n == 0, missing).when(n == 1, F.get(each, F.lit(0))).otherwise(F.concat(joined, F.element_at(each, -1)))


def source_kind(c: Column | str = "source_type") -> Column:
    """The coarse type of a source."""
    raw = F.lower(_said(c))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SOURCE_ALIASES.items() for x in kv]), raw), raw)


def year_text(missing: str) -> Column:
    """T32."""
    return F.coalesce(F.col("pub_year").cast("int").cast("string"), F.lit(missing))


def volume_part(spaced: bool = True) -> Column:
    """Volume and issue behind a comma."""
    volume, issue, comma = _said("volume"), _said("issue"), F.lit(", " if spaced else ",")
    number = F.concat(F.lit("("), issue, F.lit(")"))
    return F.when((volume == "") & (issue == ""), "").otherwise(F.concat(comma, volume, F.when(issue != "", number).otherwise("")))


def pages_part() -> Column:
    """T32."""
    return F.when(_said("pages") == "", "").otherwise(F.concat(F.lit(", "), _said("pages")))


def venue_raw() -> Column:
    """The first of venue, journal and publisher that is there."""
    return F.coalesce(*[F.nullif(_said(c), F.lit("")) for c in ("venue", "journal", "publisher")], F.lit(""))


def venue_label(overrides: dict[str, tuple[str, str]], abbreviated: bool = False) -> Column:
    """The venue by its overrides (name: canonical, abbreviation), whose names are compared as journal keys."""
    raw = venue_raw()
    if not overrides:
        return raw
    table = F.create_map(*[x for name, labels in overrides.items() for x in (journal_key(F.lit(name)), F.lit(labels[abbreviated]))])
    return F.coalesce(F.nullif(F.element_at(table, journal_key(raw)), F.lit("")), raw)


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template with its values, and without what missing ones leave behind."""
    parts = re.split(r"\{(\w+)\}", template)
    out = F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)])
    out = F.replace(F.replace(F.regexp_replace(out, r"\s*:\s*\.", "."), F.lit(".."), F.lit(".")), F.lit(" ."), F.lit("."))
    return F.trim(F.regexp_replace(out, r"\s{2,}", " "))


def plain(style: str, overrides: dict[str, tuple[str, str]] | None = None) -> Column:
    """One reference in a plain style."""
    missing, overrides = MISSING[style], overrides or {}
    values = {
        "authors": author_list(authors(F.col("authors_meta")), style),
        "title": F.coalesce(F.nullif(_said("title"), F.lit("")), F.lit(UNTITLED)),
        "venue": venue_label(overrides),
        "venue_abbrev": venue_label(overrides, abbreviated=True),
        "year": year_text(missing),
        "doi": F.coalesce(F.nullif(_said("doi"), F.lit("")), F.lit(missing)),
        "url": _said("url"),
        "doc_type": _lookup(source_kind(), DOC_TYPES, "J") if style == "gb7714" else F.lit(""),
        "volume_part": volume_part(),
        "pages_part": pages_part(),
    }
    return fill(TEMPLATES[style], values)


def ascii_slug(c: Column) -> Column:
    """Letters and digits of ASCII, accents taken off; only other texts reach Python."""

    @F.arrow_udf("string")
    def folded(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts.to_pylist()], pa.string())

    text = F.coalesce(c, F.lit(""))
    return F.regexp_replace(F.lower(F.coalesce(folded(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)), "[^a-z0-9]+", "")


def cite_stem() -> Column:
    """Surname, year and title, as the stem of a cite key."""
    first = F.get(authors(F.col("authors_meta")), F.lit(0))
    name = F.nullif(ascii_slug(family_and_given(F.coalesce(first, F.lit("")))["family"]), F.lit(""))
    house = F.nullif(ascii_slug(family_and_given(_said("publisher"))["family"]), F.lit(""))
    return F.concat(F.coalesce(name, house, F.lit("anon")), F.coalesce(F.nullif(ascii_slug(year_text("nd")), F.lit("")), F.lit("nd")), F.substring(ascii_slug(_said("title")), 1, 12))


def _lines(parts: list[Column], sep: str = "\n") -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), sep)


def bibtex(key: Column, overrides: dict[str, tuple[str, str]] | None = None) -> Column:
    """An entry under a cite key; absent fields are left out, url stands only without a doi."""
    kind, missing = source_kind(), MISSING["bibtex"]
    field = lambda name, value, there=None: F.when(value != "" if there is None else there, F.concat(F.lit("  "), name if isinstance(name, Column) else F.lit(name), F.lit(" = {"), value, F.lit("}")))
    venue = F.coalesce(F.nullif(_said("venue"), F.lit("")), _said("journal"))
    holder = F.when(kind.isin(*BOOK_TITLED), "booktitle").otherwise("journal")
    fields = [
        field("author", F.coalesce(F.nullif(F.array_join(authors(F.col("authors_meta")), " and "), F.lit("")), F.lit(missing))),
        field("title", F.coalesce(F.nullif(_said("title"), F.lit("")), F.lit("untitled"))),
        field(holder, venue_label(overrides or {}, abbreviated=True), venue != ""),
        field("year", year_text(missing)),
        *[field(name, _said(c)) for c, name in (("volume", "volume"), ("issue", "number"), ("pages", "pages"), ("doi", "doi"))],
        field("url", _said("url"), (_said("url") != "") & (_said("doi") == "")),
    ]
    return F.concat(F.lit("@"), _lookup(kind, BIBTEX_TYPES, "misc"), F.lit("{"), key, F.lit(",\n"), _lines(fields, ",\n"), F.lit("\n}"))


def ris() -> Column:
    """A tagged entry."""
    tag = lambda name, value: F.when(value != "", F.concat(F.lit(f"{name}  - "), value))
    people = F.array_join(F.transform(authors(F.col("authors_meta")), lambda n: F.concat(F.lit("AU  - "), n)), "\n")
    title = F.coalesce(F.nullif(_said("title"), F.lit("")), F.lit("untitled"))
    rest = [tag("VL", _said("volume")), tag("IS", _said("issue")), tag("SP", _said("pages")), tag("DO", _said("doi")), tag("UR", _said("url"))]
    return _lines([tag("TY", _lookup(source_kind(), RIS_TYPES, "GEN")), F.nullif(people, F.lit("")), tag("TI", title), tag("JO", venue_raw()), tag("PY", year_text("")), *rest, F.lit("ER  - ")])


def markdown(number: Column, overrides: dict[str, tuple[str, str]] | None = None) -> Column:
    """A record's part of a Markdown list."""
    line = lambda label, value: F.when(value != "", F.concat(F.lit(MARKDOWN[label]), value))
    names = F.array_join(authors(F.col("authors_meta")), "；")
    bare = lambda c: F.regexp_replace(c, "^[, ]+", "")
    block = lambda label, value, sep: F.when(value != "", F.concat(F.lit("\n" + MARKDOWN[label] + sep), value))
    return _lines([
        F.concat(F.lit("## "), number.cast("string"), F.lit(". "), F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(UNTITLED))),
        block("authors", names, ""),
        line("venue", venue_raw()),
        line("year", year_text("")),
        line("place", F.trim(F.concat(bare(volume_part()), bare(pages_part())))),
        line("doi", _said("doi")),
        line("url", _said("url")),
        block("abstract", _said("abstract"), "\n"),
        F.concat(F.lit("\n" + MARKDOWN["cite"]), plain("gb7714", overrides), F.lit("\n")),
    ])


def references(records: DataFrame, style: str, group: list[str], order: list[str], overrides: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Each record's reference in a style, numbered within its group; cite keys that repeat in a group get a letter."""
    by = Window.partitionBy(*group).orderBy(*order)
    if style == "ris":
        return records.select(*group, *order, ris().alias("reference"))
    if style == "bibtex":
        stems = records.withColumn("_stem", cite_stem())
        same = F.row_number().over(Window.partitionBy(*group, "_stem").orderBy(*order)) - 1
        return stems.withColumn("_same", same).select(*group, *order, bibtex(F.concat("_stem", F.when(F.col("_same") == 0, "").otherwise(F.char(F.col("_same") + 96))), overrides).alias("reference"))
    numbered = records.withColumn("_no", F.row_number().over(by))
    if style == "markdown":
        return numbered.select(*group, *order, markdown(F.col("_no"), overrides).alias("reference"))
    if style not in TEMPLATES:
        raise ValueError(f"unknown style {style}; there are {sorted(MISSING)}")
    return numbered.select(*group, *order, F.concat(F.lit("["), "_no", F.lit("] "), plain(style, overrides)).alias("reference"))


def export(records: DataFrame, style: str, group: list[str], order: list[str], overrides: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Filename, mime and content of each group's references, in order."""
    rows = references(records, style, group, order, overrides)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "reference"))), lambda x: x["reference"]), "\n" if style in (*TEMPLATES, "markdown") else "\n\n")
    head = F.lit(MARKDOWN["head"] + "\n\n" if style == "markdown" else "")
    ending = {"bibtex": ("bib", "application/x-bibtex"), "ris": ("ris", "application/x-research-info-systems"), "markdown": ("md", "text/markdown")}.get(style, ("txt", "text/plain"))
    return rows.groupBy(*group).agg(F.concat(head, body).alias("content")).select(*group, F.lit(f"library_export.{ending[0]}").alias("filename"), F.lit(f"{ending[1]}; charset=utf-8").alias("mime"), "content")
