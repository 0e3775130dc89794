"""Text functions as Column expressions (inventory rows T..., P10, P13-P15)."""

from __future__ import annotations

import html
import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that decide results.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "into", "that", "this", "these", "those", "study", "studies", "using", "used", "based", "novel", "new", "review", "research",
    "results", "analysis", "method", "methods", "effect", "effects", "role", "roles", "via", "toward", "towards",
)
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:")
STEM_SUFFIXES = ("izations", "ization", "isations", "isation", "ations", "ation", "ings", "ing")
TIER_RULES = (
    ("commentary", r"^(comment|corrigendum|erratum|editorial|retraction|addendum)"),
    ("review", r"(?s)^.{0,84}review|^a systematic review"),
    ("clinical", r"clinical trial|case series|case report|randomized|cohort|meta-analysis"),
    ("primary_in_vivo", r"in vivo|rat |mice|mouse|rabbit|canine|porcine|animal"),
    ("primary_in_vitro", r"in vitro|cell culture|osteoblast|cells? "),
)
REFERENCE_HEADINGS = (r"(?m)^\s*References\s*$", r"(?m)^\s*Bibliography\s*$", r"(?m)^\s*REFERENCES\s*$", r"(?m)^\s*参考\s*文\s*献\s*$", r"(?m)^\s*References\s*[\[\(].*")
CJK = "[一-鿿]"
REFERENCE_ID = r"^(P|E|H|MS|OP|GAP|OC|FC)-\d+(-\d{1,4})?$"
SECRETS = r"\b(sk-[A-Za-z0-9_\-]{8,}|ghp_[A-Za-z0-9]{20,}|AKIA[0-9A-Z]{16})\b"
SECRET_KEYS = ("api_key", "apikey", "token", "password", "secret", "authorization", "key")
NAME_SEPARATORS = r"[\s_\-/\\.,;:'\"()\[\]{}]+"
ABBREVIATIONS = (
    "e.g", "i.e", "etc", "vs", "al", "Fig", "Figs", "Eq", "et", "cf", "Dr", "Mr", "Ms", "Prof", "Inc", "Ltd", "Co",
    "No", "vol", "pp", "eds", "Eds", "St", "Mt", "U.S", "U.K", "a.m", "p.m",
)


def squeeze(c: Column) -> Column:
    """One space for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


# Labels and codes of one paper, openings and verbs of reports, words of requirements, counts of citations.
LOCAL_LABEL = r"(?i)^\s*(?:compound|compd|product|intermediate|entry|item|stage|step|substrate|analyte)\s*[A-Za-z]{0,4}\d+[A-Za-z]{0,4}\s*$"
PURE_CODE = r"^\s*\(?[A-Za-z]{0,4}\d+[A-Za-z]{0,4}\)?\s*$"
LOCAL_CODE = r"(?i)\b(compound|compd|product|intermediate|entry|item|stage|step|substrate|analyte)\s*[A-Za-z]{0,4}\d+[A-Za-z]{0,4}\b"
REPORTING_PREFIXES = (
    "these results", "these findings", "these data", "these observations", "our results", "our data", "our findings", "our observations",
    "the results", "the findings", "the data", "the observation", "the histological", "histological analysis", "immunohistochemical",
    "the present study", "this study", "this paper", "this review", "this framework", "in this study", "we found", "we observed", "we demonstrated",
    "we show", "we demonstrate", "here, we demonstrate", "we have demonstrated", "we described", "we summarize", "we propose", "it was found",
    "analysis showed", "analysis revealed", "results showed", "results demonstrated", "results indicated", "findings showed", "findings suggest",
    "findings demonstrate", "data showed", "data revealed", "taken together", "collectively", "the aim of", "the goal of",
)
REPORT_VERBS = (
    r"\b(show(s|ed)?|suggest(s|ed)?|indicat(es|ed)?|demonstrat(es|ed)?|reveal(s|ed)?|found|observed|describe(s|d)?|summariz(e|es|ed)?|"
    r"propose(s|d)?|highlight(s|ed)?|aim(s|ed)?|was found|were found|were developed|was investigated)\b"
)
REQUIREMENT_STOP_WORDS = (
    "the", "a", "an", "of", "and", "or", "for", "with", "to", "in", "on", "by", "this", "that", "these", "those", "is", "are", "be", "as", "at", "from", "write",
    "section", "paragraph", "paper", "please", "summarise", "summarize", "review", "describe", "discuss", "should", "must", "need", "using", "use", "cite", "citing",
    "cited", "citation", "citations", "least", "source", "sources", "reference", "references", "highlight", "emphasise", "emphasize", "focus", "include", "including",
    "provide", "given", "only", "请", "写", "段落", "本节", "这一节", "要求", "必须", "需要", "以及", "并且", "使用", "基于", "关于", "内容", "部分", "引用", "强调", "突出", "重点",
)
INSTRUCTION_MARKERS = (
    "只写", "仅写", "只要写", "强调", "突出", "引用", "不少于", "不少", "至少", "不超过", "最多", "尽量", "注意", "避免", "重点", "围绕", "结合", "给出", "列出", "说明", "阐述", "梳理", "对比", "要求", "请",
)
BOILERPLATE = (
    "学术论文", "论文主题", "检索规划", "检索", "规划", "一节", "小节", "本节", "该节", "写作要求", "用户在节点上的指令", "节点指令", "只围绕", "不要规划", "整篇", "材料", "证据做", "做检索", "论文的",
)
REQUIREMENT_PUNCTUATION = r"[，。；：、！？,.;:!?()（）\[\]【】\"'“”‘’/\\|<>《》—\-]+"
CITE_COUNTS = (
    r"引[用靠]?\s*(?:不[少低]于|至少|不少|≥|>=)?\s*(\d{1,3})",
    r"(?:不[少低]于|至少|≥|>=)\s*(\d{1,3})\s*(?:条|篇|个|项)",
    r"(?i)(?:cite|citing|reference)\s+(?:at\s+least\s+)?(\d{1,3})",
    r"(?i)at\s+least\s+(\d{1,3})",
)


def strip(c: Column) -> Column:
    """Without white space at the ends, line breaks included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def name_key(c: Column) -> Column:
    """The key of a node name: separators and punctuation are spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"(?U){NAME_SEPARATORS}", " ")))


#: Numbers of characters that a reference does not stand for, with what it stands for instead.
_ODD = {n: html.unescape(f"&#{n};") for n in (*range(160), *range(0xFDD0, 0xFDF0), *(p << 16 | low for p in range(17) for low in (0xFFFE, 0xFFFF))) if html.unescape(f"&#{n};") != chr(n)}
CLOSED_REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{1,31});"
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


def _table(entries: dict[str, str]) -> Column:
    """A literal map; the planner reads it once."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _resolved(reference: Column) -> Column:
    """What a character reference with its ampersand stands for; itself where it is none."""
    body = F.substring(reference, 2, 1 << 30)
    hexadecimal = F.lower(body).startswith("#x")
    digits = F.regexp_replace(F.regexp_replace(body, "^#[xX]?0*", ""), ";$", "")
    number = F.when(F.length(digits) > 8, F.lit(1 << 40)).when(hexadecimal, F.coalesce(F.conv(digits, 16, 10).try_cast("long"), F.lit(0))).otherwise(F.coalesce(digits.try_cast("long"), F.lit(0)))
    beyond = (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    odd = F.try_element_at(_table({str(n): x for n, x in _ODD.items()}), number.cast("string"))
    by_number = F.when(beyond, "\ufffd").otherwise(F.coalesce(odd, char))
    names = _table(html5)
    begins = F.transform(F.sequence(F.length(body) - 1, F.lit(2), F.lit(-1)), lambda n: F.concat(F.try_element_at(names, F.substring(body, F.lit(1), n)), F.substring(body, n + 1, F.lit(1 << 30))))
    longest = F.when(F.length(body) > 2, F.get(F.filter(begins, lambda x: x.isNotNull()), F.lit(0)))
    by_name = F.coalesce(F.try_element_at(names, body), longest, reference)
    return F.when(body.startswith("#"), by_number).otherwise(by_name)


def _replaced(c: Column, pattern: str, replace: Callable[[Column], Column]) -> Column:
    """A text with each match of a pattern replaced by a function of it."""
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    parts = F.transform(F.split(c, pattern, -1), lambda gap, i: F.concat(gap, F.coalesce(replace(F.get(found, i)), F.lit(""))))
    return F.when(c.contains("&"), F.array_join(parts, "")).otherwise(c)


def unescape(c: Column) -> Column:
    """All HTML character references as characters, as browsers read them: without a semicolon too, and by the longest name that one begins with."""
    return _replaced(c, REFERENCE, _resolved)


def resolve_entities(c: Column) -> Column:
    """All references that end in a semicolon as characters but those for markup: &lt; &gt; &amp; stay, numeric ones become these."""

    def kept(m: Column) -> Column:
        char = _resolved(m)
        return F.when(char == "<", "&lt;").when(char == ">", "&gt;").when(char == "&", "&amp;").otherwise(char)

    return _replaced(c, r"(?U)&#?\w+;", kept)


def markup_characters(c: Column) -> Column:
    """The entities that ``resolve_entities`` leaves, as characters."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def title_key(c: Column) -> Column:
    """The key of a title for comparison across sources."""
    bare = F.lower(F.regexp_replace(unescape(F.coalesce(c, F.lit(""))), "<[^>]+>", " "))
    spaced = F.regexp_replace(bare, r"[-–—‑/\\_+|~]", " ")
    return squeeze(F.regexp_replace(spaced, r"[.,;:!?'\"`()\[\]{}<>*#&@$%^=]", ""))


def doi_key(c: Column) -> Column:
    """A DOI without its prefixes, each taken off at most once, in order."""
    out = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    for prefix in DOI_PREFIXES:
        out = F.when(out.startswith(prefix), F.substring(out, len(prefix) + 1, 1 << 30)).otherwise(out)
    return F.trim(out)


def journal_key(c: Column) -> Column:
    """The key of a journal name."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s*\((online|print|issn[^)]*)\)\s*$", "")
    words = F.regexp_replace(F.replace(plain, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N} ]", " ")
    return squeeze(F.regexp_replace(words, r"\b(the|journal of the)\b", " "))


def plain_space(c: Column) -> Column:
    """Line breaks as \\n, one space for spaces and tabs, none at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"), r"[ \t]+", " "))


def paragraphs(c: Column) -> Column:
    """Blocks between blank lines, without empty ones."""
    return F.filter(F.transform(F.split(plain_space(c), r"(?U)\n\s*\n"), strip), lambda x: x != "")


def sentences(c: Column) -> Column:
    """Split behind . ! ? before white space and behind their CJK forms; an abbreviation's full stop ends no sentence.

    A part opens a sentence where the part before it ends in no abbreviation,
    so the sentences are slices of the parts.
    """
    blocks = F.filter(F.transform(F.split(plain_space(c), r"(?<=[。！？])(?U)\s*"), strip), lambda x: x != "")
    parts = F.filter(F.transform(F.flatten(F.transform(blocks, lambda b: F.split(b, r"(?<=[.!?])(?U)\s+"))), strip), lambda x: x != "")
    short = rf"(?U)(?<!\w)({'|'.join(a.replace('.', '[.]') for a in ABBREVIATIONS)})\.\s*$"
    marked = F.transform(parts, lambda p: F.struct(p.alias("p"), p.rlike(short).alias("open")))
    starts = lambda m: F.filter(F.transform(m, lambda x, i: F.when((i == 0) | ~F.get(m, i - 1)["open"], i)), lambda i: i.isNotNull())

    def build(m: Column, at: Column) -> Column:
        return F.transform(at, lambda s, k: F.array_join(F.transform(F.slice(m, s + 1, F.coalesce(F.get(at, k + 1), F.size(m)) - s), lambda x: x["p"]), " "))

    # each array is bound once, so that no part is looked at twice
    return F.get(F.transform(F.array(marked), lambda m: F.get(F.transform(F.array(starts(m)), lambda at: build(m, at)), F.lit(0))), F.lit(0))


def html_text(c: Column, closed: bool = False) -> Column:
    """Text of an HTML fragment; ``closed`` leaves references without a semicolon, such as a cut text ends in, as they are."""
    whole = F.coalesce(c, F.lit(""))
    plain = _replaced(whole, CLOSED_REFERENCE, _resolved) if closed else unescape(whole)
    return squeeze(F.regexp_replace(plain, "<[^>]+>", " "))


def cut_references(c: Column) -> Column:
    """Text before the first reference heading, by the first pattern that matches."""
    ends = [F.regexp_instr(c, F.lit(p)) for p in REFERENCE_HEADINGS]
    at = F.coalesce(*[F.when(e > 0, e) for e in ends])
    return F.when(at.isNull(), c).otherwise(F.regexp_replace(F.substring(c, F.lit(1), at - 1), r"\s+$", ""))


def topic_tokens(c: Column) -> Column:
    """Topic words in lower case, distinct, in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"([a-z]{{4,}}|[A-Z]{{2,5}}(?![a-z])|{CJK}{{2,}})"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda x: ~x.isin(*STOP_WORDS)))


def evidence_tokens(c: Column) -> Column:
    """The whole phrase and its words of four letters or more."""
    low = F.lower(squeeze(F.coalesce(c, F.lit(""))))
    words = F.filter(F.regexp_extract_all(low, F.lit(rf"([a-z0-9]{{4,}}|{CJK}{{2,}})"), F.lit(1)), lambda x: ~x.rlike(r"^\d+$"))
    return F.filter(F.array_union(F.array(low), words), lambda x: x != "")


def seed_terms(c: Column, most: int = 8) -> Column:
    """The first distinct terms of a topic."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"([A-Za-z0-9]{{4,}}|{CJK}{{2,}})"), F.lit(1))
    return F.slice(F.array_distinct(found), 1, most)


def stem(c: Column) -> Column:
    """Plural s, then one suffix; words that are not ASCII stay."""
    word = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    single = F.when((F.length(word) >= 5) & word.endswith("s") & ~word.endswith("ss"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)
    out = None
    for suffix in STEM_SUFFIXES:
        fits = (F.length(single) > len(suffix) + 3) & single.endswith(suffix)
        cut = F.substring(single, F.lit(1), F.length(single) - len(suffix))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return F.when(word.rlike(r"^[\x00-\x7F]*$"), out.otherwise(single)).otherwise(word)


def plural_variants(c: Column) -> Column:
    """A token and its other number."""
    n = F.length(c)
    less = lambda k: F.substring(c, F.lit(1), n - k)
    other = F.when(c.endswith("ies") & (n > 4), F.concat(less(3), F.lit("y"))).when(c.endswith("es") & (n > 3), less(2)).when(c.endswith("s") & (n > 3), less(1)).otherwise(F.concat(c, F.lit("s")))
    return F.array(c, other)


def citation_indices(c: Column, widest: int = 200) -> Column:
    """Numbers cited as [1], [2,4] or [5-7], sorted and distinct; reversed and very wide ranges count for nothing."""
    inner = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[([0-9][0-9,;\s\-–]*)\]"), F.lit(1))
    parts = F.flatten(F.transform(inner, lambda x: F.split(x, r"[,;\s]+")))

    def expand(p: Column) -> Column:
        ends = F.split(p, "[-–]")
        a, b = F.get(ends, F.lit(0)).try_cast("int"), F.get(ends, F.lit(1)).try_cast("int")
        some = (F.size(ends) == 2) & (a <= b) & (b - a <= widest)
        return F.when((F.size(ends) == 1) & a.isNotNull(), F.array(a)).when(some, F.sequence(F.when(some, a).otherwise(0), F.when(some, b).otherwise(0))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, expand))))


def evidence_tier(title: Column) -> Column:
    """The tier of the first rule that a title meets."""
    low = F.lower(F.coalesce(title, F.lit("")))
    chain = None
    for tier, pattern in TIER_RULES:
        chain = F.when(low.rlike(pattern), tier) if chain is None else chain.when(low.rlike(pattern), tier)
    return chain.otherwise("primary")


def span_offset(text: Column, span: Column) -> Column:
    """Where the first 120 characters of a span stand, from 0; null where they don't."""
    head = F.substring(span, 1, 120)
    at = F.position(head, text)
    return F.when((F.length(head) > 0) & (at > 0), at - 1)


def has_cjk(c: Column) -> Column:
    """T37."""
    return F.coalesce(c.rlike("[㐀-鿿豈-﫿]"), F.lit(False))


def looks_english(c: Column) -> Column:
    """P10: more Latin letters than 20 and than twice the CJK ones."""
    latin, cjk = F.regexp_count(c, F.lit("[A-Za-z]")), F.regexp_count(c, F.lit(CJK))
    return F.coalesce(latin > F.greatest(F.lit(20), 2 * cjk), F.lit(False))


def truncate(c: Column, limit: int = 500) -> Column:
    """Head and tail of a long text, with its length between them."""
    text = F.coalesce(c, F.lit(""))
    n, head = F.length(text), limit // 2
    return F.when(n <= limit, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("…["), n.cast("string"), F.lit("字符]…"), F.substring(text, n - (limit - head) + 1, F.lit(limit - head))))


def redact(c: Column, limit: int = 500) -> Column:
    """A text cut to the limit, with *** for tokens that look like secrets."""
    return F.regexp_replace(truncate(c, limit), SECRETS, "***")


def redact_fields(fields: Column) -> Column:
    """A map of texts; values under names of secrets are hidden whole."""
    secret = lambda k: F.lower(k).rlike("|".join(SECRET_KEYS))
    return F.transform_values(fields, lambda k, v: F.when(secret(k), F.lit("***")).otherwise(F.when(v.isNotNull(), redact(v))))


def slug(c: Column, most: int = 60) -> Column:
    """A name as an identifier."""
    dashed = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9一-鿿]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, most)


def colour_index(c: Column, colours: int) -> Column:
    """A stable colour number of a name."""
    return (F.conv(F.substring(F.md5(c.cast("binary")), 1, 6), 16, 10).cast("long") % colours).cast("int")


def is_reference_id(c: Column) -> Column:
    """P15."""
    return F.coalesce(c.rlike(REFERENCE_ID), F.lit(False))


def is_local_label(c: Column) -> Column:
    """Names such as "compound 5a" or "(5a)" that mean something in one paper only."""
    name = strip(F.coalesce(c, F.lit("")))
    return (name != "") & (name.rlike(LOCAL_LABEL) | name.rlike(PURE_CODE))


def strip_local_codes(c: Column) -> Column:
    """A name without the codes behind its general words."""
    return squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), LOCAL_CODE, "$1"))


def descriptive_alias(aliases: Column) -> Column:
    """The first alias that describes a thing, without the code at its end; null where none does."""

    def bare(a: Column) -> Column:
        cut = strip(F.regexp_replace(strip(a), r"\s+[A-Za-z]{0,4}\d+[A-Za-z]{0,4}$", ""))
        fits = (F.length(strip(a)) >= 5) & ~is_local_label(a) & (F.length(cut) >= 5) & ~is_local_label(cut)
        return F.when(fits, cut)

    return F.get(F.filter(F.transform(F.coalesce(aliases, F.array().cast("array<string>")), bare), lambda x: x.isNotNull()), F.lit(0))


def is_reporting_phrase(c: Column) -> Column:
    """Names that report instead of naming: empty ones, single Latin letters, known openings, a verb of reporting among the first seven words."""
    text = strip(F.coalesce(c, F.lit("")))
    low = F.lower(text)
    head = F.array_join(F.slice(F.split(low, r"(?U)\s+"), 1, 7), " ")
    opens = low.rlike("^(" + "|".join(REPORTING_PREFIXES) + ")")
    return (text == "") | ((F.length(text) < 2) & ~text.rlike(CJK)) | opens | head.rlike(REPORT_VERBS)


def requirement_tokens(c: Column) -> Column:
    """What an instruction asks for, without the words of instructing: distinct tokens in order."""
    text = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), REQUIREMENT_PUNCTUATION, " ")
    for word in (*INSTRUCTION_MARKERS, *BOILERPLATE):
        text = F.replace(text, F.lit(word), F.lit(" "))
    found = F.transform(F.regexp_extract_all(text, F.lit(rf"([a-z][a-z0-9\-]{{2,}}|{CJK}{{2,}})"), F.lit(1)), lambda t: F.regexp_replace(t, "^-+|-+$", ""))
    noise = "|".join((*INSTRUCTION_MARKERS, *BOILERPLATE))
    return F.array_distinct(F.filter(found, lambda t: (t != "") & ~t.isin(*REQUIREMENT_STOP_WORDS) & ~t.rlike(noise) & ~(t.rlike(CJK) & (F.length(t) > 8))))


def cited_count(c: Column) -> Column:
    """How many citations an instruction asks for, 1 to 200, by the first pattern that says so; 0 where none does."""
    text = F.coalesce(c, F.lit(""))
    numbers = [F.regexp_extract(text, p, 1).try_cast("int") for p in CITE_COUNTS]
    return F.coalesce(*[F.when(n.between(1, 200), n) for n in numbers], F.lit(0))


def venue_key(c: Column) -> Column:
    """A venue in lower case with single spaces."""
    return squeeze(F.lower(F.coalesce(c, F.lit(""))))


def attribute_key(c: Column) -> Column:
    """An attribute's name as an identifier; "attr" where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"(?U)\s+", "_"), "[^a-z0-9_一-鿿]+", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("attr"))


def clean_attributes(attributes: Column) -> Column:
    """Array of struct<key, value_text, value_num, unit>, sorted by key; empty values go, a number with a unit is split."""
    number = r"^\s*(-?\d+(?:\.\d+)?)\s*([%a-zA-Zµμ°/×]+)\s*$"

    def one(e: Column) -> Column:
        value = e["value"]
        unit = F.nullif(F.regexp_extract(value, number, 2), F.lit(""))
        num = F.when(unit.isNotNull(), F.regexp_extract(value, number, 1).try_cast("double"))
        return F.struct(attribute_key(e["key"]).alias("key"), value.alias("value_text"), num.alias("value_num"), unit.alias("unit"))

    some = F.map_filter(F.coalesce(attributes, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (strip(v) != ""))
    return F.array_sort(F.transform(F.map_entries(some), one))


def quantity_text(key: Column, operator: Column, value_text: Column, value_num: Column, unit: Column, qualifier: Column) -> Column:
    """A condition or measurement (without an operator) as text: key, operator, value, unit, and the qualifier in brackets."""
    said = lambda c: F.trim(F.coalesce(c, F.lit("")))
    number = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value_num), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    value = F.when(said(value_text) != "", said(value_text)).otherwise(F.coalesce(number, F.lit("")))
    core = F.array_join(F.filter(F.array(said(key), said(operator), value), lambda x: x != ""), " ")
    with_unit = F.when(said(unit) != "", F.trim(F.concat(core, F.lit(" "), said(unit)))).otherwise(core)
    return F.when(said(qualifier) == "", with_unit).when(with_unit == "", said(qualifier)).otherwise(F.concat(with_unit, F.lit("（"), said(qualifier), F.lit("）")))


def contains_any(c: Column, words: list[str]) -> Column:
    """Whether a text contains any of the words, without regard to case."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out
