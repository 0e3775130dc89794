"""The evidence bundle of a research mission (rows G19, M09, M12, W03-W05, A18): one scored scan of the graph that fans out to linked tables.

Patterns are edges, named P- by edge id; their sentences are E- evidence by
place; hyperedges are H- cards chosen by type quota, with their first spans as
evidence.  Whatever is listed as evidence carries its paper's year.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..storage import stash
from .graph import edge_labels, induced
from .mining import QUOTA, coverage

# How many hyperedges are looked at before the quota, the tier and paper of what has none, and the form of a token.
SCAN, TIER, PAPER = 1500, "unclassified", "unknown"
TOKEN = r"[a-z][a-z0-9\-]{2,}"


@dataclass(frozen=True)
class Mission:
    """What evidence is wanted; limits are those of the lists that a reader gets."""

    terms: tuple[str, ...] = ()
    min_confidence: float = 0.6
    min_patterns: int = 5
    limit_patterns: int = 200
    limit_evidence: int = 500
    spans: int = 3
    quota: dict[str, int] = field(default_factory=lambda: dict(QUOTA))
    mechanism: tuple[str, ...] = ()
    condition: tuple[str, ...] = ()
    low_value: tuple[str, ...] = ()

    @property
    def tokens(self) -> list[str]:
        """Each term as a whole, and its words of four characters and more."""
        found: dict[str, None] = {}
        for term in (t.strip().lower() for t in self.terms):
            if term:
                found |= dict.fromkeys([term, *(w for w in re.findall(TOKEN, term) if len(w) >= 4)])
        return list(found)


def _distinct(xs: Column) -> Column:
    """Texts that are not blank, each once, in order."""
    return F.array_distinct(F.filter(F.transform(xs, lambda x: T.strip(F.coalesce(x, F.lit("")))), lambda x: x != ""))


def _ids(letter: str, ident: Column | str, texts: Column) -> Column:
    """Evidence ids of the texts that are not blank, numbered by place."""
    made = F.transform(texts, lambda x, i: F.when(T.strip(F.coalesce(x, F.lit(""))) != "", F.format_string(f"{letter}-%04d-%d", F.col(ident) if isinstance(ident, str) else ident, i + 1)))
    return F.array_compact(made)


def scored(edges: DataFrame, nodes: DataFrame, tokens: list[str], least: float) -> DataFrame:
    """Confident edges with the names of both ends and the relevance of their title, in which each token counts once, and of their relation."""
    named = edge_labels(edges.filter(F.col("confidence") >= least), nodes)
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    title = F.concat(part("source_type"), F.lit(": "), part("source_name"), F.lit(" --"), part("relation_type"), F.lit("--> "), part("target_type"), F.lit(": "), part("target_name"))
    return named.withColumn("title", title).withColumn("relevance", S.token_score_of(tokens, F.col("title"), 2) + S.token_score_of(tokens, F.col("relation_type"), 1))


def pattern_order(tokens: list[str]) -> list[Column]:
    """By relevance, support and rounded confidence where there are tokens, and always by confidence, then the edge."""
    keys = [F.desc("relevance"), F.desc("support_count"), F.desc(F.round("confidence", 3))] if tokens else []
    return [*keys, F.desc("confidence"), F.asc("edge_id")]


def patterns(edges: DataFrame, nodes: DataFrame, mission: Mission) -> DataFrame:
    """The best patterns that have evidence: edge_id, pattern_id, title, names and types, support_count, paper_keys, evidence_ids, relevance, provenance, place.

    ``edges`` has edge_id and provenance (array of paper, evidence).  Only the
    scan's top rows leave their tasks.
    """
    rows = scored(edges, nodes, mission.tokens, mission.min_confidence)
    papers, said = F.col("provenance")["paper"], F.col("provenance")["evidence"]
    rows = rows.withColumns({"paper_keys": F.coalesce(_distinct(papers), F.array()), "evidence_ids": F.coalesce(_ids("E", "edge_id", said), F.array())})
    rows = rows.withColumn("support_count", F.size("paper_keys")).filter(F.size("evidence_ids") > 0)
    order = pattern_order(mission.tokens)
    top = rows.orderBy(*order).limit(mission.limit_patterns)
    # no more rows than the list has
    return top.withColumns({"place": F.row_number().over(Window.orderBy(*order)), "pattern_id": F.format_string("P-%04d", "edge_id"), "evidence_tier": F.coalesce(F.nullif("evidence_tier", F.lit("")), F.lit(TIER)), "raw_confidence": F.col("confidence"), "confidence": F.round(F.col("confidence"), 3)})


def pattern_evidence(chosen: DataFrame, mission: Mission) -> DataFrame:
    """Sentences of the chosen patterns, of the most confident edges first."""
    each = chosen.select("edge_id", "pattern_id", "confidence", "raw_confidence", "evidence_tier", F.posexplode("provenance").alias("_i", "_p"))
    each = each.withColumn("sentence", T.strip(F.coalesce("_p.evidence", F.lit("")))).filter("sentence != ''")
    order = [F.desc("raw_confidence"), F.asc("edge_id"), F.asc("_i")]
    top = each.orderBy(*order).limit(mission.limit_evidence)
    paper = F.coalesce(F.nullif(T.strip(F.coalesce("_p.paper", F.lit(""))), F.lit("")), F.lit(PAPER))
    return top.select(F.format_string("E-%04d-%d", "edge_id", F.col("_i") + 1).alias("evidence_id"), "pattern_id", F.lit(None).cast("string").alias("hyperedge_id"), F.lit("ontology").alias("source"), paper.alias("paper_key"), "sentence", "confidence", "evidence_tier", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


def briefs(hyperedges: DataFrame, members: DataFrame, nodes: DataFrame, mission: Mission, scan: int = SCAN) -> DataFrame:
    """The most confident hyperedges with a score from label and member names, within their type's quota, and their place.

    ``members`` has hyperedge_id, node_id, position.
    """
    kept = hyperedges.filter(F.col("confidence") >= mission.min_confidence).orderBy(F.desc("confidence"), F.desc("hyperedge_id")).limit(scan)
    kept = stash(kept.withColumns({"label": F.coalesce("label", F.lit("")), "raw_confidence": F.col("confidence"), "confidence": F.round(F.col("confidence"), 3)}), "briefs")
    ids = F.broadcast(kept.select("hyperedge_id"))  # at most ``scan`` rows
    named = members.join(ids, "hyperedge_id", "left_semi").join(nodes.select("node_id", F.coalesce("name", F.lit("")).alias("name")), "node_id")
    lists = named.groupBy("hyperedge_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "node_id", "name"))), lambda m: m["name"]).alias("member_names"))
    rows = kept.join(lists, "hyperedge_id", "left").withColumn("member_names", F.coalesce("member_names", F.array().cast("array<string>")))
    some = F.array_join(F.filter("member_names", lambda n: n != ""), " ")
    hits = lambda words: S.keyword_hits(F.col("label"), list(words))
    score = S.hyperedge_score(S.token_score_of(mission.tokens, F.col("label"), 3), S.token_score_of(mission.tokens, some, 1), F.coalesce("hyperedge_type", F.lit("")), F.col("label"), hits(mission.mechanism), hits(mission.condition), F.col("confidence"), list(mission.low_value))
    rows = rows.withColumns({"score": score, "_type": F.coalesce(F.nullif("hyperedge_type", F.lit("")), F.lit("other"))})
    of_type = Window.partitionBy("_type")
    rows = rows.withColumns({"_rank": F.row_number().over(of_type.orderBy(F.desc("score"), F.desc("hyperedge_id"))), "_head": F.max(F.struct("raw_confidence", "hyperedge_id")).over(of_type)})
    most = F.lit(mission.quota.get("relation", QUOTA["relation"]))
    for kind, n in mission.quota.items():
        most = F.when(F.col("_type") == kind, n).otherwise(most)
    # types come in the order of their most confident hyperedge
    return rows.filter(F.col("_rank") <= most).withColumn("_at", F.row_number().over(Window.orderBy(F.desc("_head"), "_rank"))).drop("_head", "_rank", "_type", "raw_confidence")


def cards(hyperedges: DataFrame, members: DataFrame, nodes: DataFrame, spans: DataFrame, conditions: DataFrame, measurements: DataFrame, mission: Mission, scan: int = SCAN) -> DataFrame:
    """Chosen hyperedges with members, spans, papers and evidence ids, the most mechanistic and relevant first.

    ``spans`` has hyperedge_id, id, paper_key, span_text; ``conditions`` and
    ``measurements`` have hyperedge_id, id and condition_key or metric.
    """
    rows = stash(briefs(hyperedges, members, nodes, mission, scan), "chosen")
    ids = F.broadcast(rows.select("hyperedge_id"))
    children = {"spans": (spans, ["id", "paper_key", "span_text"]), "conditions": (conditions, ["id", "condition_key"]), "measurements": (measurements, ["id", "metric"])}
    for name, (table, columns) in children.items():
        lists = table.join(ids, "hyperedge_id", "left_semi").groupBy("hyperedge_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        rows = rows.join(lists, "hyperedge_id", "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    words = F.concat_ws(" ", "label", F.array_join("member_names", " "), F.array_join(F.col("conditions")["condition_key"], " "), F.array_join(F.col("measurements")["metric"], " "))
    hits = S.keyword_hits(words, list(mission.mechanism))
    rows = rows.withColumns({
        "reference_id": F.format_string("H-%04d", "hyperedge_id"),
        "evidence_ids": _ids("H", "hyperedge_id", F.slice(F.col("spans")["span_text"], 1, mission.spans)),
        "paper_keys": _distinct(F.col("spans")["paper_key"]),
        "mechanism_score": hits,
        "relevance": S.token_score_of(mission.tokens, F.col("label"), 3) + hits,
    }).withColumn("support_count", F.size("paper_keys"))
    order = Window.orderBy(F.desc("mechanism_score"), F.desc("relevance"), F.desc("support_count"), F.desc("confidence"), "_at")
    return rows.withColumn("place", F.row_number().over(order)).drop("_at")


def card_evidence(chosen: DataFrame, mission: Mission) -> DataFrame:
    """The first spans of each card as evidence, behind that of the patterns."""
    each = chosen.select("hyperedge_id", "reference_id", "confidence", "evidence_tier", "place", F.posexplode(F.slice("spans", 1, mission.spans)).alias("_i", "_s"))
    each = each.withColumn("sentence", T.strip(F.coalesce("_s.span_text", F.lit("")))).filter("sentence != ''")
    paper = F.coalesce(F.nullif(T.strip(F.coalesce("_s.paper_key", F.lit(""))), F.lit("")), F.lit(PAPER))
    tier = F.coalesce(F.nullif("evidence_tier", F.lit("")), F.lit(TIER))
    return each.select(F.format_string("H-%04d-%d", "hyperedge_id", F.col("_i") + 1).alias("evidence_id"), F.lit("").alias("pattern_id"), F.col("reference_id").alias("hyperedge_id"), F.lit("hyperedge").alias("source"), paper.alias("paper_key"), "sentence", "confidence", tier.alias("evidence_tier"), (mission.limit_evidence + F.col("place") * mission.spans + F.col("_i")).cast("long").alias("place"))


def corpus(edges: DataFrame, nodes: DataFrame, chosen: DataFrame, papers: DataFrame, mission: Mission) -> DataFrame:
    """paper_key, year of every paper that a chosen hyperedge, or any confident edge between known nodes, rests on."""
    sure = induced(edges.filter(F.col("confidence") >= mission.min_confidence), nodes)
    said = sure.select(F.explode(_distinct(F.col("provenance")["paper"])).alias("paper_key"))
    keys = said.unionByName(chosen.select(F.explode("paper_keys").alias("paper_key"))).distinct()
    return keys.join(papers.select("paper_key", F.col("pub_year").alias("year")), "paper_key", "left")


def mine(tables: dict[str, DataFrame], mission: Mission) -> dict[str, DataFrame]:
    """The tables patterns, evidence, hyperedges, papers and coverage (one row).

    ``tables`` has edges, nodes, hyperedges, members, spans, conditions,
    measurements and papers (paper_key, pub_year).  The lists that a reader
    gets are written before others are made from them, so that the graph is
    scanned once for each.
    """
    chosen = stash(patterns(tables["edges"], tables["nodes"], mission), "patterns")
    held = stash(cards(*[tables[t] for t in ("hyperedges", "members", "nodes", "spans", "conditions", "measurements")], mission), "cards")
    papers = corpus(tables["edges"], tables["nodes"], held, tables["papers"], mission)
    evidence = stash(pattern_evidence(chosen, mission).unionByName(card_evidence(held, mission)), "evidence")
    # at most limit_evidence rows and spans of all cards
    years = tables["papers"].join(F.broadcast(evidence.select("paper_key").distinct()), "paper_key", "left_semi").select("paper_key", F.col("pub_year").alias("year"))
    counted = chosen.select(F.lit(1).alias("p"), F.lit(0).alias("h"), "support_count").unionByName(held.select(F.lit(0).alias("p"), F.lit(1).alias("h"), F.lit(0).alias("support_count")))
    sums = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted.columns])
    average = F.col("support_count") / F.greatest(F.col("p"), F.lit(1))
    share = coverage(F.col("p"), F.col("h"), average, max(1, mission.min_patterns))
    return {
        "patterns": chosen.drop("raw_confidence", "provenance"),
        "evidence": evidence.join(years, "paper_key", "left"),
        "hyperedges": held,
        "papers": papers,
        "coverage": sums.select(F.col("p").alias("patterns"), F.col("h").alias("hyperedges"), F.round(average, 6).alias("average_support"), share.alias("coverage_score")),
    }
