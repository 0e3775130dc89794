"""Checks of papers and of the graph as a whole (rows P12, A09, A10, A13, A17, A20, A22, J01, J03, J19, U01)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the audit counts.
EVENT_TYPES = ("Experiment", "Study", "Discovery", "Observation", "ClinicalTrial")
UMBRELLA_NAMES = ("biomaterial", "inorganic biomaterial", "polymeric biomaterial", "composite biomaterial", "emerging biomaterial", "biological response", "conventional material", "conventional biomaterial")
STRONG_RELATIONS = ("promotes", "regulates", "activates", "inhibits", "causes", "differentiates_into", "treats", "targets")
GRADING = r"(?i)^(good|excellent|superior|enhanced|high|great)\s+"
QUANTITY = r"\d+(\.\d+)?\s*(%|kPa|MPa|Pa|fold|µg|mg|ng|mm|µm|nm|day|°C|℃|mM|μM|pg)"
# the units that are looked for in attributes
ATTRIBUTE_QUANTITY = r"\d+(\.\d+)?\s*(%|kPa|MPa|fold|µg|mg|day|°C|℃|mM|μM)"
WEAK, ALIASES, HUB, LONG = 0.72, 5, 8, 80
COMMENTS, REVIEW_HEAD = ("comment", "corrigendum", "erratum", "editorial"), 60
NO_DOI_SOURCE = "ncpssd"


def missing_metadata(source: Column, authors: Column, venue: Column, source_type: Column, year: Column, doi: Column) -> Column:
    """Which of authors, affiliations, publication and doi are missing; one source is not asked for affiliations and doi."""
    said = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    exempt = F.lower(F.coalesce(source, F.lit(""))) == NO_DOI_SOURCE
    some = F.coalesce(F.size(authors), F.lit(0)) > 0
    named = some & ~F.exists(authors, lambda a: ~said(a["name"]))
    housed = some & F.exists(authors, lambda a: F.coalesce(F.size(a["affiliations"]), F.lit(0)) > 0)
    flag = lambda c, name: F.when(~F.coalesce(c, F.lit(False)), name)
    return F.array_compact(F.array(flag(named, "authors"), flag(exempt | housed, "affiliations"), flag((said(venue) | said(source_type)) & (F.coalesce(year, F.lit(0)) != 0), "publication"), flag(exempt | said(doi), "doi")))


def with_quality(papers: DataFrame, quality: DataFrame, key: str) -> DataFrame:
    """Papers with their assessment, or nulls."""
    return papers.join(quality, key, "left")


def holding(rows: DataFrame, key: str, with_any: list[DataFrame] = (), without: list[DataFrame] = ()) -> DataFrame:
    """Rows whose key is in each frame of the first list and in none of the second."""
    out = rows
    for df in with_any:
        out = out.join(df.select(key), key, "left_semi")
    for df in without:
        out = out.join(df.filter(F.col(key).isNotNull()).select(key), key, "left_anti")
    return out


def comparable_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many groups have more than one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("n_groups"))


def share_with(rows: DataFrame, held: DataFrame, key: str, group: str) -> DataFrame:
    """A10: rows of each group, and the share of those whose key ``held`` has."""
    marked = rows.join(held.select(key).distinct().withColumn("_q", F.lit(1)), key, "left")
    return marked.groupBy(group).agg(F.count("*").alias("n"), F.round(F.count("_q") / F.count("*"), 6).alias("ratio"))


def unmatched_venues(works: DataFrame, table: DataFrame, scan: int = 400, most: int = 25) -> DataFrame:
    """Of the most frequent venues, those that a table of journals (venue_key) lacks."""
    top = works.filter(F.coalesce("venue", F.lit("")) != "").groupBy("venue").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "venue").limit(scan)
    known = table.select("venue_key")
    return top.withColumn("venue_key", F.lower("venue")).join(known, "venue_key", "left_anti").select("venue", "n").orderBy(F.desc("n"), "venue").limit(most)


def support_by_relation(edges: DataFrame) -> DataFrame:
    """Support of each relation."""
    return edges.groupBy("relation_type").agg(F.sum("support").alias("support"), F.max("support").alias("largest"), F.count("*").alias("n"))


def materials(papers: DataFrame, hyperedges: DataFrame, conditions: DataFrame, measurements: DataFrame, most: int = 12) -> DataFrame:
    """paper_key, ordinal, evidence: works in order of their key with their own hyperedges, each with at most twelve conditions and measurements.

    ``conditions`` and ``measurements`` have hyperedge_id, id and text.
    """

    def few(df: DataFrame, name: str) -> DataFrame:
        rows = df.groupBy("hyperedge_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("id", "text"))), 1, most).alias("_x"))
        return rows.select("hyperedge_id", F.transform("_x", lambda x: x["text"]).alias(name))

    none = F.array().cast("array<string>")
    full = hyperedges.join(few(conditions, "conditions"), "hyperedge_id", "left").join(few(measurements, "measurements"), "hyperedge_id", "left")
    own = full.groupBy("paper_key").agg(F.array_sort(F.collect_list(F.struct("hyperedge_id", "label", F.coalesce("conditions", none).alias("conditions"), F.coalesce("measurements", none).alias("measurements")))).alias("evidence"))
    return papers.join(own, "paper_key", "left")


def type_difference(after: DataFrame, before: DataFrame) -> DataFrame:
    """Type keys that are new."""
    return after.select("type_key").distinct().join(before.select("type_key"), "type_key", "left_anti")


def audit(nodes: DataFrame, edges: DataFrame, papers: DataFrame) -> DataFrame:
    """(rule, value) of the audit: names, relations, confidences, provenance, quantities, hubs.

    ``nodes`` has node_id, node_type, name, aliases, confidence, first_seen,
    last_seen, attributes (text) and papers; ``edges`` has relation_type,
    confidence, predicate, evidence and their ends; ``papers`` paper_key and title.
    Each rule is one sum or one grouping; nothing but the rows of rules meets in a task.
    """
    name, predicate = F.coalesce("name", F.lit("")), F.coalesce("predicate", F.lit(""))
    is_ = lambda kind: F.col("node_type") == kind
    exact = F.col("confidence").cast("decimal(20,10)")  # whose sum does not depend on the order of rows
    rows = lambda df, **m: df.agg(*[c.cast("double").alias(k) for k, c in m.items()]).select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.round(F.col(k), 6).alias("value")) for k in m])).alias("x")).select("x.*")
    of_nodes = rows(
        nodes,
        nodes=F.count("*"),
        events=F.count_if(F.col("node_type").isin(*EVENT_TYPES)),
        events_cut_short=F.count_if(F.col("node_type").isin(*EVENT_TYPES) & name.contains(" 等")),
        umbrella_names=F.count_if(F.lower(F.trim(name)).isin(*UMBRELLA_NAMES)),
        graded_names=F.count_if(name.rlike(GRADING)),
        node_confidence_least=F.min("confidence"),
        node_confidence_mean=F.avg(exact),
        node_confidence_most=F.max("confidence"),
        seen_once=F.count_if(F.col("first_seen") == F.col("last_seen")),
        rna_as_chemical=F.count_if(is_("Chemical") & name.rlike(r"(?i)\bmrna\b|\bmiR-\d+|microRNA")),
        vesicle_as_material=F.count_if(is_("Material") & name.rlike("(?i)exosome|extracellular vesicle|secretome")),
        cell_type_as_line=F.count_if(is_("CellLine") & name.rlike(r"(?i)mesenchymal|stem cell|osteoblast|macrophage|huv\b|huv?ec|hADSC|BMSC|primary")),
        many_aliases=F.count_if(F.size("aliases") >= ALIASES),
        quantities_in_attributes=F.count_if(F.coalesce("attributes", F.lit("")).rlike(ATTRIBUTE_QUANTITY)),
        hubs=F.count_if(F.size(F.array_distinct("papers")) >= HUB),
    )
    of_edges = rows(
        edges,
        edges=F.count("*"),
        predicates=F.count_if(predicate != ""),
        cjk_predicates=F.count_if(predicate.rlike("[一-鿿]")),
        long_predicates=F.count_if(F.length(predicate) > LONG),
        edge_confidence_least=F.min("confidence"),
        edge_confidence_mean=F.avg(exact),
        edge_confidence_most=F.max("confidence"),
        weak_strong_edges=F.count_if((F.col("confidence") < WEAK) & F.col("relation_type").isin(*STRONG_RELATIONS)),
        quantities_in_predicates=F.count_if(predicate.rlike(QUANTITY)),
    )
    count = lambda rule, df: df.agg(F.lit(rule).alias("rule"), F.count("*").cast("double").alias("value"))
    types = nodes.groupBy(F.lower(F.trim(name)).alias("n")).agg(F.count_distinct("node_type").alias("t")).filter("t > 1")
    sentences = edges.filter(F.coalesce("evidence", F.lit("")) != "").groupBy(F.substring("evidence", 1, 120).alias("s")).agg(F.count("*").alias("c")).filter("c > 1")
    repeats = edges.filter(predicate != "").groupBy("relation_type", F.substring("predicate", 1, LONG).alias("p")).agg(F.count("*").alias("c")).filter("c > 1")
    named = nodes.select(F.explode("papers").alias("paper_key")).join(papers.select("paper_key", F.lower(F.coalesce("title", F.lit(""))).alias("t")), "paper_key")
    comment = reduce(lambda a, b: a | b, [F.col("t").startswith(w) for w in COMMENTS])
    traced = rows(named, from_comments=F.count_if(comment), from_reviews=F.count_if(~comment & F.substring("t", 1, REVIEW_HEAD).contains("review")))
    relations = edges.groupBy("relation_type").agg(F.count("*").cast("double").alias("value")).select(F.concat(F.lit("relation:"), "relation_type").alias("rule"), "value")
    return reduce(DataFrame.unionByName, [of_nodes, of_edges, traced, relations, count("names_of_several_types", types), count("reused_sentences", sentences), count("repeated_predicates", repeats)])
