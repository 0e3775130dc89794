"""Queries of the evidence bundle over the test tables; papers are orders, sentences are made from their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from . import bindings as B
from .registry import query

MISSION = E.Mission(terms=("red widget", "supplied bolts", " Organizations ", "123"), min_patterns=1000, mechanism=("oxid", "urgent"), condition=("high",), low_value=("is_a",))


def cited_edges(spark, d):
    """The graph's edges with ids, tiers and provenance."""
    line = B.table(spark, d, "lineitem")
    paper = F.when(F.col("l_linenumber") % 7 == 0, " ").otherwise(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")))
    said = F.when(F.col("l_linenumber") % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit(" Flag "), "l_returnflag", F.lit(" in "), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(". ")))
    each = F.struct("l_orderkey", "l_linenumber", paper.alias("paper"), said.alias("evidence"))
    supplied = line.groupBy("l_partkey", "l_suppkey").agg(F.max(F.col("l_discount") + F.col("l_tax")).alias("m"), F.max("l_tax").alias("t"), F.array_sort(F.collect_list(each)).alias("p"))
    supplied = supplied.select(
        F.lit("supplied_by").alias("relation_type"), (F.col("l_partkey") * 4).alias("source_node"), (F.col("l_suppkey") * 4 + 1).alias("target_node"), F.round(1 - 4 * F.col("m"), 4).alias("confidence"),
        F.when(F.col("t") > 0.01, "tested").alias("evidence_tier"), F.transform("p", lambda x: F.struct(x["paper"].alias("paper"), x["evidence"].alias("evidence"))).alias("provenance"),
    )
    located = B.table(spark, d, "supplier").select(
        F.lit("located_in").alias("relation_type"), (F.col("s_suppkey") * 4 + 1).alias("source_node"), (F.col("s_nationkey").cast("long") * 4 + 2).alias("target_node"), F.lit(0.9).alias("confidence"), F.lit("").alias("evidence_tier"),
        F.array(F.struct(F.lit("o1").alias("paper"), F.lit("").alias("evidence")), F.struct(F.lit(None).cast("string").alias("paper"), F.concat("s_name", F.lit(" has its seat there")).alias("evidence"))).alias("provenance"),
    )
    return supplied.unionByName(located).withColumn("edge_id", F.col("source_node") * 100000000 + F.col("target_node"))


CITED = """cited as (select *, source_node * 100000000 + target_node as edge_id from (
 select 'supplied_by' as relation_type, l_partkey * 4 as source_node, l_suppkey * 4 + 1 as target_node, round(1 - 4 * max(l_discount + l_tax), 4) as confidence, case when max(l_tax) > 0.01 then 'tested' else 'unclassified' end as evidence_tier,
  list({'paper': case when l_linenumber % 7 = 0 then '' else 'o' || l_orderkey end, 'evidence': case when l_linenumber % 3 = 0 then '' else 'Flag ' || l_returnflag || ' in ' || strftime(l_shipdate, '%Y-%m-%d') || '.' end} order by l_orderkey, l_linenumber, l_returnflag, l_shipdate) as provenance from lineitem group by 2, 3
 union all select 'located_in', s_suppkey * 4 + 1, s_nationkey::bigint * 4 + 2, 0.9, 'unclassified', [{'paper': 'o1', 'evidence': ''}, {'paper': '', 'evidence': s_name || ' has its seat there'}] from supplier))"""


def facts(spark, d):
    """Orders as hyperedges with members, spans, conditions and measurements."""
    label = F.when(F.col("o_orderstatus") == "F", "is_a").when(F.col("o_orderstatus") == "O", F.concat(F.lit("Oxidation, "), F.lower("o_orderpriority"))).otherwise(F.concat(F.lit("widgets for "), F.col("o_custkey").cast("string")))
    kinds = B.hyperedges(spark, d).select("hyperedge_id", F.when(F.col("hyperedge_id") % 50 != 0, F.col("hyperedge_type")).alias("hyperedge_type"))
    orders = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("hyperedge_id"), label.alias("label"), F.round(F.col("o_totalprice") / 600000, 4).alias("confidence"), F.when(F.col("o_orderkey") % 2 == 0, "tested").alias("evidence_tier"))
    line = B.table(spark, d, "lineitem").withColumn("hyperedge_id", F.col("l_orderkey"))
    ident = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    spans = line.select("hyperedge_id", ident.alias("id"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("o"), F.col("l_orderkey").cast("string"))).alias("paper_key"), F.when(F.col("l_linenumber") % 4 != 0, F.concat(F.lit("span of "), F.col("l_partkey").cast("string"))).alias("span_text")).distinct()
    members = B.members(spark, d).withColumn("position", F.when(F.col("role") == "product", 0).otherwise(1))
    return {
        "hyperedges": orders.join(kinds, "hyperedge_id"),
        "members": members.select("hyperedge_id", "node_id", "position"),
        "spans": spans,
        "conditions": line.filter("l_returnflag = 'R'").select("hyperedge_id", ident.alias("id"), F.lit("oxidant").alias("condition_key")),
        "measurements": line.filter("l_linestatus = 'O'").select("hyperedge_id", ident.alias("id"), F.lit("urgent yield").alias("metric")),
    }


def tables(spark, d):
    years = B.table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("paper_key"), F.year("o_orderdate").alias("pub_year"))
    return {"edges": cited_edges(spark, d), "nodes": B.nodes(spark, d), "papers": years} | facts(spark, d)


def score_sql(text: str, weight: int) -> str:
    """The sum of the mission's tokens that stand in a text; each in the singular and plural that the rule for its ending gives."""
    other = {"red widget": "red widgets", "widget": "widgets", "supplied bolts": "supplied bolt", "supplied": "supplieds", "bolts": "bolt", "organizations": "organization", "123": "123s"}
    assert set(other) == set(MISSION.tokens)
    return "(" + " + ".join(f"case when contains(lower({text}), '{a}') or contains(lower({text}), '{b}') then {weight * max(2, min(len(a), 12))} else 0 end" for a, b in other.items()) + ")"


_CHOSEN = f"""with {B.NODES}, {CITED},
 named as (select c.*, s.node_type as source_type, s.name as source_name, t.node_type as target_type, t.name as target_name, s.node_type || ': ' || s.name || ' --' || relation_type || '--> ' || t.node_type || ': ' || t.name as title from cited c join nodes s on s.node_id = source_node join nodes t on t.node_id = target_node where confidence >= 0.6),
 said as (select edge_id, unnest(provenance) as p, unnest(range(1, len(provenance) + 1)) as i from named),
 support as (select edge_id, count(distinct nullif(p.paper, '')) as support_count, count(*) filter (p.evidence <> '') as n_evidence from said group by 1),
 ranked as (select *, {score_sql('title', 2)} + {score_sql('relation_type', 1)} as relevance, round(confidence, 3) as short from named join support using (edge_id) where n_evidence > 0),
 chosen as (select *, printf('P-%04d', edge_id) as pattern_id from ranked order by relevance desc, support_count desc, short desc, confidence desc, edge_id limit 200)"""

_HITS = lambda text, words: "(" + " + ".join(f"contains(lower({text}), '{w}')::int" for w in words) + ")"
_CARDS = f""", {B.HYPEREDGES}, {B.MEMBERS},
 h as (select o_orderkey as hyperedge_id, case when o_orderkey % 50 <> 0 then hyperedge_type end as hyperedge_type, case o_orderstatus when 'F' then 'is_a' when 'O' then 'Oxidation, ' || lower(o_orderpriority) else 'widgets for ' || o_custkey end as label, round(o_totalprice / 600000, 4) as raw, case when o_orderkey % 2 = 0 then 'tested' end as tier from orders join hyperedges on hyperedge_id = o_orderkey),
 scan as (select *, round(raw, 3) as confidence, coalesce(hyperedge_type, 'other') as kind from h where raw >= 0.6 order by raw desc, hyperedge_id desc limit 1500),
 names as (select hyperedge_id, string_agg(name, ' ' order by role, node_id) as names from scan join members using (hyperedge_id) join nodes using (node_id) group by 1),
 brief as (select scan.*, coalesce(names, '') as names, {score_sql('label', 3)} + {score_sql("coalesce(names, '')", 1)} + case when hyperedge_type = 'event' then 1.5 else 0 end + 2.0 * {_HITS('label', MISSION.mechanism)} + 0.5 * {_HITS('label', MISSION.condition)} - case when hyperedge_type = 'relation' and label = 'is_a' then 3 else 0 end + 0.01 * confidence as score from scan left join names using (hyperedge_id)),
 picked as (select *, row_number() over (partition by kind order by score desc, hyperedge_id desc) as n, first_value(raw) over (partition by kind order by raw desc, hyperedge_id desc) as top_raw, first_value(hyperedge_id) over (partition by kind order by raw desc, hyperedge_id desc) as top_id from brief qualify n <= case kind when 'event' then 120 when 'mechanism' then 40 when 'reaction' then 40 else 30 end),
 span as (select distinct l_orderkey as hyperedge_id, l_linenumber, l_partkey, l_suppkey, case when l_linenumber % 2 = 0 then 'o' || l_orderkey end as paper_key, case when l_linenumber % 4 <> 0 then 'span of ' || l_partkey end as span_text from lineitem),
 placed as (select *, row_number() over (partition by hyperedge_id order by l_linenumber, l_partkey, l_suppkey) as i from span),
 extra as (select l_orderkey as hyperedge_id, bool_or(l_returnflag = 'R') as c, bool_or(l_linestatus = 'O') as m from lineitem group by 1),
 owned as (select hyperedge_id, count(distinct paper_key) as support_count, string_agg(printf('H-%04d-%d', hyperedge_id, i), ',' order by i) filter (i <= 3 and span_text is not null) as evidence_ids from placed group by 1),
 worded as (select picked.*, label || ' ' || names || case when c then ' oxidant' else '' end || case when m then ' urgent yield' else '' end as words from picked left join extra using (hyperedge_id)),
 cards as (select *, {_HITS('words', MISSION.mechanism)} as mechanism_score, {score_sql('label', 3)} + {_HITS('words', MISSION.mechanism)} as relevance, coalesce(support_count, 0) as support, coalesce(evidence_ids, '') as ids from worded left join owned using (hyperedge_id))"""


@query("g19_evidence_mining", f"{_CHOSEN} select pattern_id, title, support_count, short as confidence, evidence_tier, relevance, n_evidence, list_aggregate(list_distinct(list_filter(list_transform(provenance, lambda x: x.paper), lambda x: x <> '')), 'count') as n_papers, row_number() over (order by relevance desc, support_count desc, short desc, confidence desc, edge_id) as place from chosen")
def g19(spark, d):
    p = E.patterns(cited_edges(spark, d), B.nodes(spark, d), MISSION)
    return p.select("pattern_id", "title", "support_count", "confidence", "evidence_tier", "relevance", F.size("evidence_ids").alias("n_evidence"), F.size("paper_keys").alias("n_papers"), "place")


@query("g19_evidence", f"""{_CHOSEN}{_CARDS},
 top as (select printf('E-%04d-%d', edge_id, i) as evidence_id, pattern_id, 'ontology' as source, coalesce(nullif(p.paper, ''), 'unknown') as paper_key, p.evidence as sentence, short as confidence, evidence_tier from chosen join said using (edge_id) where p.evidence <> '' order by chosen.confidence desc, edge_id, i limit 500),
 both_kinds as (select * from top union all select printf('H-%04d-%d', hyperedge_id, i), '', 'hyperedge', coalesce(paper_key, 'unknown'), span_text, confidence, coalesce(tier, 'unclassified') from cards join placed using (hyperedge_id) where i <= 3 and span_text is not null)
 select b.*, year(o_orderdate) as year from both_kinds b left join orders on paper_key = 'o' || o_orderkey""")
def g19_evidence(spark, d):
    return E.mine(tables(spark, d), MISSION)["evidence"].select("evidence_id", "pattern_id", "source", "paper_key", "sentence", "confidence", "evidence_tier", "year")


@query("g19_hyperedges", f"{_CHOSEN}{_CARDS} select printf('H-%04d', hyperedge_id) as reference_id, hyperedge_type, label, names, confidence, mechanism_score, relevance, support as support_count, ids as evidence_ids, row_number() over (order by mechanism_score desc, relevance desc, support desc, confidence desc, top_raw desc, top_id desc, n) as place from cards")
def g19_hyperedges(spark, d):
    t = facts(spark, d)
    h = E.cards(t["hyperedges"], t["members"], B.nodes(spark, d), t["spans"], t["conditions"], t["measurements"], MISSION)
    return h.select("reference_id", "hyperedge_type", "label", F.array_join("member_names", " ").alias("names"), "confidence", "mechanism_score", "relevance", "support_count", F.array_join("evidence_ids", ",").alias("evidence_ids"), "place")


@query("g19_coverage", f"{_CHOSEN}{_CARDS}, n as (select (select count(*) from chosen) as patterns, (select count(*) from cards) as hyperedges, (select sum(support_count) from chosen) as s) select patterns, hyperedges, round(s / greatest(patterns, 1), 6) as average_support, round(least(1.0, greatest((patterns + hyperedges) / 1000.0, s / greatest(patterns, 1) / 3.0)), 3) as coverage_score from n")
def g19_coverage(spark, d):
    return E.mine(tables(spark, d), MISSION)["coverage"]


@query("g19_papers", f"{_CHOSEN}{_CARDS} select paper_key, year(o_orderdate) as year from (select nullif(p.paper, '') as paper_key from said union select paper_key from cards join placed using (hyperedge_id)) left join orders on paper_key = 'o' || o_orderkey where paper_key is not null")
def g19_papers(spark, d):
    return E.mine(tables(spark, d), MISSION)["papers"]
