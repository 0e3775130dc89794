"""Queries of rebuilt views, walks through JSON and citation tracing over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tracing, views, walks
from . import bindings as B
from .registry import query

RULES = (("colour", ("red", "blue")), ("size", ("small", "large", "brand#1")), ("shape", ("ring",)), ("bodies", ("organization", "supplier")))
_GRAPH = f"with {B.NODES}, {B.EDGES}"


def nodes(spark, d):
    """Nodes with aliases and papers: a part's brand and sizes."""
    more = B.table(spark, d, "part").select((F.col("p_partkey") * 4).alias("node_id"), F.array("p_brand").alias("aliases"), (F.col("p_size") / 50.0).alias("confidence"), F.transform(F.sequence(F.lit(0), F.col("p_size") % 3), lambda i: F.concat(F.lit("p"), (i % 2).cast("string"))).alias("papers"))
    return B.nodes(spark, d).join(more, "node_id", "left")


_MEMBERS = f"""{_GRAPH}, n as (select n.*, p_brand, coalesce(nullif(p_size / 50.0, 0), 0.5) as confidence from nodes n left join part on node_type = 'material' and node_id = p_partkey * 4),
 w(label, word) as (values {', '.join(f"('{a}', '{b}')" for a, words in RULES for b in words)}),
 labels as (select distinct label, node_id from n join w on contains(lower(name || ' ' || coalesce(p_brand, '')), word) union select t.name, e.source_node from edges e join n t on t.node_id = target_node where relation_type in ('is_a', 'part_of')),
 m as (select 'auto-semantic:' || substr(sha1(label), 1, 20) as domain_key, label, node_id, 1.0::double as weight, confidence from labels join n using (node_id))"""


@query("g14_domains", f"{_MEMBERS} select domain_key, label, 'semantic_cluster' as domain_type, count(*) as members from m group by 1, 2")
def g14(spark, d):
    return views.domains(views.domain_members(nodes(spark, d), B.edges(spark, d), RULES))


@query("g14_domain_members", f"{_MEMBERS} select domain_key, label, node_id, weight, confidence from m")
def g14_members(spark, d):
    return views.domain_members(nodes(spark, d), B.edges(spark, d), RULES)


_CHANNELS = f"""with {B.NODES}, {B.HYPEREDGES}, {B.MEMBERS}, typed as (select hyperedge_id, role || ':' || node_type as x from members join nodes using (node_id)),
 shape as (select hyperedge_id, '["' || string_agg(x, '", "' order by x) || '"]' as signature, string_agg(distinct x, ',' order by x) as roles from typed group by 1),
 c as (select 'auto:' || substr(sha1('["' || hyperedge_type || '", ' || coalesce(signature, '[]') || ']'), 1, 20) as channel_key, h.*, coalesce(nullif(h.confidence, 0.0), 0.5) as sure, coalesce(roles, '') as roles from hyperedges h left join shape using (hyperedge_id))"""


@query("a15_channels", f"{_CHANNELS} select channel_key, hyperedge_type as relation_family, any_value(roles) as roles, count(*) as support_count, count(distinct paper_key) as paper_count, round(avg(sure) * count(*), 3) as confidence_sum, hyperedge_type || ' 角色通道' as summary from c group by 1, 2")
def a15(spark, d):
    found = views.channels(views.channel_members(B.hyperedges(spark, d), B.members(spark, d), B.nodes(spark, d)))
    roles = F.array_join(F.array_sort(F.flatten(F.transform(F.map_entries("role_profile"), lambda e: F.transform(e["value"], lambda t: F.concat_ws(":", e["key"], t))))), ",")
    # a mean may end in a tie at its last decimal; the sum of thousandths does not
    return found.select("channel_key", "relation_family", roles.alias("roles"), "support_count", "paper_count", F.round(F.col("confidence") * F.col("support_count"), 3).alias("confidence_sum"), "summary")


@query("a15_channel_hyperedges", f"{_CHANNELS} select channel_key, hyperedge_id, 1.0::double as weight from c")
def a15_members(spark, d):
    return views.channel_members(B.hyperedges(spark, d), B.members(spark, d), B.nodes(spark, d)).select("channel_key", "hyperedge_id", "weight")


_SURE = "relation_type <> 'supplied_by' and source_node % 8 <> 1"


@query("a21_health", f"{_GRAPH}, e as (select * from edges where {_SURE}), both_ways as materialized (select source_node as a, target_node as b from e union select target_node, source_node from e), l0 as (select node_id, node_id as label from nodes), {', '.join(f'l{i} as materialized (select node_id, min(label) as label from (select * from l{i - 1} union all select b, label from both_ways join l{i - 1} on a = node_id) group by 1)' for i in range(1, 9))}, deg as (select n.node_id, count(a.node_id) as degree from nodes n left join (select source_node as node_id from e union all select target_node from e) a using (node_id) group by 1), sizes as (select count(*) as n from l8 group by label), t as (select count(*) as nodes, (select count(*) from e) as edges, count(*) filter (degree = 0) as isolated, sum(degree) as total from deg) select nodes, edges, isolated, round(isolated / nodes, 4) as isolated_ratio, (select count(*) from sizes) as components, round((select max(n) from sizes) / nodes, 4) as largest_comp_ratio, (select count(*) from part where p_size % 3 > 0) as multi_paper_nodes, round((select count(*) from part where p_size % 3 > 0) / nodes, 4) as multi_paper_ratio, round(total / nodes, 3) as avg_degree from t")
def a21(spark, d):
    """Over the relations of places, whose components the SQL can unroll."""
    return views.health(nodes(spark, d), B.edges(spark, d).filter(_SURE))


TOPIC, REQUIRED, SEEDS = ["bone", "Gear wheel"], ["bone", "steel"], ["p1", " p2 ", "p1", "", "p3"]


def references(spark, d):
    line = B.table(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    title = F.when(flag == "A", "Bone study").when(flag == "R", "steel, a gear wheel").otherwise("bon")
    return line.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" P"), ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % 1999).cast("string"))).alias("paper_key"), F.concat(F.lit("p"), ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % 1999).cast("string")).alias("doi"), title.alias("title"), F.lit(None).cast("string").alias("abstract"), F.lit("").alias("keywords"))


_TRACE = ", ".join((
    "r as materialized (select 'p' || l_partkey as source, l_orderkey * 8 + l_linenumber as pos, 'p' || (l_partkey * 7 + l_suppkey * 13) % 1999 as identity from lineitem where l_returnflag in ('A', 'R'))",
    "v0(place, identity) as (values (1, 'p1'), (2, 'p2'), (3, 'p3'))",
))


@query("g18_trace", f"with {_TRACE}, f1 as (select v.place as rank, pos, r.identity, r.source from v0 v join r on r.source = v.identity where r.identity not in (select identity from v0)), q1 as (select *, row_number() over (partition by identity order by rank, pos) as k from f1), v1 as materialized (select row_number() over (order by rank, pos, identity) as place, identity, source, 1 as depth from q1 where k = 1), f2 as (select v.place as rank, pos, r.identity, r.source from v1 v join r on r.source = v.identity where r.identity not in (select identity from v0 union all select identity from v1)), q2 as (select *, row_number() over (partition by identity order by rank, pos) as k from f2), v2 as (select (select count(*) from v1) + row_number() over (order by rank, pos, identity) as place, identity, source, 2 as depth from q2 where k = 1) select * from v1 union all select * from v2")
def g18(spark, d):
    return tracing.trace(references(spark, d), SEEDS, TOPIC, REQUIRED, max_depth=2, max_results=5000)


def answers(spark, d):
    """A nested answer for each event, with ids of events at some depth."""
    k = F.col("event_id")
    ids = F.to_json(F.array(F.format_string("E-%d", k), F.format_string("P-%d", k + 1), F.lit(" prose "), F.lit(""), F.format_string("E-%d", k)))
    deep = F.concat(F.lit('{"a": [{"b": {"evidence_ids": '), ids, F.lit(', "note": "E-1"}}, 1.5], "Hyperedges": ["H-1"], "ideas": ["E-2"], "c": {}}'))
    return B.table(spark, d, "events").select(k, deep.alias("answer"))


def known(spark, d):
    return B.table(spark, d, "events").filter("event_id % 3 != 0").select(F.format_string("E-%d", "event_id").alias("id"))


@query("n04_nested", """with k as (select event_id, event_id % 3 <> 0 as known from events) select event_id, '{"Hyperedges":[],"a":[{"b":{"evidence_ids":[' || case when known then '"E-' || event_id || '"' else '' end || '],"note":"E-1"}},1.5],"c":{},"ideas":["E-2"]}' as json from k""")
def n04_nested(spark, d):
    return walks.sanitise(answers(spark, d), "event_id", "answer", known(spark, d))[0]


@query("n04_notes", "select event_id, x as value, case x when 'prose' then 'misplaced' else 'invalid' end as verdict from (select event_id, unnest(case when event_id % 3 <> 0 then ['P-' || (event_id + 1), 'prose', 'H-1'] else ['E-' || event_id, 'E-' || event_id, 'P-' || (event_id + 1), 'prose', 'H-1'] end) as x from events)")
def n04_notes(spark, d):
    return walks.sanitise(answers(spark, d), "event_id", "answer", known(spark, d))[1].select("event_id", "value", "verdict")
