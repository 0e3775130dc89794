"""Queries of the library's surface: works are documents, their log is the events table, their assessment the labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import surface as U
from . import bindings as B
from .registry import query

_COLUMNS = {
    "paper_key": "doc_id", "title": "split_part(text, {nl}, 1)", "abstract": "cast(null as {str})", "venue": "lang", "doi": "concat('10.1/', doc_id)", "source": "source",
    "source_type": "case when doc_id % 2 = 0 then 'journal' else 'preprint' end", "status": "case doc_id % 4 when 0 then 'ingested' when 1 then 'human_review' when 2 then 'quality_rejected' else 'needs_enrich' end",
    "pub_year": "case when doc_id % 7 = 0 then null else cast(1990 + doc_id % 30 as int) end", "fulltext_source": "case doc_id % 3 when 0 then 'pdf' when 1 then 'xml' else 'abstract' end", "created_at": "doc_id * 7 % 1000", "clean_text": "text",
}
_QUALITY = {"paper_key": "doc_id", "quality": "doc_id % 100 / 100.0", "decision": "case when quality = 1 then 'knowledge' when toxic = 1 then 'human' else 'flagged' end", "needs_review": "toxic = 1", "rationale": "case when doc_id % 2 = 0 then 'seen' end"}
_LOG = {
    "id": "event_id", "paper_key": "user_id", "node": "event_type", "event": "case event_id % 4 when 0 then 'extracted' when 1 then 'relevance-gate-low-signal' else concat('dispatch.', event_type) end",
    "details": "case when event_id % 3 = 0 then 'low_signal' else props end", "level": "case event_id % 5 when 0 then 'ERROR' when 1 then 'WARN' when 2 then 'INFO' else 'DEBUG' end", "ts": "ts",
}


def _columns(of: dict[str, str], **words: str) -> list[str]:
    return [f"{e.format(**words) if words else e} as {c}" for c, e in of.items()]


def papers(spark, d):
    return B.table(spark, d, "documents").selectExpr(*_columns(_COLUMNS, nl="'\\n'", str="string"))


def quality(spark, d):
    rated = B.table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return rated.selectExpr("doc_id", "quality", "toxic").selectExpr(*_columns(_QUALITY)).withColumn("quality", F.col("quality").cast("double"))


def log(spark, d):
    return B.table(spark, d, "events").selectExpr(*_columns(_LOG))


P = f"papers as (select {', '.join(_columns(_COLUMNS, nl='chr(10)', str='varchar'))} from documents)"
Q = f"quality as (select {', '.join(_columns(_QUALITY))} from (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1))"
LOG = f"log as (select {', '.join(_columns(_LOG))} from events)"
_GATE = "exists (select 1 from log l where l.paper_key = p.paper_key and l.event = 'relevance-gate-low-signal'"
_DONE = "exists (select 1 from log l where l.paper_key = p.paper_key and l.event = 'extracted')"


@query("p02_equality_filters", f"with {P}, {Q} select p.paper_key, title, status, quality, decision from papers p left join quality q using (paper_key) where status = 'ingested' and source_type = 'journal' and decision = 'flagged' and pub_year between 1995 and 2010")
def p02(spark, d):
    found = U.search(papers(spark, d), quality(spark, d), log(spark, d), equal={"status": "ingested", "source_type": "journal", "source": ""}, decision="flagged", years=(1995, 2010))
    return found.select("paper_key", "title", "status", "quality", "decision")


@query("p04_low_signal", f"with {P}, {LOG} select paper_key, 'yes' as low_signal from papers p where {_GATE} and l.details like '%low_signal%') union all select paper_key, 'no' from papers p where not {_GATE}) or {_GATE} and (l.details is null or l.details not like '%low_signal%'))")
def p04(spark, d):
    ask = lambda yes: U.search(papers(spark, d), quality(spark, d), log(spark, d), low_signal=yes).select("paper_key", F.lit("yes" if yes else "no").alias("low_signal"))
    return ask(True).unionByName(ask(False))


@query("p05_list_projection", f"with {P}, {Q} select p.paper_key, title, venue, doi, source, source_type, status, pub_year, quality, decision, coalesce(needs_review, false) as needs_review from papers p left join quality using (paper_key) where pub_year is null and (title ilike '%th%' or venue ilike '%th%' or doi ilike '%th%' or cast(paper_key as varchar) ilike '%th%')")
def p05(spark, d):
    found = U.search(papers(spark, d), quality(spark, d), log(spark, d), q=" TH ", unknown_year=True)
    assert "clean_text" not in found.columns
    return found.select("paper_key", "title", "venue", "doi", "source", "source_type", "status", "pub_year", "quality", "decision", F.coalesce("needs_review", F.lit(False)).alias("needs_review"))


@query("j02_log_left_join", f"with {P}, {LOG} select p.paper_key, count(l.id) as n, max(l.id) as last_id from papers p left join log l on l.paper_key = p.paper_key and l.event = 'relevance-gate-low-signal' group by 1")
def j02(spark, d):
    gate = log(spark, d).filter(F.col("event") == U.GATE).groupBy("paper_key").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))
    return papers(spark, d).select("paper_key").join(gate, "paper_key", "left").fillna(0, ["n"])


@query("j04_knowledge_exists", f"with {P}, {LOG} select paper_key, true as has_knowledge from papers p where {_DONE} union all select paper_key, false from papers p where not {_DONE}")
def j04(spark, d):
    ask = lambda yes: U.search(papers(spark, d), quality(spark, d), log(spark, d), has_knowledge=yes).select("paper_key", F.lit(yes).alias("has_knowledge"))
    return ask(True).unionByName(ask(False))


@query("a04_distinct_total", f"with {P}, {Q}, {LOG} select count(distinct p.paper_key) as total from papers p left join quality q using (paper_key) left join log l on l.paper_key = p.paper_key and l.event = 'relevance-gate-low-signal' where l.details like '%low_signal%' and status <> '' and q.decision = 'knowledge' and exists (select 1 from events e where e.user_id = p.paper_key and e.event_type = 'purchase')")
def a04(spark, d):
    tagged = B.table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("paper_key"))
    found = U.search(papers(spark, d), quality(spark, d), log(spark, d), decision="knowledge", low_signal=True, holding={"tags": tagged})
    return found.agg(F.count_distinct("paper_key").alias("total"))


@query("a01_year_facets", f"with {P} select min(pub_year) as year_min, max(pub_year) as year_max, count(*) filter (pub_year is null) as year_unknown from papers")
def a01_years(spark, d):
    return U.year_facets(papers(spark, d))


@query("a03_library_stats", f"""with {P}, {Q}, {LOG} select 'papers' as name, count(*) as n from papers union all select 'with_fulltext', count(*) from papers where fulltext_source in ('pdf', 'xml') union all select 'abstract_only', count(*) from papers where fulltext_source = 'abstract'
 union all select 'unknown_year', count(*) from papers where pub_year is null union all select 'favorites', count(*) from customer where c_acctbal > 5000 union all select 'tags', count(distinct o_orderpriority) from orders union all select 'folders', count(*) from nation
 union all select 'assessed', count(*) from quality union all select 'needs_review', count(*) from quality where needs_review union all select 'extracted', count(distinct paper_key) from log where event = 'extracted' union all select 'low_signal', count(*) from log where event = 'relevance-gate-low-signal'""")
def a03_library(spark, d):
    tags = B.table(spark, d, "orders").select(F.col("o_custkey").alias("paper_key"), F.col("o_orderpriority").alias("tag"))
    return U.library_stats(papers(spark, d), quality(spark, d), log(spark, d), tags, B.table(spark, d, "nation"), B.table(spark, d, "customer").filter("c_acctbal > 5000"))


@query("a11_status_counts", f"with {P}, {Q}, {LOG} select 'papers' as name, cast(count(*) as double) as n from papers union all select 'ingested', count(*) from papers where status = 'ingested' union all select 'human_review', count(*) from papers where status = 'human_review' union all select 'rejected', count(*) from papers where status = 'quality_rejected' union all select 'passed', count(distinct paper_key) from quality where decision in ('knowledge', 'flagged', 'direct') union all select 'extracted', count(distinct paper_key) from log where event = 'extracted' union all select 'avg_score', round(avg(cast(quality as double)), 3) from quality")
def a11(spark, d):
    counts = U.status_counts(papers(spark, d), quality(spark, d), log(spark, d)).select("name", F.col("n").cast("double").alias("n"))
    return counts.unionByName(U.average_quality(quality(spark, d)).select(F.lit("avg_score").alias("name"), F.col("avg_score").alias("n")))


@query("a02_tags", "select o_orderpriority as tag, count(distinct o_custkey) as n from orders group by 1")
def a02_tags(spark, d):
    return U.tag_counts(B.table(spark, d, "orders").select(F.col("o_custkey").alias("paper_key"), F.col("o_orderpriority").alias("tag")))


@query("x03_paper_details", f"with {P}, {Q}, {LOG}, k as (select *, row_number() over (partition by paper_key order by id desc) as n from log where paper_key is not null), g as (select paper_key, count(*) as n_logs, string_agg(id, ',' order by id desc) as ids, max(ts) as last_ts from (select * from k where n <= 3) group by 1), r as (select paper_key, node as run_node from k where n = 1) select p.paper_key, length(substr(clean_text, 1, 1000)) as shown, coalesce(length(clean_text), 0) as clean_chars, q.decision, run_node, coalesce(n_logs, 0) as n_logs, last_ts from papers p left join quality q using (paper_key) left join g using (paper_key) left join r using (paper_key)")
def x03(spark, d):
    found = U.details(papers(spark, d), quality(spark, d), log(spark, d), log(spark, d).withColumn("ts", F.col("id")).filter("paper_key is not null"), preview=1000, most=3)
    return found.select("paper_key", F.length("clean_preview").alias("shown"), "clean_chars", F.col("quality.decision").alias("decision"), F.col("run.node").alias("run_node"), "n_logs", F.array_max(F.transform("logs", lambda x: x["ts"])).alias("last_ts"))


@query("x04_review_queue", f"with {P}, {Q} select p.paper_key, created_at, substr(clean_text, 1, 1800) as clean_preview, quality, decision from papers p left join quality using (paper_key) where status = 'human_review'")
def x04(spark, d):
    return U.review_queue(papers(spark, d), quality(spark, d)).select("paper_key", "created_at", "clean_preview", "quality", "decision")


@query("x04_review_history", f"with {P}, {LOG} select l.id, l.paper_key, l.node, p.title, p.source, p.pub_year from (select * from log order by id desc limit 200) l left join papers p using (paper_key)")
def x04_history(spark, d):
    return U.review_history(log(spark, d).select("id", "paper_key", "node"), papers(spark, d)).select("id", "paper_key", "node", "title", "source", "pub_year")


@query("k11_human_review", f"""with {Q}, r as (select doc_id as paper_key, case doc_id % 6 when 0 then 'accept' when 1 then 'accept_flagged' when 2 then 'enrich' when 3 then 'reject' when 4 then 'custom' else 'nonsense' end as action, case doc_id % 5 when 0 then 'Flagged ' when 1 then 'odd' when 2 then '' when 3 then 'rejected' end as decision, case when doc_id % 11 = 0 then ' why ' end as own from documents),
 d as (select *, case action when 'accept' then 'knowledge' when 'accept_flagged' then 'flagged' when 'enrich' then 'enrich' when 'reject' then 'rejected' else case decision when 'Flagged ' then 'flagged' when 'rejected' then 'rejected' else 'human' end end as decided from r where action <> 'nonsense')
 select d.paper_key, decided as decision, decided = 'flagged' as needs_review, case decided when 'knowledge' then 'ingested' when 'flagged' then 'ingested' when 'enrich' then 'needs_enrich' when 'rejected' then 'rejected' else 'human_review' end as status,
 coalesce(trim(own), rationale, case action when 'accept' then '通过并进入知识提取' when 'accept_flagged' then '标记后进入知识提取' when 'enrich' then '退回元数据补全' when 'reject' then '拒绝并排除该文献' else '自定义: ' || decided end) as rationale from d left join quality q using (paper_key)""")
def k11(spark, d):
    k = F.col("doc_id")
    action = F.element_at(F.array(*[F.lit(x) for x in ("accept", "accept_flagged", "enrich", "reject", "custom", "nonsense")]), (k % 6 + 1).cast("int"))
    own = F.get(F.array(*[F.lit(x) for x in ("Flagged ", "odd", "", "rejected", None)]), (k % 5).cast("int"))
    asked = B.table(spark, d, "documents").select(k.alias("paper_key"), action.alias("action"), own.alias("decision"), F.lit(None).cast("boolean").alias("needs_review"), F.when(k % 11 == 0, " why ").alias("rationale"))
    return U.submit_reviews(asked, quality(spark, d))


@query("a08_stage", f"with {LOG} select node, count(*) as n, count(distinct paper_key) as papers, max(ts) as last_ts from log where node = 'click' group by 1")
def a08(spark, d):
    return U.stage_counts(log(spark, d), "click")


@query("p07_activity", f"with {LOG} select id, paper_key, event, details from log where event = 'extracted' and (details ilike '%9%' or cast(paper_key as varchar) like '%9%') order by ts desc, id desc limit 100")
def p07(spark, d):
    return U.activity(log(spark, d), event="extracted", text="9").select("id", "paper_key", "event", "details")


@query("p08_event_filter", f"with {LOG} select id, event, level from log where (event like 'dispatch.%' or event like 'ext%') and level in ('WARN', 'ERROR') and node = 'view'")
def p08(spark, d):
    return U.events(log(spark, d), prefixes="dispatch., ext", level="warn", node="view").select("id", "event", "level")


@query("x05_recent_events", f"with {LOG} select id, paper_key, event, case when details = 'low_signal' then null else cast(json_extract(details, '$.k') as bigint) end as k from log order by id desc limit 300")
def x05(spark, d):
    return U.recent_events(log(spark, d), 300).select("id", "paper_key", "event", F.try_variant_get("details", "$.k", "long").alias("k"))


@query("x05_dispatches", "select o_orderkey as dispatch_id from (select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 30) where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def x05_dispatches(spark, d):
    steps = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("dispatch_id")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("node"))).alias("steps"))
    runs = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("dispatch_id"), F.col("o_orderdate").alias("started_at")).join(steps, "dispatch_id", "left")
    return U.dispatches_for(runs, "R").select("dispatch_id")


_GRAPH = f"with {B.NODES}, {B.EDGES}"


@query("p06_node_filter", f"with n as (select p_partkey as node_id, p_type as node_type, p_name as name, p_size / 50.0 as confidence from part) select node_id, node_type, name from n where confidence >= 0.4 and node_type in ('PROMO', 'SMALL') and name ilike '%re%' and node_id in (select l_partkey from lineitem where l_returnflag = 'R')" )
def p06(spark, d):
    n = B.table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_type").alias("node_type"), F.col("p_name").alias("name"), (F.col("p_size") / 50).alias("confidence"))
    members = B.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("node_id"))
    return U.node_filter(n, 0.4, ["PROMO", "SMALL"], "RE", members).select("node_id", "node_type", "name")


@query("a14_domain_counts", "select n_nationkey as domain_key, n_name as label, (select count(*) from customer where c_nationkey = n_nationkey and c_nationkey < 20) as member_count from nation order by 3 desc, 1 limit 15")
def a14(spark, d):
    members = B.table(spark, d, "customer").filter("c_nationkey < 20").select(F.col("c_nationkey").alias("domain_key"))
    return U.domain_counts(B.table(spark, d, "nation").select(F.col("n_nationkey").alias("domain_key"), F.col("n_name").alias("label")), members, 15)


@query("a06_graph_summary", f"{_GRAPH}, {B.HYPEREDGES} select 'nodes' as name, count(*) as n from nodes union all select 'edges', count(*) from edges union all select 'hyperedges', count(*) from hyperedges union all select 'node:' || node_type, count(*) from nodes group by 1 union all select 'edge:' || relation_type, count(*) from edges group by 1 union all select 'status:' || hyperedge_type, count(*) from hyperedges group by 1")
def a06(spark, d):
    n, e, h = B.nodes(spark, d), B.edges(spark, d), B.hyperedges(spark, d)
    maps = U.type_maps(node=(n, "node_type"), edge=(e, "relation_type"), status=(h, "hyperedge_type"))
    return U.sizes(nodes=n, edges=e, hyperedges=h).unionByName(maps.select(F.concat_ws(":", "kind", "name").alias("name"), "n"))


@query("a12_generic_relations", f"{_GRAPH} select relation_type, count(*) as n from edges where relation_type in ('located_in', 'part_of', 'related_to') group by 1")
def a12(spark, d):
    return U.relation_counts(B.edges(spark, d), ["located_in", "part_of", "related_to"])


@query("a16_experiments", f"with {B.HYPEREDGES}, c as (select l_orderkey as k, count(*) filter (l_discount >= 0.08) as n_conditions, count(*) filter (l_tax >= 0.07) as n_measurements from lineitem group by 1) select hyperedge_id, label as experiment_name, hyperedge_type, paper_key, n_conditions, n_measurements from hyperedges join c on k = hyperedge_id where n_conditions > 0 or n_measurements > 0")
def a16(spark, d):
    line = B.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "hyperedge_id")
    return U.experiments(B.hyperedges(spark, d), line.filter("l_discount >= 0.08"), line.filter("l_tax >= 0.07"))


@query("j23_recommend_materials", f"with {B.HYPEREDGES}, h as (select hyperedge_id, case when hyperedge_id % 3 = 0 then '' else label end as label, paper_key from hyperedges) select hyperedge_id, coalesce(nullif(label, ''), c_name) as title, coalesce(c_name, '') as text from h left join customer on c_custkey = paper_key where label ilike '%77%' or c_name ilike '%77%' order by hyperedge_id limit 50")
def j23(spark, d):
    h = B.hyperedges(spark, d).withColumn("label", F.when(F.col("hyperedge_id") % 3 == 0, "").otherwise(F.col("label")))
    return U.recommend_materials(h, B.table(spark, d, "customer").select(F.col("c_custkey").alias("paper_key"), F.col("c_name").alias("title")), "77", 50)


@query("g21_hybrid_search", f"{_GRAPH}, s as (select * from nodes where name ilike '%red%' order by node_id limit 30) select relation_type, source_node, target_node, a.name as source_name, b.name as target_name from edges left join nodes a on a.node_id = source_node left join nodes b on b.node_id = target_node where source_node in (select node_id from s) or target_node in (select node_id from s)")
def g21(spark, d):
    n, e = B.nodes(spark, d), B.edges(spark, d)
    touching = G.induced(e, U.match_nodes(n, "RED"), both=False)
    return G.edge_labels(touching, n, dangling=True).select("relation_type", "source_node", "target_node", "source_name", "target_name")


@query("a23_related", f"{_GRAPH}, c as (select * from nodes where name like 'blue%'), t as (select * from edges where source_node in (select node_id from c) or target_node in (select node_id from c)), w as (select node_id, count(*) as weight from (select source_node as node_id from t union all select target_node from t) where node_id not in (select node_id from c) group by 1 order by 2 desc, 1 limit 10) select node_id, weight, node_type, name from w join nodes using (node_id)")
def a23(spark, d):
    n = B.nodes(spark, d)
    return U.related(n, B.edges(spark, d), n.filter("name like 'blue%'")).select("node_id", "weight", "node_type", "name")


@query("x06_vocabulary", f"{_GRAPH} select node_id, node_type || ': ' || name as term from nodes where node_id in (select source_node from edges union all select target_node from edges) order by node_id desc limit 150")
def x06(spark, d):
    return U.vocabulary(B.nodes(spark, d).withColumn("last_seen", F.col("node_id")), B.edges(spark, d))


@query("x20_top_materials", f"with {P}, {Q} select p.paper_key, quality, pub_year from papers p left join quality using (paper_key) order by quality desc nulls last, pub_year desc nulls last, p.paper_key limit 80")
def x20(spark, d):
    return U.top_materials(papers(spark, d), quality(spark, d), 80).select("paper_key", "quality", "pub_year")


@query("x21_project_outline", """with p as (select c_custkey as project_id from customer), old as (select o_custkey as project_id, case o_orderkey % 3 when 0 then 'intro' when 1 then 'methods' else 'extra' end as section_key, min(case when o_orderkey % 5 = 0 then '' else 'text' end) as content from orders group by 1, 2),
 s as (select project_id, section_key, content from old union all select project_id, k, '' from p, (values ('intro'), ('methods'), ('results')) v(k) where not exists (select 1 from old where old.project_id = p.project_id and old.section_key = k))
 select project_id, count(section_key) as total, count(*) filter (trim(content) <> '') as filled from p left join s using (project_id) group by 1""")
def x21(spark, d):
    projects = B.table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"))
    k = F.col("o_orderkey")
    old = B.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("project_id"), F.when(k % 3 == 0, "intro").when(k % 3 == 1, "methods").otherwise("extra").alias("section_key")).agg(F.min(F.when(k % 5 == 0, "").otherwise("text")).alias("content"))
    sections = U.outline(projects, old.select("project_id", F.lit(0).alias("position"), "section_key", F.lit("h").alias("heading"), "content"), [("intro", "Introduction"), ("methods", "Methods"), ("results", "Results")])
    return U.project_progress(projects, sections).select("project_id", "total", "filled")


@query("w06_briefs", f"with {B.HYPEREDGES} select hyperedge_id, confidence from hyperedges order by confidence desc, hyperedge_id desc limit 1500")
def w06(spark, d):
    return U.briefs(B.hyperedges(spark, d)).select("hyperedge_id", "confidence")


@query("w10_budget", "with t as (select p_brand, p_partkey, sum(length(p_name)) over (partition by p_brand order by p_size desc, p_partkey rows unbounded preceding) as total, row_number() over (partition by p_brand order by p_size desc, p_partkey) as n from part) select p_brand, p_partkey from t where total <= 200 or n <= 2")
def w10(spark, d):
    return U.within_budget(B.table(spark, d, "part"), ["p_brand"], [F.desc("p_size"), F.asc("p_partkey")], "p_name", 200, 2).select("p_brand", "p_partkey")


@query("x26_longest", f"with {P} select paper_key, length(clean_text) as n from papers where length(clean_text) >= 500 order by 2 desc, 1 limit 100")
def x26(spark, d):
    return U.longest(papers(spark, d), 500, 100)


@query("x29_compare_snapshots", f"{_GRAPH}, a as (select 'node' as kind, node_type as name, count(*) as n from nodes where node_id % 3 = 0 and node_type <> 'area' group by 2), b as (select 'node' as kind, node_type as name, count(*) as n from nodes where node_type <> 'place' group by 2) select kind, name, coalesce(a.n, 0) as before, coalesce(b.n, 0) as after, coalesce(b.n, 0) - coalesce(a.n, 0) as change from a full join b using (kind, name)")
def x29(spark, d):
    n = B.nodes(spark, d)
    return U.compare_snapshots(U.type_maps(node=(n.filter("node_id % 3 = 0 and node_type != 'area'"), "node_type")), U.type_maps(node=(n.filter("node_type != 'place'"), "node_type")))


@query("k04_draft_projection", "select o_orderkey, o_clerk_like as title, n, first_size from (select o_orderkey, o_orderstatus as o_clerk_like, count(*) as n, min(l_partkey) as first_size from orders join lineitem on l_orderkey = o_orderkey group by 1, 2)")
def k04(spark, d):
    strategies = B.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_partkey").alias("size"), F.col("l_returnflag").alias("blob")))).alias("strategies"))
    drafts = B.table(spark, d, "orders").join(strategies, F.col("l_orderkey") == F.col("o_orderkey"))
    stored = drafts.select("o_orderkey", U.draft_projection(F.struct(F.col("o_orderstatus").alias("title"), F.col("o_totalprice").alias("dropped"), "strategies"), ["title"], ["size"]).alias("draft"))
    return stored.select("o_orderkey", "draft.title", F.size("draft.strategies").alias("n"), F.array_min("draft.strategies")["size"].alias("first_size"))
