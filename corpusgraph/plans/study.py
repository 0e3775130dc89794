"""Queries of design rules, reviews, routing, references in texts, page lines and the smaller text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import graph as G
from ..operators import hyperedges as H
from ..operators import library as L
from ..operators import lines as P
from ..operators import study as D
from . import bindings as B
from .registry import query

LABELS = {"combine": "组合", "substitute": "替换", "polarity_reversal": "极性反转", "radical_relay": "自由基接力", "unclassified_transform": "未归类"}
OPERATOR_LEVELS = {"combine": "L2", "substitute": "L1", "polarity_reversal": "L3", "radical_relay": "L4", "unclassified_transform": "L1"}
ALIASES = {"umpolung": "polarity_reversal", "swap": "substitute", "swap relay": "radical_relay"}
_TASKS = [("review", ["the", "zzz"]), ("protocol", ["der", "die"]), ("directions", ["que"])]


def _docs(spark, d):
    return B.table(spark, d, "documents").select("doc_id", "text")


# Rules

_HAS = "contains(lower(coalesce(text, '')), '{}')".format


@query("t41_first_match", f"select doc_id, case when {_HAS('the')} or {_HAS('zzz')} then 'review' when {_HAS('der')} or {_HAS('die')} then 'protocol' when {_HAS('que')} then 'directions' else 'report' end as kind from documents")
def t41(spark, d):
    return _docs(spark, d).select("doc_id", D.first_match(F.col("text"), _TASKS, "report").alias("kind"))


@query("t42_intents", f"select doc_id, array_to_string(list_filter([case when {_HAS('the')} or {_HAS('zzz')} then 'review' end, case when {_HAS('der')} or {_HAS('die')} then 'protocol' end, case when {_HAS('que')} then 'directions' end], lambda x: x is not null), '|') as intents from documents")
def t42(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(D.all_matches(F.col("text"), _TASKS), "|").alias("intents"))


@query("t40_domain", f"with h as (select doc_id, {_HAS('tion')}::int + {_HAS('ing')}::int as a, {_HAS('tion')}::int + {_HAS('eur')}::int + {_HAS('que')}::int as b from documents) select doc_id, case when a = 0 and b = 0 then 'general' when a >= b then 'english' else 'french' end as domain from h")
def t40(spark, d):
    return _docs(spark, d).select("doc_id", D.most_matches(F.col("text"), [("english", ["tion", "ing"]), ("french", ["TION", "eur", "que"])], "general").alias("domain"))


@query("m21_mechanistic_score", f"select doc_id, 3 * ({_HAS('tion')}::int + {_HAS('the')}::int) + 2 * {_HAS('ment')}::int + least(4, {_HAS('an')}::int + {_HAS('er')}::int + {_HAS('on')}::int + {_HAS('es')}::int + {_HAS('en')}::int) as score from documents")
def m21(spark, d):
    return _docs(spark, d).select("doc_id", D.mechanistic_score(F.col("text"), ["tion", "the"], ["ment"], ["AN", "er", "on", "es", "en"]).alias("score"))


_OPERATORS = "case l_linenumber % 6 when 0 then 'combine' when 1 then ' Umpolung! now' when 2 then 'swap relay x' when 3 then 'Radical-Relay' when 4 then '替换' else 'nonsense' end"
_CANON = "case l_linenumber % 6 when 0 then 'combine' when 1 then 'polarity_reversal' when 2 then 'radical_relay' when 3 then 'radical_relay' when 4 then 'substitute' else '' end"


@query("m18_canonical_operator", f"select distinct {_OPERATORS} as said, {_CANON} as operator from lineitem")
def m18(spark, d):
    said = B.table(spark, d, "lineitem").select(F.expr(_OPERATORS).alias("said")).distinct()
    return said.select("said", D.canonical_operator(F.col("said"), LABELS, ALIASES).alias("operator"))


@query("m19_operator_chains", f"""with s as (select l_orderkey as chain_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as position, {_CANON} as op, case when l_linenumber % 2 = 0 then 'alpha beta' else 'gamma' end as ins, case when l_returnflag = 'R' then '' else 'beta' end as outs from lineitem),
 k as (select *, lag(op) over (partition by chain_id order by position) as b from s where op <> ''), c as (select * from k where b is null or b <> op), e as (select *, lag(outs) over (partition by chain_id order by position) as o from c),
 g as (select chain_id, string_agg(op, '|' order by position) as operators, count(*) filter (o <> '' and ins = 'gamma') as breaks, count(*) filter (op in ('polarity_reversal', 'radical_relay')) as mechanistic, bool_or(op = 'combine') as combines from e group by 1)
 select s.chain_id, coalesce(operators, '') as operators, count(*) filter (op = '') as unknown, coalesce(breaks, 0) as breaks, coalesce(mechanistic, 0) as mechanistic, case when mechanistic >= 2 then 'L4' when mechanistic = 1 then 'L3' when combines then 'L2' when operators is not null then 'L1' else 'L0' end as level, coalesce(mechanistic, 0) >= 1 as meets from s left join g using (chain_id) group by s.chain_id, operators, breaks, mechanistic, combines""")
def m19_chains(spark, d):
    line = B.table(spark, d, "lineitem")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    steps = line.select(F.col("l_orderkey").alias("chain_id"), place.alias("position"), F.expr(_OPERATORS).alias("operator"), F.when(F.col("l_linenumber") % 2 == 0, "Alpha beta").otherwise("gamma").alias("input"), F.when(F.col("l_returnflag") == "R", "").otherwise("Beta").alias("output"))
    got = D.chains(steps, OPERATOR_LEVELS, LABELS, ALIASES)
    return got.select("chain_id", F.array_join("operators", "|").alias("operators"), "unknown", "breaks", "mechanistic", "level", D.meets_floor(F.col("level"), F.lit("l3")).alias("meets"))


@query("m15_dimension_weights", "select p_brand as grp, p_partkey as dimension, case when bool_or(p_size % 3 = 0) over (partition by p_brand) then round(case when p_size % 3 = 0 then p_size else 0 end / sum(case when p_size % 3 = 0 then cast(p_size as double) else 0 end) over (partition by p_brand), 6) else p_size end as weight from part")
def m15(spark, d):
    rows = B.table(spark, d, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("dimension"), F.col("p_size").cast("double").alias("weight"), (F.col("p_size") % 3 == 0).alias("required"))
    return D.dimension_weights(rows, "grp").select("grp", "dimension", "weight")


@query("m16_requirement_status", "select p_type as ref, token, case when token in ('rings', '水') then case when token = '水' then 'unverifiable' when exists (select 1 from part where contains(lower(p_name), 'ring')) then 'covered' else 'missing' end when exists (select 1 from part where contains(lower(p_name), token)) then 'covered' else 'missing' end as status from (select distinct p_type from part), (values ('widget'), ('rings'), ('zzzz'), ('水')) v(token)")
def m16(spark, d):
    p = B.table(spark, d, "part")
    asked = p.select(F.col("p_type").alias("ref")).distinct().select("ref", F.explode(F.array(*[F.lit(t) for t in ("widget", "rings", "zzzz", "水")])).alias("token"))
    return D.requirement_status(asked, p.select(F.col("p_name").alias("text")), p.orderBy("p_partkey").select(F.col("p_name").alias("name")))


# Reviews

_CONTRACT = "contract as (select doc_id as draft_id, kind, term from documents, (values ('methods', '3'), ('section', 'Tion'), ('include', 'the'), ('exclude', 'zzz'), ('exclude', 'que'), ('language', 'zh'), ('format', 'x')) v(kind, term) where kind <> 'format')"
_STATUS = f"""drafts as (select doc_id as draft_id, coalesce(text, '') as text, doc_id % 5 as methods from documents), {_CONTRACT},
 checks as (select draft_id, kind, term, case kind when 'methods' then case when methods >= 3 then 'met' else 'unmet' end when 'exclude' then case when contains(lower(text), lower(term)) then 'unmet' else 'met' end when 'language' then 'partial' else case when contains(lower(text), lower(term)) then 'met' else 'unmet' end end as status, case when kind in ('methods', 'exclude') then 'critical' else 'major' end as severity from drafts join contract using (draft_id))"""
_SCORES = f"{_STATUS}, scores as (select draft_id, round(sum(case status when 'met' then 1.0 when 'partial' then 0.5 else 0 end) / count(*), 3) as score, count(*) filter (status <> 'met' and severity = 'critical') as critical, count(*) filter (status = 'unmet') as unmet from checks group by 1)"


def _checks(spark, d):
    docs = B.table(spark, d, "documents")
    drafts = docs.select(F.col("doc_id").alias("draft_id"), "text", (F.col("doc_id") % 5).alias("methods"))
    rules = [("methods", "3"), ("section", "Tion"), ("include", "the"), ("exclude", "zzz"), ("exclude", "que"), ("language", "zh")]
    contract = docs.select(F.col("doc_id").alias("draft_id"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("term")) for k, t in rules])).alias("c")).select("draft_id", "c.*")
    return D.text_requirements(drafts, contract)


@query("q04_instruction_review", f"with {_STATUS} select draft_id, kind, term, status, severity from checks")
def q04(spark, d):
    return _checks(spark, d)


@query("a24_review_scores", f"with {_SCORES} select * from scores")
def a24(spark, d):
    return D.review_scores(_checks(spark, d), "draft_id")


_ITEMS = "items as (select l_orderkey as draft_id, l_linenumber, case when l_returnflag = 'R' then 'supported' else 'hypothesis' end as status, case when l_linenumber % 3 = 0 then null else l_suppkey end as ref from lineitem), known as (select s_suppkey as id from supplier where s_suppkey % 9 <> 0)"
_EVIDENCE = f"{_ITEMS}, f as (select draft_id, count(distinct ref) filter (ref not in (select id from known)) as invalid, count(*) filter (status = 'supported' and ref is null) as unattributed from items group by 1), ev as (select *, case when (invalid > 0)::int + (unattributed > 0)::int = 0 then 1.0 else least(1 - 0.5 * ((invalid > 0)::int + (unattributed > 0)::int), 0.84) end as score, invalid > 0 or unattributed > 0 as hard_fail from f)"


def _evidence(spark, d):
    line = B.table(spark, d, "lineitem")
    refs = F.when(F.col("l_linenumber") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("l_suppkey").cast("string")))
    items = line.select(F.col("l_orderkey").alias("draft_id"), F.col("l_linenumber").alias("item_id"), F.when(F.col("l_returnflag") == "R", "supported").otherwise("hypothesis").alias("status"), refs.alias("refs"))
    known = B.table(spark, d, "supplier").filter("s_suppkey % 9 != 0").select(F.col("s_suppkey").cast("string").alias("id"))
    return D.evidence_reviews(items, known)


@query("q05_evidence_review", f"with {_EVIDENCE} select draft_id, invalid, unattributed, cast(round(greatest(0, score), 3) as double) as score, hard_fail from ev")
def q05(spark, d):
    return _evidence(spark, d)


@query("a24_decision", f"with {_SCORES}, {_EVIDENCE} select s.draft_id, round(0.8 * s.score + 0.2 * round(greatest(0, e.score), 3), 3) as overall, case when e.score < 0.85 or hard_fail then case when hard_fail and critical = 0 then 'need_more_data' else 'revise' end when critical > 0 or unmet > 0 then 'revise' else 'pass' end as decision from scores s join ev e using (draft_id)")
def a24_decision(spark, d):
    return D.review_decision(D.review_scores(_checks(spark, d), "draft_id"), _evidence(spark, d))


@query("q03_design_review", "with c as (select p_brand as draft_id, p_size % 4 as n, p_size % 3 as unknown, p_size % 5 as lv, p_size % 2 = 0 as ok, p_type as sig from part), g as (select draft_id, bool_and(n > 0) as chain, sum(unknown) = 0 as ops, bool_and(lv >= 2) as fl, bool_and(ok) as ev, bool_or(ok) as sm, count(*) < 2 or count(distinct sig) >= 2 as div from c group by 1) select draft_id, kind, case when good then 'met' when half then 'partial' else 'unmet' end as status from (select draft_id, unnest(['chain', 'operators', 'floor', 'constraints', 'diversity']) as kind, unnest([chain, ops, fl, ev, div]) as good, unnest([false, false, false, sm, false]) as half from g)")
def q03(spark, d):
    s = F.col("p_size")
    level = F.get(F.array(*[F.lit(x) for x in D.LEVELS]), (s % 5).cast("int"))
    candidates = B.table(spark, d, "part").select(F.col("p_brand").alias("draft_id"), level.alias("level"), (s % 4).alias("n_operators"), (s % 3).alias("unknown"), (s % 2 == 0).alias("answers_constraints"), F.col("p_type").alias("signature"))
    return D.design_requirements(candidates, "L2", "draft_id").select("draft_id", "kind", "status")


@query("a25_traceability", "select o_orderkey, round(count(*) filter (l_returnflag = 'R') / count(*), 3) as ratio from orders join lineitem on l_orderkey = o_orderkey group by 1")
def a25(spark, d):
    items = F.collect_list(F.struct((F.col("l_returnflag") == "R").alias("traceable")))
    one = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(items.alias("x"))
    return one.select("o_orderkey", D.traceability(F.slice("x", 1, 2), F.slice("x", 3, 1000), F.lit(None).cast("array<struct<traceable:boolean>>")).alias("ratio"))


# Planning and routing

@query("t39_gap_queries", "select p_partkey, case when p_size % 4 = 0 then null else '\"' || p_name || '\" AND ' || p_type || case when p_size % 2 = 1 then ' AND (inhibit* OR suppress* OR reduc* OR block*)' else '' end end as q from part")
def t39(spark, d):
    s = F.col("p_size")
    q = D.gap_query(F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("  "))), F.when(s % 4 != 0, F.col("p_type")), F.when(s % 2 == 1, "inhibits").otherwise("likes"))
    return B.table(spark, d, "part").select("p_partkey", q.alias("q"))


@query("x11_routes", """with s as (select event_id as k, event_type, event_id % 4 as rounds, event_id % 3 = 0 as available, event_id % 5 as m, event_id % 7 as t from events), e as (select *, available and rounds < greatest(1, case when m = 0 then 2 else m end) as again from s)
 select k, case t when 0 then case when event_type = 'view' then 'collection' else 'end' end when 1 then case when event_type = 'click' then 'end' else 'consumer' end when 2 then case when event_type = 'error' then 'manual_review' when not (k % 2 = 0) then 'content' when again then 'collection' else 'content' end
 when 3 then case when k % 2 = 0 and again then 'collection' else 'reviewer' end when 4 then case when k % 11 = 0 then 'fact_check' when k % 11 = 1 then 'manual_review' when k % 11 = 2 and again then 'collection' else 'content_builder' end when 5 then case when k % 2 = 0 then 'pass' when rounds > 1 then 'manual_review' else 'content_builder' end end as goes from e""")
def x11(spark, d):
    k, kind = F.col("event_id"), F.col("event_type")
    stage = F.get(F.array(*[F.lit(x) for x in ("planner", "collection", "consumer", "content", "reviewer", "fact_check")]), (k % 7).cast("int"))
    status = F.when((k % 7 == 0) & (kind == "view"), "planned").when((k % 7 == 1) & (kind == "click"), "planning_failed").when((k % 7 == 2) & (kind == "error"), "consumer_failed")
    decision = F.when(k % 11 == 0, "pass").when(k % 11 == 1, "manual_review").when(k % 11 == 2, "need_more_data")
    even = k % 2 == 0
    state = F.struct(status.alias("status"), (k % 4).alias("collection_rounds"), (k % 3 == 0).alias("collection_available"), (k % 5).alias("max_rounds"), even.alias("has_requests"), even.alias("has_gaps"), F.lit(False).alias("gaps_done"), F.lit(True).alias("gaps_enabled"), decision.alias("decision"), F.when(even, "pass").alias("fact_check"), (k % 4).alias("review_rounds"))
    return B.table(spark, d, "events").select(k.alias("k"), D.route_study(stage, state).alias("goes"))


@query("x11_quality_route", "select p_partkey, case p_size % 4 when 0 then 'knowledge' when 1 then 'knowledge' when 2 then 'retrieval' else 'human_review' end as goes from part")
def x11_quality(spark, d):
    said = F.get(F.array(*[F.lit(x) for x in ("knowledge", "flagged", "enrich", "other")]), (F.col("p_size") % 4).cast("int"))
    return B.table(spark, d, "part").select("p_partkey", D.route_after_quality(said).alias("goes"))


@query("x22_reasons", "select p_partkey, array_to_string(list_filter([case when p_size < 10 then 'papers: ' || p_size || '.0 < 10.0' end, case when p_partkey % 3 = 0 then 'coverage: none < 0.5' end], lambda x: x is not null), '|') as reasons from part")
def x22(spark, d):
    coverage = F.when(F.col("p_partkey") % 3 != 0, 0.75)
    return B.table(spark, d, "part").select("p_partkey", F.array_join(D.reasons(papers=(F.col("p_size"), F.lit(10)), coverage=(coverage, F.lit(0.5))), "|").alias("reasons"))


@query("x08_keep_first", "select p_name as type_key, arg_min(p_partkey, (case when p_size % 2 = 0 then 0 else 1 end) * 100000000 + p_partkey) as label from part group by 1")
def x08(spark, d):
    p = B.table(spark, d, "part").select(F.col("p_name").alias("type_key"), F.col("p_partkey").alias("label"), F.col("p_partkey").alias("ordinal"), "p_size")
    return D.keep_first(["type_key"], p.filter("p_size % 2 = 0").drop("p_size"), p.filter("p_size % 2 = 1").drop("p_size")).select("type_key", "label")


@query("x10_profile", "select p_partkey, case when p_size % 2 = 0 then p_type else 'general' end as kind, 'en' as language from part")
def x10(spark, d):
    profile = F.struct(F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_type"), F.lit(" "))).otherwise(" ").alias("kind"), F.lit(None).cast("string").alias("language"))
    return B.table(spark, d, "part").select("p_partkey", D.with_defaults(profile, {"kind": "general", "language": "en"}).alias("x")).select("p_partkey", "x.*")


@query("x12_refresh", f"with {B.WORKS} select p_partkey, title, coalesce(case when p_partkey % 2 = 0 then citation_count end, h) as citation_count from works")
def x12(spark, d):
    w = B.works(spark, d)
    papers = w.select("p_partkey", "title", F.when(F.col("p_partkey") % 2 == 0, F.col("citation_count")).alias("citation_count"))
    return D.refresh(papers, w.select("p_partkey", F.col("h").cast("long").alias("citation_count")), "p_partkey", ["citation_count"])


@query("x17_revision_actions", "select l_orderkey, array_to_string(list_slice(list_transform(list_sort(list_transform(list_distinct(a), lambda x: {'p': list_position(a, x), 'x': x})), lambda y: y.x), 1, 12), '|') as actions from (select l_orderkey, list_concat(list(l_returnflag order by l_linenumber, l_partkey), list(cast(l_partkey as varchar) order by l_linenumber, l_partkey)) as a from lineitem group by 1)")
def x17(spark, d):
    each = lambda c, *tie: F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", *tie, F.col(c).cast("string").alias("v")))), lambda x: x["v"])
    one = B.placed(spark, d, "lineitem").groupBy("l_orderkey").agg(each("l_returnflag", "_at").alias("a"), each("l_partkey").alias("b"))
    return one.select("l_orderkey", F.array_join(D.revision_actions(F.array(F.lit("")), F.col("a"), F.col("b")), "|").alias("actions"))


@query("u04_valid_families", f"with {B.HYPEREDGES}, f as (select cast(p_partkey as varchar) as id, 'patterns' as family from part union all select cast(hyperedge_id as varchar), 'hyperedges' from hyperedges union all select cast(s_suppkey as varchar), 'evidence' from supplier union all select cast(n_nationkey as varchar), 'gaps' from nation union all select cast(r_regionkey as varchar), 'operators' from region) select id, min(family) as family from f group by 1")
def u04_families(spark, d):
    t = lambda name, key: B.table(spark, d, name).select(F.col(key).alias("id"))
    return D.valid_references(patterns=t("part", "p_partkey"), hyperedges=B.hyperedges(spark, d).select(F.col("hyperedge_id").alias("id")), evidence=t("supplier", "s_suppkey"), gaps=t("nation", "n_nationkey"), operators=t("region", "r_regionkey"))


@query("w05_final_order", f"with {B.HYPEREDGES} select hyperedge_id, confidence from hyperedges order by hyperedge_type = 'mechanism' desc, paper_key % 5 desc, paper_key % 3 desc, confidence desc, hyperedge_id limit 90")
def w05(spark, d):
    h = B.hyperedges(spark, d).withColumns({"mechanism": (F.col("hyperedge_type") == "mechanism").cast("int"), "relevance": F.col("paper_key") % 5, "support": F.col("paper_key") % 3})
    return D.final_order(h, 90).select("hyperedge_id", "confidence")


@query("x19_section_focus", "with s as (select o_custkey as project_id, o_orderkey as section_key, o_orderpriority as heading, case when o_orderkey % 2 = 0 then 'own' end as own from orders), dims as (select c_custkey as project_id, unnest([1, 2, 3]) as position, unnest(['1-URGENT', 'prefix 2-HIGH suffix', 'MEDIUM']) as dimension from customer), m as (select project_id, section_key, string_agg(dimension, '|' order by position) as found from s join dims using (project_id) where contains(lower(heading), lower(dimension)) or contains(lower(dimension), lower(heading)) group by 1, 2) select project_id, section_key, concat_ws('|', own, found) as focus from s left join m using (project_id, section_key)")
def x19(spark, d):
    k = F.col("o_orderkey")
    sections = B.table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), k.alias("section_key"), F.col("o_orderpriority").alias("heading"), F.when(k % 2 == 0, F.array(F.lit("own"))).alias("focus"))
    dims = B.table(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.posexplode(F.array(F.lit("1-urgent"), F.lit("prefix 2-HIGH suffix"), F.lit("MEDIUM"))).alias("position", "dimension")).withColumn("dimension", F.when(F.col("position") == 0, "1-URGENT").otherwise(F.col("dimension")))
    return D.focus(sections, dims).select("project_id", "section_key", F.array_join("focus", "|").alias("focus"))


@query("r06_convergence", "select l_orderkey, count(*) >= least(5, greatest(1, l_orderkey % 9)) or count(*) >= 2 and sum(case when rn <= 2 then l_linenumber % 2 end) = 0 as ends from (select *, row_number() over (partition by l_orderkey order by l_linenumber desc, l_partkey desc, l_suppkey desc) as rn from lineitem) group by l_orderkey")
def r06(spark, d):
    rounds = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_linenumber"] % 2)
    one = B.table(spark, d, "lineitem").groupBy("l_orderkey").agg(rounds.alias("yields"))
    return one.select("l_orderkey", D.converged(F.col("yields"), (F.col("l_orderkey") % 9).cast("int")).alias("ends"))


# References in texts

@query("t34_numbered_references", "select event_id as doc_id, 'A' || case when event_id % 4 = 0 then '' else '<sup>1' || case when event_id % 3 = 0 then '' else ',2' end || '</sup>' end || ' and ' || case when event_id % 4 = 0 then '<sup>1</sup>' else '<sup>' || case when event_id % 3 = 0 then '2' else '3' end || ',1</sup>' end || '.' as text from events")
def t34(spark, d):
    k = F.col("event_id")
    first = F.when(k % 4 == 0, "[P-0009]").otherwise(F.when(k % 3 == 0, "[P-0001, P-0009]").otherwise("【P-0001；E-0002】"))
    texts = B.table(spark, d, "events").select(k.alias("doc_id"), F.concat(F.lit("A"), first, F.lit(" and "), F.when(k % 4 == 0, "[H-0007-1, P-0009]").otherwise("[H-0007-1,P-0001]"), F.lit(".")).alias("text"))
    index = spark.createDataFrame([("P-0001", "a"), ("E-0002", "b"), ("H-0007-1", "c"), ("H-0007", "a")], "ref string, paper_key string")
    return D.number_references(texts, index)[0]


@query("t34_dangling", "select event_id as doc_id, 'P-0009' as ref from events where event_id % 2 = 0")
def t34_dangling(spark, d):
    texts = B.table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.when(F.col("event_id") % 2 == 0, "x [P-0001, P-0009]").otherwise("y [P-0001]").alias("text"))
    return D.number_references(texts, spark.createDataFrame([("P-0001", "a")], "ref string, paper_key string"))[1]


@query("t33_acs_line", "select p_partkey, '(' || p_size || ') Lovelace, A. K.; van Geel, R.; Löwik, D. W' || case when p_size % 2 = 0 then '.; Solo' else '' end || '. ' || p_name || '.' || case when p_size % 3 = 0 then '' else ' *' || p_brand || '*' end || ' ' || case when p_size % 5 = 0 then 'n.d.' else '1999' end || ', 7, 1-2. https://doi.org/10.1/X' as line from part")
def t33(spark, d):
    s = F.col("p_size")
    names = F.array(F.lit("Lovelace, Ada K."), F.lit("van Geel R"), F.lit("Löwik DW"), F.when(s % 2 == 0, "Solo").otherwise(""))
    line = D.acs_line(s, names, F.concat(F.lit("<i>"), "p_name", F.lit("</i>.")), F.when(s % 3 != 0, F.col("p_brand")), F.when(s % 5 != 0, 1999), F.lit(7), F.lit("1-2"), F.lit("https://doi.org/10.1/X"))
    return B.table(spark, d, "part").select("p_partkey", line.alias("line"))


@query("x27_out_of_range", "select event_id, case event_id % 3 when 0 then '0|6' when 1 then '' else '6|7' end as bad from events")
def x27(spark, d):
    k = F.col("event_id") % 3
    text = F.when(k == 0, "see [6], [0], [3] and [6]").when(k == 1, "see [5] and [1234]").otherwise("[7][6][1]")
    return B.table(spark, d, "events").select("event_id", F.array_join(D.out_of_range(text, F.lit(5)), "|").alias("bad"))


@query("t36_digest", "select o_custkey as project_id, string_agg('[' || n || '] order ' || o_orderkey || ' (' || year(o_orderdate) || ')' || chr(10) || '  - ' || o_orderpriority, chr(10) order by n) as digest from (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders) where n <= 5 group by 1")
def t36(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = B.table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), n.alias("ordinal"), F.concat(F.lit("order "), "o_orderkey").alias("title"), F.year("o_orderdate").alias("year"), F.array("o_orderpriority").alias("facts"))
    return D.digest(rows, "project_id", 5)


# Page lines and text

def _page_lines(spark, d):
    """Lines of a page for each order: a head that repeats, a number, a note, a hyphen across lines, a gap."""
    k = F.col("o_orderkey")
    rows = [(5, F.lit("Journal  Head")), (20, F.concat(F.lit("doi: 10.1234/"), k)), (200, F.concat(F.lit("first "), "o_orderpriority", F.lit(" compo-"))), (212, F.lit("nent")), (300, F.lit(" second  part ")), (960, F.concat(F.lit("- "), k % 1000, F.lit(" -"))), (980, F.when(k % 2 == 0, "journal head").otherwise("Only here"))]
    by_place = F.map_from_arrays(F.array(*[F.lit(float(y)) for y, _ in rows]), F.array(*[t for _, t in rows]))
    pages = B.table(spark, d, "orders").select(k.alias("doc_id"), by_place.alias("m"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("page"))
    return pages.select("doc_id", "page", F.explode("m").alias("y0", "text")).select("doc_id", "page", "y0", (F.col("y0") + 10).alias("y1"), "text", F.lit(0.0).alias("x0"), F.lit(1000.0).alias("page_height"))


@query("t09_line_kinds", "select o_orderkey as doc_id, kind, 2 as n from orders, (values ('running-header'), ('metadata'), ('page-number'), ('running-footer')) v(kind) union all select o_orderkey, 'text', 6 from orders")
def t09(spark, d):
    return P.classify(_page_lines(spark, d)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("t10_paragraphs", "select o_orderkey as doc_id, page, n as paragraph, case n when 0 then 'first ' || o_orderpriority || ' component' else 'second part' end as text from orders, (values (1), (2)) p(page), (values (0), (1)) v(n)")
def t10(spark, d):
    return P.paragraphs(P.classify(_page_lines(spark, d)).filter("kind = 'text'"))


@query("t12_clean_pages", "select o_orderkey as doc_id, 'first ' || o_orderpriority || ' component' || chr(10) || chr(10) || 'second part' || chr(10) || chr(10) || 'first ' || o_orderpriority || ' component' || chr(10) || chr(10) || 'second part' as text from orders")
def t12(spark, d):
    return P.clean(_page_lines(spark, d))


@query("t15_requirement_tokens", "select p_partkey, p_type || '|ynamide-based|区域选择性|' || 'ab' || p_partkey as tokens from (select p_partkey, lower(p_type) as p_type from part)")
def t15(spark, d):
    text = F.concat(F.lit("请写 "), "p_type", F.lit(": the ynamide"), F.lit("_based, 强调区域选择性, 引用不少于3条; please cite Ab"), F.col("p_partkey").cast("string"), F.lit(" 为学术论文的"))
    return B.table(spark, d, "part").select("p_partkey", F.array_join(T.requirement_tokens(F.replace(text, F.lit("_"), F.lit("q"))), "|").alias("tokens")).withColumn("tokens", F.regexp_replace("tokens", "ynamideqbased", "ynamide-based"))


@query("t19_cited_count", "select event_id, case event_id % 6 when 0 then event_id % 200 + 1 when 1 then 7 when 2 then 12 when 3 then 4 else 0 end as n from events")
def t19(spark, d):
    k = F.col("event_id")
    text = F.when(k % 6 == 0, F.concat(F.lit("引用不少于 "), k % 200 + 1, F.lit(" 条"))).when(k % 6 == 1, "至少7篇").when(k % 6 == 2, "Please Cite at least 12 sources").when(k % 6 == 3, "AT LEAST 4").when(k % 6 == 4, "引用 900 条").otherwise("none")
    return B.table(spark, d, "events").select("event_id", T.cited_count(text).alias("n"))


@query("t21_local_codes", "select p_partkey, p_name || ' compound of product' as name, case when p_size % 2 = 0 then p_name || ' oxide' end as alias from part")
def t21(spark, d):
    aliases = F.array(F.lit("5a"), F.lit("Compound 12"), F.when(F.col("p_size") % 2 == 0, F.concat(F.col("p_name"), F.lit(" oxide 3b"))).otherwise("abc"))
    return B.table(spark, d, "part").select("p_partkey", T.strip_local_codes(F.concat("p_name", F.lit("  Compound 5a of product B12"))).alias("name"), T.descriptive_alias(aliases).alias("alias")).withColumn("name", F.replace("name", F.lit("Compound"), F.lit("compound")))


@query("p13_reporting_phrases", "select p_partkey, p_size % 5 < 3 as reports from part")
def p13(spark, d):
    s = F.col("p_size") % 5
    name = F.when(s == 0, F.concat(F.lit("These results of "), "p_name")).when(s == 1, F.concat("p_name", F.lit(" strongly suggests more"))).when(s == 2, "x").when(s == 3, "水").otherwise(F.col("p_name"))
    return B.table(spark, d, "part").select("p_partkey", T.is_reporting_phrase(name).alias("reports"))


@query("p14_local_labels", "select p_partkey, p_size % 4 < 2 as label, p_size % 4 = 2 as reference from part")
def p14(spark, d):
    s = F.col("p_size") % 4
    name = F.when(s == 0, "Compound 5a ").when(s == 1, "(ab12)").when(s == 2, "P-0012-3").otherwise("p_name")
    return B.table(spark, d, "part").select("p_partkey", T.is_local_label(name).alias("label"), T.is_reference_id(name).alias("reference"))


@query("p10_english", "select doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > greatest(20, 2 * length(regexp_replace(text, '[^一-鿿]', '', 'g'))) as english from documents")
def p10(spark, d):
    return _docs(spark, d).select("doc_id", T.looks_english(F.col("text")).alias("english"))


@query("t04_journal_key", "select p_partkey, 'brand ' || p_size || ' of chemistry and physics' as key, 'a b' as venue from part")
def t04(spark, d):
    name = F.concat(F.lit("The Brand#"), F.col("p_size").cast("string"), F.lit(": of Chemistry & Physics (Online) "))
    return B.table(spark, d, "part").select("p_partkey", T.journal_key(name).alias("key"), T.venue_key(F.lit("  A \t B ")).alias("venue"))


@query("t14_evidence_tokens", "select p_partkey, lower(p_name) || '|' || array_to_string(list_filter(list_distinct(string_split(lower(p_name), ' ')), lambda w: false), '') as tokens from part where false union all select p_partkey, 'gold catalysed 2020 of x|gold|catalysed' from part")
def t14(spark, d):
    return B.table(spark, d, "part").select("p_partkey", F.array_join(T.evidence_tokens(F.lit("Gold  catalysed 2020 of x")), "|").alias("tokens"))


@query("t25_span_offset", "select doc_id, case when length(text) > 40 then cast(instr(text, substr(text, 21, 120)) - 1 as int) end as at from documents")
def t25(spark, d):
    span = F.when(F.length("text") > 40, F.substring("text", 21, 300)).otherwise("")
    return _docs(spark, d).select("doc_id", T.span_offset(F.col("text"), span).alias("at"))


@query("t23_slug", "select p_partkey, replace(p_name, ' ', '-') || '-x' as slug from part")
def t23(spark, d):
    return B.table(spark, d, "part").select("p_partkey", T.slug(F.concat(F.lit("-- "), F.upper("p_name"), F.lit(" (x) "))).alias("slug"))


@query("t30_ascii_slug", "select p_partkey, 'nunez' || replace(p_name, ' ', '') || '2' as slug from part")
def t30(spark, d):
    from ..functions import citing as C

    return B.table(spark, d, "part").select("p_partkey", C.ascii_slug(F.concat(F.lit("Núñez "), "p_name", F.lit(" ² 张"))).alias("slug"))


@query("t37_cjk_rows", "select p_partkey, p_size % 3 < 2 as cjk from part")
def t37_rows(spark, d):
    s = F.col("p_size") % 3
    return B.table(spark, d, "part").select("p_partkey", T.has_cjk(F.when(s == 0, F.concat("p_name", F.lit(" 水"))).when(s == 1, "㐂").otherwise(F.col("p_name"))).alias("cjk"))


@query("t11_heading_forms", "select p_partkey, 'Body ' || p_name as body from part")
def t11_forms(spark, d):
    heads = F.array(*[F.lit(h) for h in ("References", "Bibliography", "REFERENCES", "参考 文 献", "References [1] and more")])
    text = F.concat(F.lit("Body "), "p_name", F.lit(" \n\n  "), F.get(heads, F.col("p_size") % 5), F.lit("\n[1] a\nb"))
    return B.table(spark, d, "part").select("p_partkey", T.cut_references(text).alias("body"))


@query("m07_decision", "select p_partkey, case when p_size % 2 = 0 and p_size % 5 < 3 then 'enrich' when p_size % 2 = 0 then 'human' when p_size % 3 = 0 then 'knowledge' when p_size % 3 = 1 then 'flagged' else 'human' end as decision from part")
def m07(spark, d):
    s = F.col("p_size")
    route = F.when(s % 3 == 0, "direct").when(s % 3 == 1, "flagged").otherwise("human")
    return B.table(spark, d, "part").select("p_partkey", S.decision(s % 2 == 1, s % 5, route).alias("decision"))


@query("m08_blend", "select p_partkey, round(0.6 * case when p_size > 40 then 1.0 when p_size > 30 then 0.5 else p_size / 40.0 end + 0.4 * 0.5 * case when p_size % 2 = 0 then 0.85 else 1 end, 6) as confidence, 1 - (p_size % 5) / 4.0 as completeness from part")
def m08(spark, d):
    s = F.col("p_size")
    model = F.when(s > 40, "7.5").when(s > 30, "none").otherwise((s / 40).cast("string"))
    return B.table(spark, d, "part").select("p_partkey", F.round(S.blend(model, F.lit(0.5), s % 2 == 0), 6).alias("confidence"), S.completeness(F.slice(F.array(*[F.lit(x) for x in "abcd"]), 1, s % 5)).alias("completeness"))


@query("n05_condition_rows", "select p_partkey, 'temperature' as key, cast(p_size as varchar) as value_text, cast(p_size as double) as value_num from part union all select p_partkey, 'solvent', 'thf', null from part")
def n05(spark, d):
    rows = H.conditions_of_map(F.create_map(F.lit("temperature"), F.col("p_size").cast("string"), F.lit("solvent"), F.lit("thf")))
    return B.table(spark, d, "part").select("p_partkey", F.explode(rows).alias("c")).select("p_partkey", "c.key", "c.value_text", "c.value_num")


@query("g02_alias_components", "select p_partkey as node_id, min(p_partkey) over (partition by p_name) as component from part")
def g02_aliases(spark, d):
    return G.alias_components(B.table(spark, d, "part").select(F.lit("m").alias("node_type"), F.col("p_partkey").alias("node_id"), F.upper("p_name").alias("name")))


@query("k01_folded_log", "select user_id, arg_max(event_type, event_id) as event_type, arg_max(props, event_id) filter (event_id % 3 = 0) as props from events group by 1")
def k01_folded(spark, d):
    e = B.table(spark, d, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("props"))
    return L.folded(e, "user_id", "event_id", ["props"]).select("user_id", "event_type", "props")
