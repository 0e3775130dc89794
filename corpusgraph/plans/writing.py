"""Queries of mechanism states, drafts, plans and of the stores that keep the last row of a key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import library as L
from ..operators import study as D
from ..operators import surface as U
from ..operators import views
from ..operators import writing as W
from . import bindings as B
from .registry import query

_RULES = {"activation": [("red light", ["red"]), ("blue light", ["blue"])], "intermediate": [("small", ["small"])], "selectivity": [("ring", ["ring"])], "risks": [("bolt risk", ["bolt"]), ("gear risk", ["gear"])]}


def _items(spark, d):
    p = B.table(spark, d, "part")
    ids = F.when(F.col("p_size") % 5 == 0, F.array(F.lit("prose"))).otherwise(F.array(F.format_string("H-%04d", F.col("p_partkey") % 10000), F.lit("prose")))
    return p.select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("hyperedge_id"), F.col("p_name").alias("label"), F.when(F.col("p_size") % 2 == 0, "C-N bond").otherwise("").alias("text"), ids.alias("evidence_ids"))


_STATES = """s as (select p_brand as grp, p_partkey as hyperedge_id, case when contains(p_name, 'red') then 'red light' when contains(p_name, 'blue') then 'blue light' else '' end as activation, case when contains(p_name, 'small') then 'small' else '' end as intermediate, case when contains(p_name, 'ring') then 'ring' else '' end as selectivity, p_size % 2 = 0 as bond, 3 * contains(p_name, 'large')::int + 2 * contains(p_name, 'gear')::int + (p_size % 2 = 0)::int as score from part where p_size % 5 <> 0),
 k as (select *, row_number() over (partition by grp, activation, intermediate, bond order by score desc, hyperedge_id) as same from s where activation <> '' or intermediate <> '' or selectivity <> '' or bond), r as (select *, row_number() over (partition by grp order by score desc, hyperedge_id) as n from k where same = 1)"""


def _states(spark, d):
    return W.mechanism_states(_items(spark, d), _RULES, ["c-n"], ["large"], ["gear"], "grp")


@query("g20_mechanism_states", f"with {_STATES} select grp, printf('MS-%04d', n) as state_id, hyperedge_id, activation, intermediate, cast(case when intermediate <> '' then 0.5 else 0.35 end as double) as confidence, score from r where n <= 12")
def g20(spark, d):
    return _states(spark, d).select("grp", "state_id", "hyperedge_id", "activation", "intermediate", "confidence", "score")


@query("g20_primitives", f"with {_STATES}, t as (select grp, n, p_name || ' ' || activation as blob from r join part on p_partkey = hyperedge_id where n <= 12), m as (select grp, n, name, place from (select grp, n, unnest(['redden', 'shrink', 'turn']) as name, unnest([0, 1, 2]) as place, unnest([contains(blob, 'red'), contains(blob, 'small'), contains(blob, 'gear')]) as hit from t) where hit), f as (select grp, name, min(n * 10 + place) as f from m group by 1, 2), o as (select grp, f // 10 as n, arg_min(name, f) as name from f group by 1, 2) select grp, printf('OP-%04d', row_number() over (partition by grp order by n)) as op_id, name, printf('MS-%04d', cast(n as int)) as state_id from o")
def g20_primitives(spark, d):
    return W.primitives(_states(spark, d), [("redden", ["red"]), ("shrink", ["small"]), ("turn", ["gear"])], "grp")


@query("x15_cascade", "select p_brand, p_partkey from (select *, case when p_size < 3 then 0 when p_size < 6 then 1 else 2 end as layer, min(case when p_size < 3 then 0 when p_size < 6 then 1 else 2 end) over (partition by p_brand) as best from part) where layer = best")
def x15(spark, d):
    p = B.table(spark, d, "part").select("p_brand", "p_partkey", "p_size")
    return W.cascade("p_brand", p.filter("p_size < 3"), p.filter("p_size between 3 and 5"), p.filter("p_size > 5")).select("p_brand", "p_partkey")


@query("w12_ordinal_ids", "select p_partkey, printf('E-%04d', row_number() over (partition by p_brand order by p_size desc, p_partkey)) as id from part")
def w12(spark, d):
    return W.ordinal_ids(B.table(spark, d, "part"), ["p_brand"], [F.desc("p_size"), F.asc("p_partkey")], "E").select("p_partkey", "id")


@query("p17_pending_matching", "select doc_id from documents where not exists (select 1 from events where event_type = 'purchase' and user_id = doc_id) and (contains(lower(text), 'ment') or contains(lower(source), 'src1')) order by n_chars desc, doc_id limit 200")
def p17(spark, d):
    log = B.log(spark, d).withColumnRenamed("paper_id", "doc_id")
    return W.pending_matching(B.table(spark, d, "documents"), log, "doc_id", "purchase", ["ment", "SRC1"], ["text", "source"], "n_chars", 200).select("doc_id")


@query("p18_missing_keys", "select s_suppkey as node_id from supplier where s_suppkey not in (select l_suppkey from lineitem where l_quantity >= 49 and l_suppkey % 3 = 0)")
def p18(spark, d):
    from ..operators import audits as A

    seen = B.table(spark, d, "lineitem").filter("l_quantity >= 49 and l_suppkey % 3 = 0").select(F.col("l_suppkey").alias("node_id"))
    return A.holding(B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id")), "node_id", without=[seen])


@query("n07_plan", "select p_partkey, p_name as goal, case when p_size % 2 = 0 then p_type else p_name end as domain, case when p_size % 3 = 0 then 'frontier' else 'generative' end as task_kind, case when p_size % 4 = 0 then 80 else greatest(1, p_size - 20) end as max_results, least(5, greatest(1, p_size % 9)) as max_rounds, case when p_size % 5 = 0 then p_brand when p_size % 2 = 0 then p_type else p_name end as terms from part")
def n07(spark, d):
    s = F.col("p_size")
    plan = F.struct(F.lit(" ").alias("goal"), F.when(s % 2 == 0, F.col("p_type")).alias("domain"), F.when(s % 3 == 0, " Frontier").otherwise("odd").alias("task_kind"), F.when(s % 4 == 0, "many").otherwise((s - 20).cast("string")).alias("max_results"), F.lit(None).cast("string").alias("min_confidence"), (s % 9).cast("string").alias("max_rounds"), F.when(s % 5 == 0, F.array(F.lit(""), F.col("p_brand"), F.col("p_brand"))).alias("terms"))
    rows = B.table(spark, d, "part").select("p_partkey", W.normalise_plan(plan, F.col("p_name")).alias("x"))
    return rows.select("p_partkey", "x.goal", "x.domain", "x.task_kind", "x.max_results", "x.max_rounds", F.array_join("x.terms", "|").alias("terms"))


_NOTE = "'> **本节证据缺口（写作时请留意）**' || chr(10) || '> - 可引用的同主题文献不足；other' || chr(10) || '> - 以下内容含**未经本库证据支持的推断或一般性描述**，已用「（推断）」标出，请勿直接作为结论引用。'"


@query("q08_gap_notice", f"select p_partkey, case p_size % 3 when 0 then p_name when 1 then {_NOTE} || chr(10) || chr(10) || p_name else '本节证据缺口 ' || p_name end as content from part")
def q08(spark, d):
    s = F.col("p_size") % 3
    notice = W.gap_notice(F.when(s != 0, F.array(F.lit("papers"), F.lit("other"))), F.lit(None).cast("array<string>"), F.lit(""))
    text = F.when(s == 2, F.concat(F.lit("本节证据缺口 "), "p_name")).when(s == 1, F.concat(F.lit("\n "), "p_name")).otherwise(F.col("p_name"))
    return B.table(spark, d, "part").select("p_partkey", W.with_gap_notice(text, notice).alias("content"))


@query("x16_render_drafts", "with l as (select l_orderkey, l_returnflag, string_agg('- [' || case when l_linenumber % 2 = 0 then 'supported' else 'hypothesis' end || '] item ' || l_partkey || case when l_linenumber % 2 = 0 then ' [P-0001, ' || l_suppkey || ']' else '' end, chr(10) order by l_linenumber, l_partkey, l_suppkey) as ls from lineitem group by 1, 2) select o_orderkey as draft_id, '# ' || case when o_orderkey % 2 = 0 then 'Order ' || o_orderkey else '未命名研究内容' end || coalesce(string_agg(chr(10) || chr(10) || '## ' || l_returnflag || chr(10) || ls, '' order by l_returnflag), '') as markdown from orders left join l on l_orderkey = o_orderkey group by o_orderkey")
def x16(spark, d):
    k, even = F.col("o_orderkey"), F.col("l_linenumber") % 2 == 0
    drafts = B.table(spark, d, "orders").select(k.alias("draft_id"), F.when(k % 2 == 0, F.concat(F.lit("Order "), k)).alias("title"), F.lit(" ").alias("summary"))
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    items = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("draft_id"), F.col("l_returnflag").alias("section"), F.col("l_returnflag").alias("heading"), place.alias("position"), F.when(even, " ").otherwise("hypothesis").alias("status"), F.concat(F.lit("item "), "l_partkey").alias("text"), F.when(even, F.array(F.lit("P-0001"), F.col("l_suppkey").cast("string"))).alias("refs"))
    return W.render_drafts(drafts, items)


@query("x18_referenced_only", "select distinct l_orderkey as draft_id, s_suppkey as id, s_name from lineitem join supplier on s_suppkey = l_suppkey where l_linenumber % 2 = 0")
def x18(spark, d):
    items = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("draft_id"), F.when(F.col("l_linenumber") % 2 == 0, F.array("l_suppkey")).alias("refs"))
    return W.referenced_only(B.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_name"), items).select("draft_id", "id", "s_name")


@query("x23_fallback_options", "select p_partkey as section_id, option, angle, '（未调用模型，按通用方向生成）以「' || angle || '」为侧重：' || what || '。覆盖要点：' || case when p_size % 2 = 0 then p_type || '、' || p_brand else '核心内容' end || '。' as summary from part, (values ('A', 'first', 'one'), ('B', 'second', 'two')) v(option, angle, what)")
def x23(spark, d):
    sections = B.table(spark, d, "part").select(F.col("p_partkey").alias("section_id"), F.when(F.col("p_size") % 2 == 0, F.array("p_type", F.lit(" "), "p_brand", "p_type")).alias("focus"))
    return W.fallback_options(sections, [("first", "one"), ("second", "two")])


@query("k03_rounds", "select user_id as run_id, cast(json_extract(props, '$.k') as bigint) % 5 as round, arg_max(event_type, event_id) as payload from events group by 1, 2")
def k03(spark, d):
    rounds = B.table(spark, d, "events").select(F.col("user_id").alias("run_id"), (F.get_json_object("props", "$.k").cast("long") % 5).alias("round"), "event_id", F.col("event_type").alias("payload"))
    return L.latest(rounds, ["run_id", "round"], ["event_id"]).select("run_id", "round", "payload")


@query("k02_quality_upsert", "select o_custkey as paper_key, arg_max(o_totalprice, o_orderkey) as quality, arg_max(o_orderstatus, o_orderkey) as decision from orders group by 1")
def k02(spark, d):
    new = B.table(spark, d, "orders").select(F.col("o_custkey").alias("paper_key"), F.col("o_totalprice").alias("quality"), F.col("o_orderstatus").alias("decision"), F.col("o_orderkey").alias("seq"))
    old, fresh = (L.latest(df, ["paper_key"], ["seq"]) for df in (new.filter("seq % 2 = 0"), new))
    return L.upsert(old, fresh, "paper_key", []).select("paper_key", "quality", "decision")


@query("k09_section_save", "select p_brand as project_id, p_type as section_key, arg_max(p_name, p_partkey) as content, arg_max(p_name, p_partkey) filter (p_size % 3 = 0) as grounding from part group by 1, 2")
def k09(spark, d):
    p = B.table(spark, d, "part").select(F.struct("p_brand", "p_type").alias("key"), F.col("p_partkey").alias("seq"), F.col("p_name").alias("content"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).alias("grounding"))
    return L.folded(p, "key", "seq", ["grounding"]).select(F.col("key.p_brand").alias("project_id"), F.col("key.p_type").alias("section_key"), "content", "grounding")


@query("a14_channels", f"with {B.NODES}, {B.HYPEREDGES}, {B.MEMBERS}, shape as (select hyperedge_id, string_agg(role || ':' || node_type, ',' order by role || ':' || node_type) as role_profile from members join nodes using (node_id) group by 1) select hyperedge_type, role_profile, support_count from (select hyperedge_type, role_profile, count(*) as support_count from hyperedges join shape using (hyperedge_id) group by 1, 2) order by support_count desc, hyperedge_type, role_profile limit 30")
def a14_channels(spark, d):
    held = views.channel_members(B.hyperedges(spark, d), B.members(spark, d), B.nodes(spark, d)).filter("size(signature) > 0")
    found = held.groupBy(F.col("relation_family").alias("hyperedge_type"), F.array_join("signature", ",").alias("role_profile")).agg(F.count("*").alias("support_count"), F.count_distinct("paper_key").alias("paper_count")).withColumn("confidence", F.lit(0.5))
    return U.top_channels(found, 30).select("hyperedge_type", "role_profile", "support_count")


@query("u02_ordered_union", "select p_partkey, p_type || '|' || p_brand || case when p_size % 2 = 0 then '|' || p_name else '' end as terms from part")
def u02(spark, d):
    lists = D.ordered_union(F.array("p_type", F.lit("")), F.lit(None).cast("array<string>"), F.array("p_brand", "p_type"), F.when(F.col("p_size") % 2 == 0, F.array("p_name", "p_brand")))
    return B.table(spark, d, "part").select("p_partkey", F.array_join(lists, "|").alias("terms"))
