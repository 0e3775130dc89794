"""The verdicts on sections over the test tables: parts as papers, order lines as hyperedges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sufficiency as S
from . import bindings as B
from .registry import query

SECTIONS = [
    S.Section("open", tokens=("bolt", "small"), requirements=("bolts", "zebra", "x", "rings")),
    S.Section("templated", tokens=("GEAR",), cited=2, rounds_done=2, template=True, required=("papers", "comparison", "conditions"), weights={"papers": 0.5, "comparison": 0.25, "conditions": 0.25}),
    S.Section("empty", requirements=("绿色", "zebra"), rounds_done=2),
    S.Section("unmet", tokens=("no such thing",), rounds_done=1),
]


def tables(spark, d):
    part, line = B.table(spark, d, "part"), B.table(spark, d, "lineitem")
    k = F.col("p_partkey")
    return {
        "papers": part.select(k.alias("paper_key"), F.when(F.col("p_size") % 2 == 0, "ingested").otherwise("pending").alias("status"), F.col("p_name").alias("title"), F.col("p_type").alias("abstract"), F.lit(None).cast("string").alias("keywords")),
        "quality": part.filter("p_size % 3 = 0").select(k.alias("paper_key"), F.when(F.col("p_size") % 9 == 0, "human").otherwise("flagged").alias("decision")),
        "log": part.select(k.alias("paper_key"), F.when(k % 3 != 0, "extracted").otherwise("read").alias("event")),
        "hyperedges": line.select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("hyperedge_id"), F.col("l_returnflag").alias("hyperedge_type"), F.col("l_partkey").alias("paper_key")),
        "conditions": line.filter("l_linestatus = 'O'").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("hyperedge_id")),
        "measurements": line.filter("l_linenumber = 1").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("hyperedge_id")),
        "edges": B.edges(spark, d),
        "texts": part.select(F.col("p_name").alias("text")),
        "names": B.table(spark, d, "supplier").select(F.col("s_name").alias("name")),
    }


@query(
    "m13_sections",
    """with p as (select p_partkey as k, lower(p_name || ' ' || p_type) as t from part where p_size % 2 = 0 or (p_size % 3 = 0 and p_size % 9 <> 0)),
 m as (select 'open' as section, k from p where contains(t, 'bolt') or contains(t, 'small') union all select 'templated', k from p where contains(t, 'gear')),
 a as (select section, count(*) as matched, count(*) filter (k % 3 <> 0) as extracted from m group by 1),
 f as (select section, count(*) as hyperedges, count(*) filter (l_linestatus = 'O' or l_linenumber = 1) as quantified from lineitem join m on l_partkey = k group by 1),
 s(section, min_papers, covered, missing, unverifiable, rounds_done) as (values ('open', 6, 2, 1, 0, 0), ('templated', 3, 0, 0, 0, 2), ('empty', 6, 0, 1, 1, 2), ('unmet', 6, 0, 0, 0, 1)),
 c as (select s.*, coalesce(matched, 0) as matched, coalesce(extracted, 0) as extracted, coalesce(hyperedges, 0) as hyperedges, coalesce(quantified, 0) as quantified from s left join a using (section) left join f using (section)),
 d as (select *, round(least(1.0, matched / min_papers), 3) as papers, round(coalesce(extracted / nullif(matched, 0), 0), 3) as knowledge, coalesce(quantified / nullif(hyperedges, 0), 0) as q, case when covered + missing = 0 then 1.0 else round(covered / (covered + missing), 3) end as requirements from c),
 w as (select *, round(q, 3) as conditions, list_filter([
   case when section in ('open', 'templated', 'unmet') and matched < min_papers then 'papers' end, case when section = 'open' and extracted < 0.6 * matched then 'knowledge' end,
   case when section in ('open', 'templated') and q < 0.3 then 'conditions' end, case when section in ('open', 'empty') and covered < 0.5 * (covered + missing) then 'requirements' end], lambda x: x is not null) as failed from d),
 v as (select *, round(case section when 'templated' then 0.5 * papers + 0.25 + 0.25 * conditions else (0.3 * papers + 0.25 * knowledge + 0.2 * conditions + 0.15 * requirements + 0.1 + 0.05) / 1.05 end, 3) as mean from w),
 z as (select *, case when len(failed) > 0 then least(mean, 0.619) else mean end as confidence from v)
 select section, matched, extracted, hyperedges, quantified, covered, missing, unverifiable, papers, knowledge, conditions, requirements, array_to_string(failed, ',') as failed, confidence, case when confidence >= 0.62 then 'sufficient' when rounds_done >= 2 then 'exhausted' else 'insufficient' end as decision from z""",
)
def m13_sections(spark, d):
    out = S.evaluate(tables(spark, d), SECTIONS)
    return out.select("section", "matched", "extracted", "hyperedges", "quantified", "covered", "missing", "unverifiable", "papers", "knowledge", "conditions", "requirements", F.array_join("failed", ",").alias("failed"), "confidence", "decision")
