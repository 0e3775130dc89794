"""From evidence to text: mechanism states, candidate cascades, drafts, gap notices, plans (rows G20, N07, P17, Q08, X14-X16, X18, X23, W12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import study as D

# Limits, kinds, phrases.
STATES, EVIDENCE, PRIMITIVES = 12, 6, 15
TASK_KINDS = ("summary", "generative", "frontier", "evaluation", "proof")
GAP_PHRASES = {
    "papers": "可引用的同主题文献不足", "knowledge": "已入库文献尚未抽取成知识", "conditions": "缺少可量化条件（温度/当量/时间/收率等）",
    "comparison": "缺少可两两比较的同类证据", "requirements": "部分写作要求没有证据支撑", "evidence": "可追溯的证据编号不足",
}
NOTICE = ("> **本节证据缺口（写作时请留意）**", "> - 缺少的证据类型：", "> - 以下内容含**未经本库证据支持的推断或一般性描述**，已用「（推断）」标出，请勿直接作为结论引用。", "> - 判定依据：")
UNTITLED, FINDINGS = "未命名研究内容", "研究发现"


def mechanism_states(items: DataFrame, rules: dict[str, D.Rules], bonds: list[str], mechanism: list[str], conditions: list[str], group: str) -> DataFrame:
    """Each group's states (state_id, activation, intermediate, selectivity, bonds, risks, score, confidence, evidence_ids) of items (hyperedge_id, label, text, evidence_ids).

    An item of which no rule and no bond speaks is no state, nor is one
    without evidence.  Of items with equal activation, intermediate and bonds
    the one with the highest score, then most evidence, then least id stays;
    the first twelve are numbered in that order.
    """
    text = F.concat_ws(" ", "label", "text")
    rows = items.filter(T.strip(F.coalesce("label", F.lit(""))) != "").select(
        group, "hyperedge_id", "label",
        *[D.first_match(text, rules[k]).alias(k) for k in ("activation", "intermediate", "selectivity")],
        D.bond_changes(text, bonds).alias("bonds"), D.all_matches(text, rules["risks"]).alias("risks"), D.mechanistic_score(text, mechanism, conditions, bonds).alias("score"),
        F.slice(F.filter("evidence_ids", T.is_reference_id), 1, EVIDENCE).alias("evidence_ids"),
    )
    told = rows.filter(((F.col("activation") != "") | (F.col("intermediate") != "") | (F.col("selectivity") != "") | (F.size("bonds") > 0)) & (F.size("evidence_ids") > 0))
    order = [F.desc("score"), F.desc(F.size("evidence_ids")), F.asc("hyperedge_id")]
    same = F.row_number().over(Window.partitionBy(group, "activation", "intermediate", "bonds").orderBy(*order))
    kept = told.withColumn("_s", same).filter("_s = 1").withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_n") <= STATES)
    confidence = F.when(F.col("intermediate") != "", 0.5).otherwise(0.35)
    return kept.select(group, F.format_string("MS-%04d", "_n").alias("state_id"), "hyperedge_id", "label", "activation", "intermediate", "selectivity", "bonds", "risks", "score", confidence.alias("confidence"), "evidence_ids")


def primitives(states: DataFrame, operators: D.Rules, group: str) -> DataFrame:
    """Group, op_id, name, state_id: the operators that a group's states speak of; each state gives its first that no state before it gave, as far as names are told by order."""
    blob = F.concat_ws(" ", "activation", "intermediate", "selectivity", "label", F.array_join("bonds", " "))
    named = states.select(group, "state_id", F.posexplode(D.all_matches(blob, operators)).alias("place", "name"))
    first = named.groupBy(group, "name").agg(F.min(F.struct("state_id", "place")).alias("_f"))
    # a state that brings several new names keeps the first of them
    one = first.groupBy(group, F.col("_f.state_id").alias("state_id")).agg(F.min_by("name", "_f.place").alias("name"))
    n = F.row_number().over(Window.partitionBy(group).orderBy("state_id"))
    return one.withColumn("_n", n).filter(F.col("_n") <= PRIMITIVES).select(group, F.format_string("OP-%04d", "_n").alias("op_id"), "name", "state_id")


def cascade(group: str, *layers: DataFrame) -> DataFrame:
    """Each group's rows of the first layer that has any."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("_layer", F.lit(i)) for i, df in enumerate(layers)])
    best = F.min("_layer").over(Window.partitionBy(group))
    return rows.withColumn("_best", best).filter("_layer = _best").drop("_layer", "_best")


def ordinal_ids(rows: DataFrame, group: list[str], order: list[Column], prefix: str) -> DataFrame:
    """Rows with id, such as P-0001, by their rank in a group."""
    return rows.withColumn("id", F.format_string(f"{prefix}-%04d", F.row_number().over(Window.partitionBy(*group).orderBy(*order))))


def pending_matching(papers: DataFrame, log: DataFrame, key: str, event: str, terms: list[str], columns: list[str], order: str, most: int) -> DataFrame:
    """Works without an event whose text holds a term, the newest first."""
    done = log.filter((F.col("event") == event) & F.col(key).isNotNull()).select(key)
    hit = reduce(lambda a, b: a | b, [T.contains_any(F.col(c), terms) for c in columns])
    return papers.join(done, key, "left_anti").filter(hit).orderBy(F.desc(order), key).limit(most)


def normalise_plan(plan: Column, goal: Column) -> Column:
    """A plan (struct of goal, domain, task_kind, max_results, min_confidence, max_rounds, terms) with its defaults and clamps."""
    said = lambda name, other: F.coalesce(F.nullif(F.trim(plan[name]), F.lit("")), other)
    kind = F.lower(F.trim(F.coalesce(plan["task_kind"], F.lit(""))))
    terms = F.slice(D.ordered_union(plan["terms"]), 1, 30)
    domain = said("domain", said("goal", goal))
    return F.struct(
        said("goal", goal).alias("goal"), domain.alias("domain"), F.when(kind.isin(*TASK_KINDS), kind).otherwise("generative").alias("task_kind"),
        F.greatest(F.lit(1), F.coalesce(plan["max_results"].try_cast("int"), F.lit(80))).alias("max_results"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(plan["min_confidence"].try_cast("double"), F.lit(0.6)))).alias("min_confidence"),
        F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(plan["max_rounds"].try_cast("int"), F.lit(2)))).alias("max_rounds"), F.when(F.size(terms) > 0, terms).otherwise(F.array(domain)).alias("terms"),
    )


def gap_notice(unmet: Column, types: Column, detail: Column) -> Column:
    """Q08: the notice of what a section lacks; empty where it lacks nothing."""
    none = F.array().cast("array<string>")
    lacks, kinds = F.coalesce(unmet, none), F.coalesce(types, none)
    phrase = F.create_map(*[F.lit(x) for kv in GAP_PHRASES.items() for x in kv])
    lines = F.array_compact(F.array(
        F.lit(NOTICE[0]),
        F.when(F.size(lacks) > 0, F.concat(F.lit("> - "), F.array_join(F.transform(lacks, lambda d: F.coalesce(phrase[d], d)), "；"))),
        F.when(F.size(kinds) > 0, F.concat(F.lit(NOTICE[1]), F.array_join(kinds, "、"))),
        F.lit(NOTICE[2]),
        F.when(F.coalesce(detail, F.lit("")) != "", F.concat(F.lit(NOTICE[3]), detail)),
    ))
    return F.when((F.size(lacks) == 0) & (F.size(kinds) == 0), "").otherwise(F.array_join(lines, "\n"))


def with_gap_notice(content: Column, notice: Column) -> Column:
    """Q08: a text behind its notice, once."""
    body = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)^\s+", "")
    return F.when((notice == "") | F.contains(F.coalesce(content, F.lit("")), F.lit("本节证据缺口")), content).when(body == "", notice).otherwise(F.concat(notice, F.lit("\n\n"), body))


def render_drafts(drafts: DataFrame, items: DataFrame) -> DataFrame:
    """draft_id, markdown of drafts (draft_id, title, summary) with items (draft_id, section, heading, position, status, text, refs)."""
    said = lambda c, other="": F.coalesce(F.nullif(T.strip(F.col(c)), F.lit("")), F.lit(other))
    refs = F.when(F.coalesce(F.size("refs"), F.lit(0)) > 0, F.concat(F.lit(" ["), F.array_join("refs", ", "), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("- ["), said("status", "supported"), F.lit("] "), said("text"), refs)
    parts = items.groupBy("draft_id", "section").agg(F.min(said("heading", FINDINGS)).alias("h"), F.array_sort(F.collect_list(F.when(said("text") != "", F.struct("position", line.alias("l"))))).alias("ls"))
    block = F.concat(F.lit("\n\n## "), F.col("h"), F.array_join(F.transform("ls", lambda x: F.concat(F.lit("\n"), x["l"])), ""))
    body = parts.groupBy("draft_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", block.alias("b")))), lambda x: x["b"]), "").alias("_b"))
    head = F.concat(F.lit("# "), said("title", UNTITLED), F.when(said("summary") != "", F.concat(F.lit("\n\n"), said("summary"))).otherwise(""))
    return drafts.join(body, "draft_id", "left").select("draft_id", F.concat(head, F.coalesce("_b", F.lit(""))).alias("markdown"))


def referenced_only(knowledge: DataFrame, items: DataFrame) -> DataFrame:
    """draft_id and the knowledge (id, ...) that a draft's items refer to."""
    used = items.select("draft_id", F.explode("refs").alias("id")).distinct()
    return used.join(knowledge, "id")


def fallback_options(sections: DataFrame, angles: list[tuple[str, str]]) -> DataFrame:
    """section_id, option, angle, summary: a text for each angle (name, description) and section (section_id, focus), naming the first three points of focus."""
    points = F.slice(D.ordered_union(F.col("focus")), 1, 3)
    text = F.when(F.size(points) > 0, F.array_join(points, "、")).otherwise("核心内容")
    each = F.explode(F.array(*[F.struct(F.lit("ABC"[i]).alias("option"), F.lit(name).alias("angle"), F.lit(what).alias("what")) for i, (name, what) in enumerate(angles)])).alias("a")
    rows = sections.select("section_id", text.alias("_t"), each)
    return rows.select("section_id", "a.option", "a.angle", F.concat(F.lit("（未调用模型，按通用方向生成）以「"), "a.angle", F.lit("」为侧重："), "a.what", F.lit("。覆盖要点："), "_t", F.lit("。")).alias("summary"))
