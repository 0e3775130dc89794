"""What a user of the library asks: searches, counts, details, reviews, events and projects (rows P, J, A, K, W, X)."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .library import latest, like_any, page, year_filter

# Events, columns, levels and review decisions.
GATE, EXTRACTED, LOW_SIGNAL = "relevance-gate-low-signal", "extracted", "low_signal"
SEARCHED = ["title", "abstract", "venue", "doi", "paper_key"]
LEVELS = {"DEBUG": 10, "INFO": 20, "WARN": 30, "ERROR": 40}
#: action: decision, whether a second look is needed, status, label
REVIEW_PRESETS = {
    "accept": ("knowledge", False, "ingested", "通过并进入知识提取"),
    "accept_flagged": ("flagged", True, "ingested", "标记后进入知识提取"),
    "enrich": ("enrich", False, "needs_enrich", "退回元数据补全"),
    "reject": ("rejected", False, "rejected", "拒绝并排除该文献"),
}
REVIEW_STATUS = {"knowledge": "ingested", "flagged": "ingested", "enrich": "needs_enrich", "rejected": "rejected", "human": "human_review"}
PASSED = ("knowledge", "flagged", "direct")


def search(papers: DataFrame, quality: DataFrame, log: DataFrame, q: str = "", equal: dict[str, str] | None = None, decision: str | None = None, years: tuple[int | None, int | None] = (None, None), unknown_year: bool = False, low_signal: bool | None = None, has_knowledge: bool | None = None, holding: dict[str, DataFrame] | None = None) -> DataFrame:
    """Papers that meet all conditions, once each, with quality and decision; texts are left out.

    ``equal`` compares columns, ``holding`` keeps keys that each of its frames
    has (tags, folders, favourites).  A log may hold several rows of a paper;
    they are asked whether one exists, so no row is multiplied.  A paper counts
    as not of low signal where it has no gate row, or one that does not say so.
    """
    rated = papers.drop("clean_text").join(quality.select("paper_key", "quality", "decision", "needs_review"), "paper_key", "left")
    keep = [F.lit(True)]
    if q.strip():
        keep.append(like_any(q.strip(), [c for c in SEARCHED if c in papers.columns]))
    keep += [F.col(c) == v for c, v in (equal or {}).items() if v]
    if decision:
        keep.append(F.col("decision") == decision)
    keep.append(year_filter(F.col("pub_year"), *years, unknown=unknown_year))
    out = rated.filter(reduce(and_, keep))
    gate = log.filter((F.col("event") == GATE) & F.col("paper_key").isNotNull())
    said = F.coalesce(F.col("details").contains(LOW_SIGNAL), F.lit(False))
    if low_signal:
        out = out.join(gate.filter(said).select("paper_key"), "paper_key", "left_semi")
    elif low_signal is not None:
        told = gate.groupBy("paper_key").agg(F.bool_and(said).alias("_only"))
        out = out.join(told.filter("_only").select("paper_key"), "paper_key", "left_anti")
    if has_knowledge is not None:
        done = log.filter((F.col("event") == EXTRACTED) & F.col("paper_key").isNotNull()).select("paper_key")
        out = out.join(done, "paper_key", "left_semi" if has_knowledge else "left_anti")
    for keys in (holding or {}).values():
        out = out.join(keys.select("paper_key"), "paper_key", "left_semi")
    return out


def year_facets(papers: DataFrame) -> DataFrame:
    """Least and greatest year, and how many works have none."""
    return papers.agg(F.min("pub_year").alias("year_min"), F.max("pub_year").alias("year_max"), F.count_if(F.col("pub_year").isNull()).alias("year_unknown"))


def _named(df: DataFrame, **counts: Column) -> DataFrame:
    """One row (name, n) for each count, in one scan."""
    one = df.agg(*[c.alias(k) for k, c in counts.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("long").alias("n")) for k in counts])).alias("x")).select("x.name", "x.n")


def library_stats(papers: DataFrame, quality: DataFrame, log: DataFrame, tags: DataFrame, folders: DataFrame, favorites: DataFrame) -> DataFrame:
    """The eleven counts of a library as (name, n)."""
    fulltext, event = F.col("fulltext_source"), F.col("event")
    parts = [
        _named(papers, papers=F.count("*"), with_fulltext=F.count_if(fulltext.isin("pdf", "xml")), abstract_only=F.count_if(fulltext == "abstract"), unknown_year=F.count_if(F.col("pub_year").isNull())),
        _named(favorites, favorites=F.count("*")),
        _named(tags, tags=F.count_distinct("tag")),
        _named(folders, folders=F.count("*")),
        _named(quality, assessed=F.count("*"), needs_review=F.count_if(F.col("needs_review"))),
        _named(log, extracted=F.count_distinct(F.when(event == EXTRACTED, F.col("paper_key"))), low_signal=F.count_if(event == GATE)),
    ]
    return reduce(DataFrame.unionByName, parts)


def status_counts(papers: DataFrame, quality: DataFrame, log: DataFrame) -> DataFrame:
    """Counters of disjoint states, a work counting once, as (name, n)."""
    status = F.col("status")
    return reduce(DataFrame.unionByName, [
        _named(papers, papers=F.count("*"), ingested=F.count_if(status == "ingested"), human_review=F.count_if(status == "human_review"), rejected=F.count_if(status == "quality_rejected")),
        _named(quality, passed=F.count_distinct(F.when(F.col("decision").isin(*PASSED), F.col("paper_key")))),
        _named(log, extracted=F.count_distinct(F.when(F.col("event") == EXTRACTED, F.col("paper_key")))),
    ])


def average_quality(quality: DataFrame) -> DataFrame:
    """The mean quality to three decimals; 0 where nothing is assessed."""
    return quality.agg(F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 3).alias("avg_score"))


def tag_counts(tags: DataFrame) -> DataFrame:
    """Works of each tag."""
    return tags.groupBy("tag").agg(F.count_distinct("paper_key").alias("n"))


def folder_counts(folders: DataFrame, placed: DataFrame) -> DataFrame:
    """Works of each folder, empty ones too."""
    return folders.join(placed.groupBy("folder_id").agg(F.count("*").alias("n")), "folder_id", "left").fillna(0, ["n"])


def details(papers: DataFrame, quality: DataFrame, log: DataFrame, runs: DataFrame, preview: int = 12000, most: int = 100) -> DataFrame:
    """Each work with its text's preview and length, quality, latest run and last log rows."""
    near = Window.partitionBy("paper_key").orderBy(F.desc("id"))
    last = log.filter(F.col("paper_key").isNotNull()).withColumn("_n", F.row_number().over(near)).filter(F.col("_n") <= most)
    logs = last.groupBy("paper_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "node", "event", "details", "ts"))), lambda x: x.dropFields("_n")).alias("logs"))
    run = latest(runs, ["paper_key"], ["ts", "id"]).select("paper_key", F.struct(*[c for c in runs.columns if c != "paper_key"]).alias("run"))
    text = F.coalesce("clean_text", F.lit(""))
    shown = papers.select(*[c for c in papers.columns if c != "clean_text"], F.substring(text, 1, preview).alias("clean_preview"), F.length(text).alias("clean_chars"))
    rated = quality.select("paper_key", F.struct(*[c for c in quality.columns if c != "paper_key"]).alias("quality"))
    return shown.join(rated, "paper_key", "left").join(run, "paper_key", "left").join(logs, "paper_key", "left").withColumn("n_logs", F.coalesce(F.size("logs"), F.lit(0)))


def review_queue(papers: DataFrame, quality: DataFrame, preview: int = 1800) -> DataFrame:
    """Works that wait for a person, the newest first, with the start of their text and their assessment."""
    waiting = papers.filter("status = 'human_review'").withColumn("clean_preview", F.substring(F.coalesce("clean_text", F.lit("")), 1, preview)).drop("clean_text")
    return waiting.join(quality, "paper_key", "left").orderBy(F.desc("created_at"), "paper_key")


def review_history(reviews: DataFrame, papers: DataFrame, most: int = 200) -> DataFrame:
    """The last reviews, with what is known of their works."""
    return reviews.orderBy(F.desc("id")).limit(most).join(papers.select("paper_key", "title", "source", "pub_year"), "paper_key", "left")


def submit_reviews(reviews: DataFrame, quality: DataFrame) -> DataFrame:
    """What reviews (paper_key, action, decision, needs_review, rationale) decide: paper_key, decision, needs_review, status, rationale; unknown actions decide nothing.

    A preset decides by itself; "custom" takes its own decision, "human" where
    that is unknown.  The rationale falls back to the assessment's, then to
    the action's label.
    """
    by_action = lambda i: F.element_at(F.create_map(*[x for k, v in REVIEW_PRESETS.items() for x in (F.lit(k), F.lit(v[i]))]), F.col("action"))
    own = F.lower(F.trim(F.coalesce(F.nullif("decision", F.lit("")), F.lit("human"))))
    own = F.when(own.isin(*REVIEW_STATUS), own).otherwise("human")
    custom = F.col("action") == "custom"
    decided = reviews.filter(F.col("action").isin(*REVIEW_PRESETS, "custom")).select(
        "paper_key",
        F.when(custom, own).otherwise(by_action(0)).alias("decision"),
        F.when(custom, F.coalesce("needs_review", own == "flagged")).otherwise(by_action(1)).alias("needs_review"),
        F.when(custom, F.element_at(F.create_map(*[F.lit(x) for kv in REVIEW_STATUS.items() for x in kv]), own)).otherwise(by_action(2)).alias("status"),
        F.nullif(F.trim("rationale"), F.lit("")).alias("_own"),
        F.when(custom, F.concat(F.lit("自定义: "), own)).otherwise(by_action(3)).alias("_action"),
    )
    before = quality.select("paper_key", F.nullif("rationale", F.lit("")).alias("_before"))
    return decided.join(before, "paper_key", "left").select("paper_key", "decision", "needs_review", "status", F.coalesce("_own", "_before", "_action").alias("rationale"))


def stage_counts(log: DataFrame, node: str | None = None) -> DataFrame:
    """Events and works of each node, or of one."""
    rows = log if node is None else log.filter(F.col("node") == node)
    return rows.groupBy("node").agg(F.count("*").alias("n"), F.count_distinct("paper_key").alias("papers"), F.max("ts").alias("last_ts"))


def activity(log: DataFrame, event: str = "", text: str = "", node: str = "", most: int = 100) -> DataFrame:
    """The last log rows of an event and node that a text occurs in."""
    keep = [F.lit(True)]
    keep += [F.col("event") == event] if event else []
    keep += [F.col("node") == node] if node else []
    keep += [like_any(text, ["details", "paper_key"])] if text else []
    return log.filter(reduce(and_, keep)).orderBy(F.desc("ts"), F.desc("id")).limit(most)


def events(log: DataFrame, prefixes: str = "", level: str = "", node: str = "", trace: str = "") -> DataFrame:
    """Events whose name begins with one of the prefixes (comma-separated), of a level and above, of a node and trace."""
    starts = [p.strip() for p in prefixes.split(",") if p.strip()]
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("level")), F.lit(0))
    keep = [F.lit(True)]
    keep += [reduce(or_, [F.coalesce(F.col("event").startswith(p), F.lit(False)) for p in starts])] if starts else []
    keep += [rank >= LEVELS[level.upper()]] if LEVELS.get(level.upper()) else []
    keep += [F.col(c) == v for c, v in (("node", node), ("trace", trace)) if v]
    return log.filter(reduce(and_, keep))


def recent_events(log: DataFrame, most: int) -> DataFrame:
    """The last rows of the log, with details decoded; what is no JSON is null."""
    return log.orderBy(F.desc("id")).limit(most).withColumn("details", F.try_parse_json("details"))


def dispatches_for(runs: DataFrame, node: str, most: int = 30) -> DataFrame:
    """The last runs of which a step is a node's."""
    return runs.orderBy(F.desc("started_at"), F.desc("dispatch_id")).limit(most).filter(F.exists("steps", lambda s: s["node"] == node))


def node_filter(nodes: DataFrame, least: float = 0.0, types: list[str] | None = None, query: str = "", members: DataFrame | None = None) -> DataFrame:
    """Nodes of a confidence, of types, with a text in their name, of a domain's members."""
    keep = [F.lit(True)]
    keep += [F.col("confidence") >= least] if least > 0 else []
    keep += [F.col("node_type").isin(types)] if types else []
    keep += [like_any(query, ["name"])] if query else []
    out = nodes.filter(reduce(and_, keep))
    return out if members is None else out.join(members.select("node_id"), "node_id", "left_semi")


def domain_counts(domains: DataFrame, members: DataFrame, most: int = 100) -> DataFrame:
    """The domains with most members; those without any count 0."""
    n = members.groupBy("domain_key").agg(F.count("*").alias("member_count"))
    return domains.join(n, "domain_key", "left").fillna(0, ["member_count"]).orderBy(F.desc("member_count"), "domain_key").limit(most)


def top_channels(channels: DataFrame, most: int = 300) -> DataFrame:
    """The channels with most support."""
    return channels.orderBy(F.desc("support_count"), F.desc("confidence"), "hyperedge_type", "role_profile").limit(most)


def type_maps(**tables: tuple[DataFrame, str]) -> DataFrame:
    """(kind, name, n) by value of a column for each table, in one frame."""
    parts = [df.groupBy(F.lit(kind).alias("kind"), F.col(c).alias("name")).agg(F.count("*").alias("n")) for kind, (df, c) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def sizes(**tables: DataFrame) -> DataFrame:
    """(name, n) rows of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.lit(k).alias("name"), F.count("*").alias("n")) for k, df in tables.items()])


def relation_counts(edges: DataFrame, generic: list[str]) -> DataFrame:
    """How often each fallback relation is used."""
    return edges.filter(F.col("relation_type").isin(generic)).groupBy("relation_type").agg(F.count("*").alias("n"))


def experiments(hyperedges: DataFrame, conditions: DataFrame, measurements: DataFrame) -> DataFrame:
    """Hyperedges with a condition or a measurement, and how many of either."""
    count = lambda df, c: df.groupBy("hyperedge_id").agg(F.count("*").alias(c))
    both = hyperedges.join(count(conditions, "n_conditions"), "hyperedge_id", "left").join(count(measurements, "n_measurements"), "hyperedge_id", "left").fillna(0, ["n_conditions", "n_measurements"])
    name = F.coalesce(F.nullif("label", F.lit("")), F.concat(F.lit("超边 "), F.col("hyperedge_id").cast("string")))
    return both.filter("n_conditions > 0 or n_measurements > 0").select("hyperedge_id", name.alias("experiment_name"), "hyperedge_type", "paper_key", "n_conditions", "n_measurements")


def recommend_materials(hyperedges: DataFrame, papers: DataFrame, q: str, most: int = 10) -> DataFrame:
    """Hyperedges whose label, or whose work's title, holds a text."""
    named = hyperedges.join(papers.select("paper_key", F.col("title").alias("paper_title")), "paper_key", "left")
    hit = named.filter(like_any(q.strip(), ["label", "paper_title"]))
    return hit.orderBy("hyperedge_id").limit(max(1, most)).select("hyperedge_id", F.coalesce(F.nullif("label", F.lit("")), "paper_title").alias("title"), F.coalesce("paper_title", F.lit("")).alias("text"))


def match_nodes(nodes: DataFrame, q: str, most: int = 30) -> DataFrame:
    """Nodes with a text in their name or aliases."""
    return nodes.filter(like_any(q.strip(), [c for c in ("name", "aliases") if c in nodes.columns])).orderBy("node_id").limit(max(1, most))


def related(nodes: DataFrame, edges: DataFrame, current: DataFrame, most: int = 10) -> DataFrame:
    """Nodes outside the current ones that share most edges with them."""
    here = current.select("node_id").distinct()
    touching = edges.join(here.withColumnRenamed("node_id", "source_node"), "source_node", "left_semi").select("source_node", "target_node").unionByName(
        edges.join(here.withColumnRenamed("node_id", "source_node"), "source_node", "left_anti").join(here.withColumnRenamed("node_id", "target_node"), "target_node", "left_semi").select("source_node", "target_node"))
    ends = touching.select(F.explode(F.array("source_node", "target_node")).alias("node_id")).join(here, "node_id", "left_anti")
    best = ends.groupBy("node_id").agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "node_id").limit(most)
    return best.join(nodes, "node_id")


def vocabulary(nodes: DataFrame, edges: DataFrame, most: int = 150) -> DataFrame:
    """The names seen last among nodes with an edge, as "type: name"."""
    ends = edges.select(F.explode(F.array("source_node", "target_node")).alias("node_id")).distinct()
    seen = nodes.join(ends, "node_id", "left_semi").orderBy(F.desc("last_seen"), F.desc("node_id")).limit(most)
    return seen.select("node_id", F.concat("node_type", F.lit(": "), "name").alias("term"))


def top_materials(papers: DataFrame, quality: DataFrame, most: int) -> DataFrame:
    """The best works, those without an assessment last, then the newest."""
    rated = papers.join(quality.select("paper_key", "quality"), "paper_key", "left")
    return page(rated, "quality", "paper_key", year="pub_year", limit=most)


def outline(projects: DataFrame, existing: DataFrame, skeleton: list[tuple[str, str]]) -> DataFrame:
    """The sections of all projects after the skeleton's (key, heading) are added where they are missing; those there keep their text."""
    parts = F.posexplode(F.array(*[F.struct(F.lit(k).alias("section_key"), F.lit(h).alias("heading")) for k, h in skeleton])).alias("position", "s")
    fresh = projects.select("project_id", parts).select("project_id", "position", "s.section_key", "s.heading", F.lit("").alias("content"))
    return existing.unionByName(fresh.join(existing.select("project_id", "section_key"), ["project_id", "section_key"], "left_anti").select(*existing.columns))


def project_progress(projects: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections of each project, and how many of them have text."""
    n = sections.groupBy("project_id").agg(F.count("*").alias("total"), F.count_if(F.trim(F.coalesce("content", F.lit(""))) != "").alias("filled"))
    return projects.join(n, "project_id", "left").fillna(0, ["total", "filled"])


def append_log(log: DataFrame, path: str) -> None:
    """Adds rows to a stored log."""
    log.write.mode("append").parquet(path)


def draft_projection(draft: Column, keep: list[str], strategy_keep: list[str]) -> Column:
    """A draft (struct with an array of strategies) with the fields that are stored."""
    chosen = F.transform(draft["strategies"], lambda s: F.struct(*[s[c].alias(c) for c in strategy_keep]))
    return F.struct(*[draft[c].alias(c) for c in keep], chosen.alias("strategies"))


def briefs(hyperedges: DataFrame, most: int = 1500) -> DataFrame:
    """The most confident hyperedges; ties by id, the latest first."""
    return hyperedges.orderBy(F.desc("confidence"), F.desc("hyperedge_id")).limit(most)


def within_budget(rows: DataFrame, group: list[str], order: list[Column], text: str, budget: int, always: int = 0) -> DataFrame:
    """Each group's first rows whose texts together stay within a budget of characters; the first ``always`` stay anyway."""
    by = Window.partitionBy(*group).orderBy(*order)
    total = F.sum(F.length(F.coalesce(text, F.lit("")))).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_n", F.row_number().over(by)).withColumn("_total", total).filter((F.col("_total") <= budget) | (F.col("_n") <= always)).drop("_n", "_total")


def longest(papers: DataFrame, least: int, most: int) -> DataFrame:
    """The works with the longest texts of a length at least."""
    n = F.length(F.coalesce("clean_text", F.lit("")))
    return papers.filter(n >= least).select("paper_key", n.alias("n")).orderBy(F.desc("n"), "paper_key").limit(most)


def compare_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metrics (kind, name, n) of two snapshots side by side, with the change; one that is missing counts 0."""
    a, b = before.withColumnRenamed("n", "before"), after.withColumnRenamed("n", "after")
    return a.join(b, ["kind", "name"], "full").fillna(0, ["before", "after"]).withColumn("change", F.col("after") - F.col("before"))
