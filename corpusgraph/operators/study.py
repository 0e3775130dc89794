"""Design rules, reviews, routing and planning over rows (rows M15-M21, A24, A25, Q03-Q05, T34, T36, T39-T42, U02, U04, W05, X08-X12, X17, X19, X22, X27, R06)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Levels, weights, limits, hints of relations.
LEVELS = ("L0", "L1", "L2", "L3", "L4")
MECHANISTIC = ("L3", "L4")
LOW_LEVEL, COMBINING = ("combine", "substitute", "migrate", "extend"), ("combine", "unclassified_transform")
BOND_CHANGES, ACTIONS, THRESHOLD, SAMPLE_NAMES, MOST_TOKENS = 4, 12, 0.85, 40, 1000
RELATION_HINTS = {
    "promotes": "(promot* OR enhanc* OR induc* OR stimulat* OR accelerat*)",
    "inhibits": "(inhibit* OR suppress* OR reduc* OR block*)",
    "regulates": "(regulat* OR modulat* OR control* OR adjust*)",
    "activates": "(activat* OR up-regulat* OR upregulat*)",
    "treats": "(treat* OR ther* OR effect*)",
    "targets": "(target* OR bind* OR interact*)",
    "enables": "(enabl* OR support* OR allow* OR faciliat*)",
    "results_in": "(result* OR lead* OR caus* OR contribut*)",
}
Rules = list[tuple[str, list[str]]]


def first_match(text: Column, rules: Rules, default: str = "") -> Column:
    """The name of the first rule of which a keyword occurs."""
    out = F.lit(default)
    for name, words in reversed(rules):
        out = F.when(T.contains_any(text, words), name).otherwise(out)
    return out


def all_matches(text: Column, rules: Rules) -> Column:
    """The names of all rules of which a keyword occurs, in the rules' order."""
    return F.array_compact(F.array(*[F.when(T.contains_any(text, words), name) for name, words in rules]))


def most_matches(text: Column, rules: Rules, fallback: str) -> Column:
    """The name of the rule with most keywords, the earlier of equal ones; the fallback where none occurs."""
    scored = F.array(*[F.struct(reduce(lambda a, b: a + b, [T.contains_any(text, [w]).cast("int") for w in words], F.lit(0)).alias("hits"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, words) in enumerate(rules)])
    best = F.array_max(scored)
    return F.when(best["hits"] > 0, best["name"]).otherwise(fallback)


def bond_changes(text: Column, bonds: list[str]) -> Column:
    """The first four bonds that a text speaks of."""
    return F.slice(all_matches(text, [(b, [b]) for b in bonds]), 1, BOND_CHANGES)


def mechanistic_score(text: Column, mechanism: list[str], conditions: list[str], bonds: list[str]) -> Column:
    """Three for each word of mechanism, two for each of conditions, one for each bond."""
    count = lambda words: reduce(lambda a, b: a + b, [T.contains_any(text, [w]).cast("int") for w in words], F.lit(0))
    return 3 * count(mechanism) + 2 * count(conditions) + F.size(bond_changes(text, bonds))


def canonical_operator(c: Column, labels: dict[str, str], aliases: dict[str, str]) -> Column:
    """The operator that a text names: by name, by alias, by its words joined, by the longest alias in it, by a name or label in it; empty for none."""
    text = T.strip(F.coalesce(c, F.lit("")))
    low = F.lower(text)
    slug = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9_]+", "_"), "^_+|_+$", "")
    names = F.create_map(*[F.lit(x) for n in labels for x in (n, n)])
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else F.create_map().cast("map<string,string>")
    within = F.lit(None).cast("string")
    for name, label in reversed(labels.items()):
        within = F.when(slug.contains(name) | low.contains(label.lower()), name).otherwise(within)
    # the longest is looked for first, of equally long ones the first
    for alias, name in reversed(sorted(aliases.items(), key=lambda kv: -len(kv[0]))):
        within = F.when(low.contains(alias), name).otherwise(within) if alias else within
    found = F.coalesce(names[text], names[low], known[text], known[low], names[slug], within)
    return F.when(text == "", "").otherwise(F.coalesce(found, F.lit("")))


def chains(steps: DataFrame, levels: dict[str, str], labels: dict[str, str], aliases: dict[str, str]) -> DataFrame:
    """chain_id, operators, unknown, breaks, mechanistic, max_level, level of chains (chain_id, position, operator, input, output).

    Unknown operators go, and so does one that repeats the step before it.  A
    break is a step whose input shares no word with the output before it;
    empty ends break nothing.
    """
    named = steps.withColumn("_op", canonical_operator(F.col("operator"), labels, aliases))
    by = Window.partitionBy("chain_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, kept: F.last(F.when(kept, F.struct(c)), ignorenulls=True).over(by)[c]
    known = F.col("_op") != ""
    counted = named.withColumn("_b", before("_op", known)).withColumn("_kept", known & (F.col("_b").isNull() | (F.col("_b") != F.col("_op"))))
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z一-鿿]{2,})"), F.lit(1))
    ends = counted.withColumn("_o", before("output", F.col("_kept"))).withColumns({"_out": words(F.col("_o")), "_in": words(F.col("input"))})
    same = F.lower(F.trim("_o")) == F.lower(F.trim("input"))
    broken = F.col("_kept") & (F.size("_out") > 0) & (F.size("_in") > 0) & ~F.arrays_overlap("_out", "_in") & ~F.coalesce(same, F.lit(False))
    rank = F.element_at(F.create_map(*[F.lit(x) for n, v in levels.items() for x in (n, LEVELS.index(v))]), F.col("_op"))
    # what a chain keeps and what it does not know are counted in one pass, sorted by chain once
    ranked = ends.withColumns({"_broken": broken, "_rank": F.when(F.col("_kept"), rank), "_op": F.when(F.col("_kept"), F.col("_op")), "_unknown": ~known & (F.trim(F.coalesce("operator", F.lit(""))) != "")})
    out = ranked.groupBy("chain_id").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("_kept"), F.struct("position", "_op")))), lambda x: x["_op"]).alias("operators"),
        F.count_if("_unknown").alias("unknown"),
        F.count_if("_broken").alias("breaks"),
        F.count_if(F.col("_rank") >= LEVELS.index(MECHANISTIC[0])).alias("mechanistic"),
        F.max("_rank").alias("_max"),
        F.bool_or(F.col("_op").isin(*COMBINING)).alias("_combines"),
        F.bool_and(F.col("_op").isin(*LOW_LEVEL, "unclassified_transform")).alias("low_level_only"),
    )
    level = F.when(F.col("mechanistic") >= 2, "L4").when(F.col("mechanistic") == 1, "L3").when(F.col("_combines"), "L2").when(F.col("_max").isNotNull(), "L1").otherwise("L0")
    most = F.coalesce(F.get(F.array(*[F.lit(x) for x in LEVELS]), F.col("_max")), F.lit("L0"))
    out = out.withColumn("level", level).withColumn("max_level", most)
    return out.select("chain_id", "operators", "unknown", "breaks", "mechanistic", "max_level", "level", F.coalesce("low_level_only", F.lit(False)).alias("low_level_only"))


def meets_floor(level: Column, floor: Column) -> Column:
    """Whether a level reaches a floor; an unknown floor is the lowest."""
    rank = F.create_map(*[F.lit(x) for i, v in enumerate(LEVELS) for x in (v, i)])
    return rank[level] >= F.coalesce(rank[F.upper(F.coalesce(floor, F.lit("L0")))], F.lit(0))


def dimension_weights(rows: DataFrame, group: str) -> DataFrame:
    """Weights of a group's dimensions (weight, required) so that the required ones sum to 1; without any, all keep theirs."""
    by = Window.partitionBy(group)
    any_required = F.max(F.col("required").cast("int")).over(by) == 1
    own = F.when(F.col("required"), F.coalesce("weight", F.lit(1.0))).otherwise(0.0)
    total = F.sum(own).over(by)
    return rows.withColumn("weight", F.when(~any_required, F.col("weight")).otherwise(F.round(own / F.when(total == 0, 1.0).otherwise(total), 6)))


def requirement_status(requirements: DataFrame, texts: DataFrame, names: DataFrame) -> DataFrame:
    """Ref, token, status of requirements (ref, token): covered where a text holds the token or its stem, unverifiable where a CJK token meets a library of Latin names, else missing.

    ``texts`` is any number of searchable texts (column text), ``names`` the
    library's first names in order (column name, at most 40 are looked at).
    Tokens are distinct words of an instruction; more than MOST_TOKENS of them
    raise.  Texts are read once and only tokens leave the tasks.
    """
    stems = requirements.select("token", F.explode(F.array_distinct(F.array(F.lower("token"), T.stem(F.col("token"))))).alias("part")).filter("part != ''").distinct()
    parts = [r.part for r in stems.select("part").distinct().limit(MOST_TOKENS + 1).collect()]
    if len(parts) > MOST_TOKENS:
        raise ValueError(f"more than {MOST_TOKENS} tokens in the requirements")
    low = F.lower(F.coalesce("text", F.lit("")))
    hit = F.filter(F.array(*[F.lit(p) for p in parts]) if parts else F.array().cast("array<string>"), lambda p: F.contains(low, p))
    seen = texts.select(F.explode(hit).alias("part")).distinct()
    covered = stems.join(seen, "part").select("token").distinct().withColumn("_c", F.lit(True))
    few = names.filter(F.coalesce("name", F.lit("")) != "").limit(SAMPLE_NAMES).agg(F.count("*").alias("n"), F.count_if(T.has_cjk(F.col("name"))).alias("c")).first()
    latin = bool(few.n) and few.c * 2 < few.n
    status = F.when(F.col("_c"), "covered").when(T.has_cjk(F.col("token")) & F.lit(latin), "unverifiable").otherwise("missing")
    return requirements.join(covered, "token", "left").select("ref", "token", status.alias("status"))


def review_scores(requirements: DataFrame, group: str) -> DataFrame:
    """The share of requirements met in each group, partly met ones counting half and those that do not apply nothing; and how many critical ones are not met."""
    active = F.col("status") != "not_applicable"
    worth = F.sum(F.when(F.col("status") == "met", 1.0).when(F.col("status") == "partial", 0.5).otherwise(0.0))
    return requirements.groupBy(group).agg(F.round(worth / F.greatest(F.lit(1), F.count_if(active)), 3).alias("score"), F.count_if((F.col("status") != "met") & (F.col("severity") == "critical")).alias("critical"), F.count_if(F.col("status") == "unmet").alias("unmet"))


def text_requirements(drafts: DataFrame, contract: DataFrame) -> DataFrame:
    """Q04: draft_id, kind, term, status, severity for drafts (draft_id, text, methods) under a contract (draft_id, kind, term): kinds methods, section, include, exclude, language."""
    text, kind, term = F.col("text"), F.col("kind"), F.col("term")
    has = F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(term))
    met = lambda c: F.when(c, "met").otherwise("unmet")
    chinese = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(T.CJK)) >= F.greatest(F.lit(20), F.length(F.coalesce(text, F.lit(""))) * 0.1)
    status = F.when(kind == "methods", met(F.col("methods") >= term.try_cast("int"))).when(kind == "exclude", met(~has)).when(kind == "language", F.when(~term.startswith("zh"), "not_applicable").when(chinese, "met").otherwise("partial")).otherwise(met(has))
    severity = F.when(kind.isin("methods", "exclude"), "critical").otherwise("major")
    return contract.join(drafts, "draft_id").select("draft_id", "kind", "term", status.alias("status"), severity.alias("severity"))


def design_requirements(candidates: DataFrame, floor: str, group: str) -> DataFrame:
    """Q03: requirements (kind, status, severity) of each group's candidates (level, n_operators, unknown, answers_constraints, signature): chains, known operators, the floor, constraints, diversity."""
    met = lambda c: F.when(c, "met").otherwise("unmet")
    n = F.count("*")
    one = candidates.groupBy(group).agg(
        met(F.count_if(F.col("n_operators") > 0) == n).alias("chain"),
        met(F.sum("unknown") == 0).alias("operators"),
        met(F.count_if(meets_floor(F.col("level"), F.lit(floor))) == n).alias("floor"),
        F.when(F.count_if("answers_constraints") == n, "met").when(F.count_if("answers_constraints") > 0, "partial").otherwise("unmet").alias("constraints"),
        met((n < 2) | (F.count_distinct("signature") >= 2)).alias("diversity"),
    )
    severity = {"chain": "major", "operators": "major", "floor": "critical", "constraints": "critical", "diversity": "major"}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("status"), F.lit(s).alias("severity")) for k, s in severity.items()])).alias("r")
    return one.select(group, rows).select(group, "r.*")


def evidence_reviews(items: DataFrame, known: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Q05: draft_id, invalid, unattributed, score, hard_fail of draft items (draft_id, item_id, status, refs): each kind of failure costs half, and caps the score below the threshold."""
    refs = items.select("draft_id", F.explode("refs").alias("ref")).filter("ref != ''").distinct()
    wrong = refs.join(known.select(F.col("id").alias("ref")), "ref", "left_anti").groupBy("draft_id").agg(F.count("*").alias("invalid"))
    bare = items.groupBy("draft_id").agg(F.count_if((F.col("status") == "supported") & (F.coalesce(F.size("refs"), F.lit(0)) <= 0)).alias("unattributed"))
    out = bare.join(wrong, "draft_id", "left").fillna(0, ["invalid"])
    failures = (F.col("invalid") > 0).cast("int") + (F.col("unattributed") > 0).cast("int")
    score = F.when(failures > 0, F.least(1 - 0.5 * failures, F.lit(threshold - 0.01))).otherwise(1.0)
    return out.select("draft_id", "invalid", "unattributed", F.round(F.greatest(F.lit(0.0), score), 3).alias("score"), (failures > 0).alias("hard_fail"))


def review_decision(instruction: DataFrame, evidence: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """draft_id, overall, decision from both reviews: 80 % instruction, 20 % evidence."""
    both = instruction.select("draft_id", F.col("score").alias("i"), "critical", "unmet").join(evidence.select("draft_id", F.col("score").alias("e"), "hard_fail"), "draft_id")
    weak = (F.col("e") < threshold) | F.col("hard_fail")
    decision = F.when(weak, F.when(F.col("hard_fail") & (F.col("critical") == 0), "need_more_data").otherwise("revise")).when((F.col("critical") > 0) | (F.col("unmet") > 0), "revise").otherwise("pass")
    return both.select("draft_id", F.round(0.8 * F.col("i") + 0.2 * F.col("e"), 3).alias("overall"), decision.alias("decision"))


def traceability(*lists: Column) -> Column:
    """The share of traceable items over several lists of structs with a flag; 0 without items."""
    size = lambda x: F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0))
    total = reduce(lambda a, b: a + b, [size(x) for x in lists])
    good = reduce(lambda a, b: a + b, [size(F.filter(x, lambda i: i["traceable"])) for x in lists])
    return F.when(total > 0, F.round(good / total, 3)).otherwise(0.0)


def search_phrase(c: Column) -> Column:
    """A term for a query, in quotes unless it is one word."""
    text = T.squeeze(F.coalesce(c, F.lit("")))
    return F.when(text.rlike(r"^([一-鿿]+|[A-Za-z0-9+#.\-]+)$") | (text == ""), text).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def gap_query(source: Column, target: Column, relation: Column) -> Column:
    """The query that looks for evidence of a relation; null where an end has no name."""
    a, b = search_phrase(source), search_phrase(target)
    hint = F.element_at(F.create_map(*[F.lit(x) for kv in RELATION_HINTS.items() for x in kv]), relation)
    return F.when((a != "") & (b != ""), F.concat(a, F.lit(" AND "), b, F.coalesce(F.concat(F.lit(" AND "), hint), F.lit(""))))


def route_after_quality(decision: Column) -> Column:
    """X11."""
    return F.when(decision.isin("knowledge", "flagged"), "knowledge").when(decision == "enrich", "retrieval").otherwise("human_review")


def route_study(stage: Column, s: Column) -> Column:
    """X11: where a study's state (struct) goes after a stage; at least one round of collection is allowed, two where nothing is said."""
    rounds = F.coalesce(s["collection_rounds"], F.lit(0))
    again = F.coalesce(s["collection_available"], F.lit(False)) & (rounds < F.greatest(F.lit(1), F.coalesce(F.nullif(s["max_rounds"], F.lit(0)), F.lit(2))))
    yes = lambda c: F.coalesce(s[c], F.lit(False))
    consumer = F.when(s["status"] == "consumer_failed", "manual_review").when((F.coalesce(s["status"], F.lit("")) != "needs_collection") & ~yes("has_requests"), "content").when(again, "collection").otherwise("content")
    content = F.when(yes("has_gaps") & ~yes("gaps_done") & again & yes("gaps_enabled"), "collection").otherwise("reviewer")
    decision = F.coalesce(s["decision"], F.lit("revise"))
    reviewer = F.when(decision == "pass", "fact_check").when(decision == "manual_review", "manual_review").when((decision == "need_more_data") & again, "collection").otherwise("content_builder")
    check = F.when(s["fact_check"] == "pass", "pass").when(F.coalesce(s["review_rounds"], F.lit(0)) > 1, "manual_review").otherwise("content_builder")
    return (
        F.when(stage == "planner", F.when(s["status"] == "planned", "collection").otherwise("end"))
        .when(stage == "collection", F.when(s["status"] == "planning_failed", "end").otherwise("consumer"))
        .when(stage == "consumer", consumer).when(stage == "content", content).when(stage == "reviewer", reviewer).when(stage == "fact_check", check)
    )


def reasons(**checks: tuple[Column, Column]) -> Column:
    """X22: "name: value < threshold" of each check (value, threshold) that falls short, in order."""
    number = lambda c: F.round(c.cast("double"), 3).cast("string")
    return F.array_compact(F.array(*[F.when(F.coalesce(v < t, F.lit(True)), F.concat(F.lit(f"{k}: "), F.coalesce(number(v), F.lit("none")), F.lit(" < "), number(t))) for k, (v, t) in checks.items()]))


def keep_first(key: list[str], *layers: DataFrame) -> DataFrame:
    """Rows of several layers with one for each key, of the earliest layer and there of the least ordinal."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("_layer", F.lit(i)) for i, df in enumerate(layers)])
    cols = [c for c in layers[0].columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*cols), F.struct("_layer", "ordinal")).alias("_r")).select(*key, "_r.*")


def with_defaults(profile: Column, defaults: dict[str, str]) -> Column:
    """A profile (struct of texts) with a default for each empty field."""
    return F.struct(*[F.coalesce(F.nullif(F.trim(profile[k]), F.lit("")), F.lit(v)).alias(k) for k, v in defaults.items()])


def refresh(papers: DataFrame, fresh: DataFrame, key: str, authority: list[str]) -> DataFrame:
    """Papers whose authority fields are missing take those of ``fresh``; all else stays."""
    new = fresh.select(key, *[F.col(c).alias(f"_{c}") for c in authority])
    return papers.join(new, key, "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in authority else F.col(c) for c in papers.columns])


def ordered_union(*lists: Column) -> Column:
    """The items of several lists in order, each once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.filter(F.concat(*[F.coalesce(x, none) for x in lists]), lambda v: F.trim(F.coalesce(v, F.lit(""))) != ""))


def revision_actions(*lists: Column) -> Column:
    """At most twelve actions of several lists, the strongest list first, each once."""
    return F.slice(ordered_union(*lists), 1, ACTIONS)


def valid_references(**families: DataFrame) -> DataFrame:
    """Id, family of all ids that may be cited; an id of several families belongs to the first by name."""
    rows = reduce(DataFrame.unionByName, [df.select(F.col("id").cast("string").alias("id"), F.lit(k).alias("family")) for k, df in families.items()])
    return rows.filter("id != ''").groupBy("id").agg(F.min("family").alias("family"))


def final_order(rows: DataFrame, most: int) -> DataFrame:
    """Hyperedges by mechanism, relevance, support and confidence; ties by id."""
    return rows.orderBy(F.desc("mechanism"), F.desc("relevance"), F.desc("support"), F.desc("confidence"), "hyperedge_id").limit(most)


def focus(sections: DataFrame, dimensions: DataFrame) -> DataFrame:
    """project_id, section_key, focus: a section's own focus, then the contract's dimensions (project_id, position, dimension) that contain its heading or are contained in it."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    pairs = sections.join(dimensions, "project_id").filter((low("heading") != "") & (low("dimension") != "") & (F.contains(low("heading"), low("dimension")) | F.contains(low("dimension"), low("heading"))))
    found = pairs.groupBy("project_id", "section_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "dimension"))), lambda x: x["dimension"]).alias("_d"))
    return sections.join(found, ["project_id", "section_key"], "left").select("project_id", "section_key", ordered_union(F.col("focus"), F.col("_d")).alias("focus"))


def converged(yields: Column, cap: Column) -> Column:
    """Whether collection ends: the last two rounds brought nothing, or the cap (1 to 5) is reached."""
    n = F.size(yields)
    quiet = (n >= 2) & (F.element_at(yields, -1) == 0) & (F.get(yields, n - 2) == 0)
    return quiet | (n >= F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(cap, F.lit(1)))))


def out_of_range(text: Column, count: Column) -> Column:
    """Numbers cited as [n] that no reference has, sorted and distinct."""
    cited = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[(\d{1,3})\]"), F.lit(1)), lambda n: n.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(cited, lambda n: (n < 1) | (n > count))))


def number_references(texts: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (doc_id, text) whose blocks of ids, such as [P-0001, E-0002], become superscript numbers by the papers' first appearance in the document, and doc_id, ref of ids that ``index`` (ref, paper_key) lacks.

    Numbers of a block are distinct and in the order of its ids; unknown ids
    leave the block, and a block of unknown ids alone goes.
    """
    block = r"[\[【]\s*((?:(?:P|E|H|MS|OP|GAP|OC|FC)-\d{1,6}(?:-\d{1,4})?[\s,，;；、]*)+)[\]】]"
    cut = texts.withColumn("_b", F.regexp_extract_all("text", F.lit(block), F.lit(1))).withColumn("_t", F.split(F.regexp_replace("text", block, "\u0001"), "\u0001"))
    refs = cut.select("doc_id", F.posexplode("_b").alias("_i", "_x")).select("doc_id", "_i", F.posexplode(F.filter(F.split("_x", r"[\s,，;；、]+"), lambda r: r != "")).alias("_j", "ref"))
    named = refs.join(index.select("ref", "paper_key").dropDuplicates(["ref"]), "ref", "left")
    first = named.filter("paper_key is not null").groupBy("doc_id", "paper_key").agg(F.min(F.struct("_i", "_j")).alias("_at"))
    order = first.withColumn("_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("_at"))).select("doc_id", "paper_key", "_no")
    numbers = named.join(order, ["doc_id", "paper_key"], "left").groupBy("doc_id", "_i").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("_no").isNotNull(), F.struct("_j", "_no")))), lambda x: x["_no"])).alias("_n"))
    marks = numbers.select("doc_id", F.struct("_i", F.when(F.size("_n") > 0, F.concat(F.lit("<sup>"), F.array_join(F.transform("_n", lambda n: n.cast("string")), ","), F.lit("</sup>"))).otherwise("").alias("m")).alias("x"))
    lists = marks.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["m"]).alias("_m"))
    whole = F.array_join(F.transform("_t", lambda t, i: F.concat(t, F.coalesce(F.get(F.coalesce("_m", F.array().cast("array<string>")), i), F.lit("")))), "")
    done = cut.join(lists, "doc_id", "left").select("doc_id", whole.alias("text"))
    return done, named.filter("paper_key is null").select("doc_id", "ref").distinct()


def acs_author(c: Column) -> Column:
    """T33: "Family, G. N." of a name: with a comma, with initials at its end, or with the family last."""
    name = T.squeeze(F.coalesce(c, F.lit("")))
    words = F.split(name, " ")
    last, before = F.element_at(words, -1), F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    short = (F.size(words) >= 2) & last.rlike(r"^([A-Za-z]\.?|([A-Z]\.?)+)$")
    comma = F.locate(",", name)
    family = F.when(comma > 0, F.trim(F.substring(name, F.lit(1), comma - 1))).when(short, before).otherwise(last)
    given = F.when(comma > 0, F.trim(F.substring(name, comma + 1, F.length(name)))).when(short, last).otherwise(before)
    tokens = F.filter(F.split(F.replace(given, F.lit("."), F.lit(" ")), r"\s+"), lambda t: t != "")
    pieces = F.flatten(F.transform(tokens, lambda t: F.when((F.length(t) > 1) & (F.upper(t) == t), F.filter(F.split(t, ""), lambda x: x != "")).otherwise(F.array(t))))
    letters = F.filter(F.transform(pieces, lambda p: F.upper(F.substring(p, 1, 1))), lambda p: p.rlike(r"^\p{L}"))
    initials = F.array_join(F.transform(letters, lambda p: F.concat(p, F.lit("."))), " ")
    return F.when(family == "", "").otherwise(F.when(initials == "", family).otherwise(F.concat(family, F.lit(", "), initials)))


def acs_line(number: Column, authors: Column, title: Column, venue: Column, year: Column, volume: Column, pages: Column, doi: Column) -> Column:
    """A numbered reference; more than ten authors are cut, absent parts left out."""
    tidy = lambda c: T.strip(F.regexp_replace(F.replace(F.regexp_replace(T.unescape(F.coalesce(c, F.lit(""))), "<[^>]+>", ""), F.lit("\u00a0"), F.lit(" ")), r"\s{2,}", " "))
    names = F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), acs_author), lambda a: a != "")
    who = F.concat(F.array_join(F.slice(names, 1, 10), "; "), F.when(F.size(names) > 10, "; et al.").otherwise(""))
    opt = lambda pre, c, post="": F.when(c != "", F.concat(F.lit(pre), c, F.lit(post))).otherwise("")
    bare = F.regexp_replace(F.coalesce(F.nullif(tidy(title), F.lit("")), F.lit("Untitled")), r"\.+$", "")
    when = F.coalesce(F.nullif(tidy(year.cast("string")), F.lit("")), F.lit("n.d."))
    link = F.regexp_replace(tidy(doi), r"(?i)^https?://doi\.org/", "")
    return F.concat(F.lit("("), number.cast("string"), F.lit(") "), opt("", F.regexp_replace(who, r"\.+$", ""), ". "), bare, F.lit("."), opt(" *", tidy(venue), "*"), F.lit(" "), when, opt(", ", tidy(volume.cast("string"))), opt(", ", tidy(pages)), F.lit("."), opt(" https://doi.org/", link))


def digest(materials: DataFrame, group: str, most: int) -> DataFrame:
    """One text of each group's first materials (ordinal, title, year, facts): numbered lines with their facts below."""
    year = F.coalesce(F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.lit(""))
    head = F.concat(F.lit("["), F.col("ordinal").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), year)
    line = F.concat(head, F.array_join(F.transform(F.coalesce("facts", F.array().cast("array<string>")), lambda f: F.concat(F.lit("\n  - "), f)), ""))
    return materials.filter(F.col("ordinal") <= most).groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda x: x["line"]), "\n").alias("digest"))
