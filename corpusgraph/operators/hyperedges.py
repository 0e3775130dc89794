"""Hyperedges end to end: payloads of extraction, resolution of names, upsert, loading, projection of older facts (rows G04-G09, G15, G16, J08, J09, J14-J17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..storage import stash, tasks

# The defaults of what extraction leaves out, and how much of a sentence is kept.
CONFIDENCE, ENTITY, RELATION, EVENT, HYPEREDGE, ROLE, TIER = 0.5, "Concept", "related_to", "Event", "claim", "participant", "unclassified"
SPAN, TRIGGER, LOCATED = 500, 300, 120
_ROW = "array<struct<key:string,condition_key:string,metric:string,name:string,operator:string,value:string,value_text:string,value_num:double,unit:string,qualifier:string>>"
#: What extraction returns for one text; absent parts are null.
PAYLOAD = f"""struct<entities:array<struct<name:string,type:string,aliases:array<string>,confidence:double,evidence:string,attributes:map<string,string>>>,
 relations:array<struct<subject:string,object:string,type:string,predicate:string,confidence:double,evidence:string,conditions:{_ROW},measurements:{_ROW}>>,
 events:array<struct<trigger:string,type:string,participants:array<string>,time:string,confidence:double,evidence:string,conditions:{_ROW},measurements:{_ROW}>>,
 hyperedges:array<struct<type:string,hyperedge_type:string,label:string,members:array<struct<name:string,node_id:bigint,role:string,position:int>>,confidence:double,evidence:string,conditions:{_ROW},measurements:{_ROW}>>>"""


def register_types(registry: DataFrame, seen: DataFrame, kind: str) -> DataFrame:
    """Rows (type_key, kind, origin) to add for types that the registry lacks; the schema's version grows by their number."""
    fresh = seen.select("type_key").filter(F.coalesce("type_key", F.lit("")) != "").distinct()
    return fresh.join(registry.select("type_key"), "type_key", "left_anti").select("type_key", F.lit(kind).alias("kind"), F.lit("dynamic").alias("origin"))


def find_nodes(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ref, node_id for names (ref, node_type, names): a node of the type with one of the names, or else with one as an alias; the least id of those.

    ``nodes`` has node_id, node_type, normalized_name and aliases.
    """
    asked = names.select("ref", "node_type", F.explode("names").alias("_n")).select("ref", "node_type", T.name_key(F.col("_n")).alias("_n")).filter("_n != ''").distinct()
    own = nodes.select("node_type", F.col("normalized_name").alias("_n"), F.struct(F.lit(0).alias("late"), "node_id").alias("_hit"))
    other = nodes.select("node_type", F.explode("aliases").alias("_n"), "node_id").select("node_type", T.name_key(F.col("_n")).alias("_n"), F.struct(F.lit(1).alias("late"), "node_id").alias("_hit"))
    known = own.unionByName(other).groupBy("node_type", "_n").agg(F.min("_hit").alias("_hit"))
    return asked.join(known, ["node_type", "_n"]).groupBy("ref").agg(F.min("_hit").alias("_hit")).select("ref", F.col("_hit.node_id").alias("node_id"))


def resolve_members(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members (name, type, node_id and any more columns) with the node they mean: by id, by name within the type, by name in any type; others go.

    Of several nodes with a name in any type the least id is meant.
    """
    norm = members.withColumn("_n", T.name_key(F.col("name")))
    by_id = nodes.select(F.col("node_id").alias("_id")).distinct()
    by_type = nodes.groupBy(F.col("node_type").alias("_t"), F.col("normalized_name").alias("_nt")).agg(F.min("node_id").alias("_typed"))
    by_name = nodes.groupBy(F.col("normalized_name").alias("_na")).agg(F.min("node_id").alias("_any"))
    found = norm.join(by_id, F.col("node_id") == F.col("_id"), "left").join(by_type, (F.col("type") == F.col("_t")) & (F.col("_n") == F.col("_nt")) & (F.col("_n") != ""), "left").join(by_name, (F.col("_n") == F.col("_na")) & (F.col("_n") != ""), "left")
    meant = F.coalesce("_id", "_typed", "_any")
    return found.filter(meant.isNotNull()).withColumn("node_id", meant).select(*members.columns)


def condition_rows(c: Column) -> Column:
    """Conditions as rows (key, operator, value_text, value_num, unit, qualifier); a numeric value is its own number."""
    return F.transform(F.coalesce(c, F.from_json(F.lit("[]"), _ROW)), lambda x: _row(x, F.coalesce(F.nullif(x["key"], F.lit("")), x["condition_key"], F.lit(""))))


def measurement_rows(c: Column) -> Column:
    """Measurements as the same rows, under the metric's name."""
    return F.transform(F.coalesce(c, F.from_json(F.lit("[]"), _ROW)), lambda x: _row(x, F.coalesce(F.nullif(x["metric"], F.lit("")), x["name"], F.lit(""))))


def _number(value: Column) -> Column:
    """The number that a text is; one without a digit or the name of a number is not tried, since each failure raises inside the cast."""
    return F.when(F.rlike(value, F.lit("(?i)[0-9]|inf|nan")), value.try_cast("double"))


def _row(x: Column, key: Column) -> Column:
    value = F.coalesce(x["value"], x["value_text"])
    return F.struct(key.alias("key"), x["operator"].alias("operator"), value.alias("value_text"), F.coalesce(x["value_num"], _number(value)).alias("value_num"), x["unit"].alias("unit"), x["qualifier"].alias("qualifier"))


def conditions_of_map(c: Column) -> Column:
    """Conditions that come as a map from key to value."""
    rows = F.transform(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("key"), F.lit(None).cast("string").alias("operator"), e["value"].alias("value_text"), _number(e["value"]).alias("value_num"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("qualifier")))
    return F.sort_array(rows)


def identity(kind: Column, label: Column, paper: Column, members: Column, conditions: Column, measurements: Column, evidence: Column) -> Column:
    """The fingerprint of a hyperedge; the order of its parts is of no account, the place of a member neither."""
    text = lambda xs: F.array_join(F.sort_array(F.transform(xs, lambda x: F.to_json(x))), ";")
    own = F.transform(members, lambda m: F.struct(m["node_id"].alias("node_id"), F.coalesce(m["role"], F.lit("")).alias("role")))
    return F.sha1(F.concat_ws("|", kind, F.coalesce(label, F.lit("")), F.coalesce(paper.cast("string"), F.lit("")), text(own), text(conditions), text(measurements), text(evidence)))


def upsert(payloads: DataFrame, rows: int | None = None) -> dict[str, DataFrame]:
    """The tables hyperedges, members, conditions, measurements, evidence that payloads fold to.

    ``payloads`` has seq, hyperedge_type, label, paper_key, confidence,
    evidence_tier, members (array of node_id, role, position), conditions,
    measurements and evidence (array of paper_key, section, span_text).
    Those of equal identity are one hyperedge: label, paper and tier of the
    first, the largest confidence.  Children are distinct, nulls being equal.

    Each payload is read and marked once: those that agree in all parts are
    written as one row, from which the tables are taken.  ``rows`` is about how
    many payloads there are, where that is known; they are counted otherwise.
    """
    kind = F.coalesce(F.nullif(F.trim("hyperedge_type"), F.lit("")), F.lit(HYPEREDGE))
    tidy = payloads.withColumn("hyperedge_type", kind).withColumn("members", F.transform("members", lambda m, i: F.struct(m["node_id"].alias("node_id"), F.coalesce(F.nullif(m["role"], F.lit("")), F.lit(ROLE)).alias("role"), F.coalesce(F.nullif(m["position"], F.lit(0)), i).alias("position"))))
    marked = tidy.withColumn("fingerprint", identity(F.col("hyperedge_type"), F.col("label"), F.col("paper_key"), F.col("members"), F.col("conditions"), F.col("measurements"), F.col("evidence")))
    clamp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(CONFIDENCE))))
    n = tasks(payloads.sparkSession, payloads.count() if rows is None else rows)
    dealt = marked.withColumn("evidence_tier", F.coalesce("evidence_tier", F.lit(TIER))).repartition(n, "fingerprint")
    alike = dealt.groupBy("fingerprint", "hyperedge_type", "label", "paper_key", "evidence_tier", "members", "conditions", "measurements", "evidence")
    once = stash(alike.agg(F.max(clamp).alias("confidence"), F.min("seq").alias("first_seq"), F.count("*").alias("n_payloads")), "payloads")
    part = lambda *c: once.select("fingerprint", *c).repartition(n, "fingerprint")
    first = F.min_by(F.struct("hyperedge_type", "label", "paper_key", "evidence_tier"), "first_seq").alias("f")
    table = part("hyperedge_type", "label", "paper_key", "evidence_tier", "confidence", "first_seq", "n_payloads").groupBy("fingerprint")
    table = table.agg(first, F.max("confidence").alias("confidence"), F.min("first_seq").alias("first_seq"), F.sum("n_payloads").alias("n_payloads"))
    child = lambda c: part(c).select("fingerprint", F.explode(c).alias("x")).select("fingerprint", "x.*").distinct()
    return {
        "hyperedges": table.select("fingerprint", "f.hyperedge_type", "f.label", "f.paper_key", "f.evidence_tier", "confidence", "first_seq", "n_payloads"),
        "members": part("members").select("fingerprint", F.explode("members").alias("m")).groupBy("fingerprint", "m.node_id", "m.role").agg(F.min("m.position").alias("position")),
        "conditions": child("conditions"),
        "measurements": child("measurements"),
        "evidence": child("evidence"),
    }


def load(hyperedges: DataFrame, members: DataFrame, nodes: DataFrame, children: dict[str, DataFrame], least: float = 0.0, most: int = 500, touching: DataFrame | None = None, types: list[str] | None = None) -> DataFrame:
    """The most confident hyperedges with their members (named, in order) and children as nested lists.

    The limit comes before the filter by nodes.  The chosen ids are few and
    bounded, so that every child table is reduced to them before it is grouped.
    """
    kept = hyperedges.filter(F.col("confidence") >= least)
    kept = kept.filter(F.col("hyperedge_type").isin(types)) if types else kept
    chosen = kept.orderBy(F.desc("confidence"), F.desc("hyperedge_id")).limit(max(1, most))
    ids = chosen.select("hyperedge_id")
    named = members.join(F.broadcast(ids), "hyperedge_id", "left_semi").join(nodes.select("node_id", "name", "node_type"), "node_id")
    lists = named.groupBy("hyperedge_id").agg(F.array_sort(F.collect_list(F.struct("position", "node_id", "role", "name", "node_type"))).alias("members"))
    out = chosen.join(lists, "hyperedge_id", "left")
    for name, df in children.items():
        rows = df.join(F.broadcast(ids), "hyperedge_id", "left_semi")
        out = out.join(rows.groupBy("hyperedge_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "hyperedge_id"]))).alias(name)), "hyperedge_id", "left")
    if touching is not None:
        some = named.join(touching.select("node_id"), "node_id", "left_semi").select("hyperedge_id")
        out = out.join(some, "hyperedge_id", "left_semi")
    return out


def with_both(members: DataFrame, mapping: DataFrame) -> DataFrame:
    """Hyperedges that hold a dropped node and the node that is kept for it (mapping drop, keep)."""
    drop = members.select("hyperedge_id", F.col("node_id").alias("drop")).distinct().join(mapping, "drop")
    return drop.join(members.select("hyperedge_id", F.col("node_id").alias("keep")).distinct(), ["hyperedge_id", "keep"], "left_semi").select("hyperedge_id", "drop", "keep")


def swaps(mapping: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """_d, _k, _gone: the node kept for each dropped one of ``mapping`` (drop, keep); nodes of ``gone`` (node_id), and what was merged into them, go."""
    to = mapping.select(F.col("drop").alias("_d"), F.col("keep").alias("_k"))
    if gone is None:
        return to.withColumn("_gone", F.lit(False))
    left = gone.select(F.col("node_id").alias("_k"), F.lit(True).alias("_gone"))
    lost = left.select(F.col("_k").alias("_d"), F.lit(None).cast("long").alias("_k"), "_gone")
    return to.join(left.hint("merge"), "_k", "left").select("_d", "_k", F.coalesce("_gone", F.lit(False)).alias("_gone")).unionByName(lost)


def swapped(df: DataFrame, column: str, to: DataFrame, n: int | None = None) -> DataFrame:
    """Rows with the nodes of ``column`` replaced as ``swaps`` says, over ``n`` tasks; those of nodes that go are left out."""
    df = df if n is None else df.repartition(n, column)
    moved = df.join(to.hint("merge"), F.col(column) == F.col("_d"), "left").filter(~F.coalesce("_gone", F.lit(False)))
    return moved.withColumn(column, F.coalesce("_k", column)).drop("_d", "_k", "_gone")


def repoint_members(members: DataFrame, mapping: DataFrame, n: int | None = None, gone: DataFrame | None = None) -> DataFrame:
    """Members of dropped nodes become those of kept ones; what then is there twice folds to the earliest place.

    ``n`` deals them over as many tasks; members of nodes of ``gone`` go.
    """
    moved = swapped(members, "node_id", swaps(mapping, gone), n)
    moved = moved if n is None else moved.repartition(n, "hyperedge_id")
    return moved.groupBy("hyperedge_id", "node_id", "role").agg(F.min("position").alias("position"))


def entities(payloads: DataFrame, flagged: Column | None = None) -> DataFrame:
    """Mentions (node_type, name, aliases, confidence, paper_key, seq) of payloads (paper_key, seq, quality, payload).

    Reporting phrases are no entities.  A name that means something in one
    paper only gives way to an alias that describes it, or goes.
    """
    e = F.col("e")
    rows = payloads.select("paper_key", "seq", "quality", F.posexplode("payload.entities").alias("place", "e"))
    name = F.trim(F.coalesce(e["name"], F.lit("")))
    listed = F.filter(F.coalesce(e["aliases"], F.array().cast("array<string>")), lambda a: F.trim(a) != "")
    local = T.is_local_label(name)
    preferred = T.descriptive_alias(listed)
    blend = S.blend(F.coalesce(e["confidence"], F.lit(CONFIDENCE)), F.coalesce("quality", F.lit(CONFIDENCE)), F.lit(False) if flagged is None else flagged)
    out = rows.select("paper_key", "seq", "place", F.coalesce(F.nullif(F.trim(e["type"]), F.lit("")), F.lit(ENTITY)).alias("node_type"), F.when(local, preferred).otherwise(name).alias("name"), F.when(local, F.array_union(listed, F.array(name))).otherwise(listed).alias("aliases"), blend.alias("confidence"), F.substring(F.coalesce(e["evidence"], F.lit("")), 1, SPAN).alias("evidence"))
    return out.filter(F.col("name").isNotNull() & (F.col("name") != "") & ~T.is_reporting_phrase(F.col("name")))


def relations(payloads: DataFrame, nodes: DataFrame, strong: list[str], least: float = 0.75, flagged: Column | None = None) -> DataFrame:
    """Edges of payloads whose two ends are known by name; a strong relation below the confidence is a candidate."""
    r = F.col("r")
    rows = payloads.select("paper_key", "seq", "quality", F.posexplode("payload.relations").alias("place", "r"))
    blend = S.blend(F.coalesce(r["confidence"], F.lit(CONFIDENCE)), F.coalesce("quality", F.lit(CONFIDENCE)), F.lit(False) if flagged is None else flagged)
    flat = rows.select("paper_key", "seq", "place", F.coalesce(F.nullif(F.trim(r["type"]), F.lit("")), F.lit(RELATION)).alias("relation_type"), F.coalesce(r["predicate"], F.lit("")).alias("predicate"), blend.alias("confidence"), T.name_key(r["subject"]).alias("_s"), T.name_key(r["object"]).alias("_o"))
    known = nodes.groupBy("normalized_name").agg(F.min("node_id").alias("_id"))
    for end, to in (("_s", "source_node"), ("_o", "target_node")):
        flat = flat.join(known.select(F.col("normalized_name").alias(end), F.col("_id").alias(to)), end)
    return flat.select("paper_key", "seq", "place", "relation_type", "source_node", "target_node", "predicate", "confidence", (F.col("relation_type").isin(strong) & (F.col("confidence") < least)).alias("candidate"))


def event_assertions(payloads: DataFrame) -> DataFrame:
    """Rows of the events that payloads assert; reporting phrases assert nothing."""
    v = F.col("v")
    rows = payloads.select("paper_key", "seq", F.posexplode("payload.events").alias("place", "v"))
    kind = F.coalesce(F.nullif(F.trim(v["type"]), F.lit("")), F.lit(EVENT))
    trigger = F.trim(F.coalesce(v["trigger"], F.lit("")))
    who = F.filter(F.coalesce(v["participants"], F.array().cast("array<string>")), lambda p: F.trim(p) != "")
    out = rows.select("paper_key", "seq", "place", kind.alias("event_type"), F.substring(trigger, 1, TRIGGER).alias("trigger"), who.alias("participants"), F.nullif(F.trim(v["time"]), F.lit("")).alias("time_text"), F.coalesce(v["confidence"], F.lit(CONFIDENCE)).alias("confidence"))
    return out.filter(~T.is_reporting_phrase(F.col("trigger")) & ~T.is_reporting_phrase(F.col("event_type")))


def hyperedge_payloads(payloads: DataFrame) -> DataFrame:
    """Each hyperedge that payloads hold, with members by name; without any, their relations and events are taken for hyperedges."""
    none = F.lit(None)
    member = lambda name, role: F.struct(name.alias("name"), none.cast("bigint").alias("node_id"), F.lit(role).alias("role"), none.cast("int").alias("position"))
    whole = lambda kind, label, members, x, conditions: F.struct(kind.alias("type"), label.alias("label"), members.alias("members"), x["confidence"].alias("confidence"), x["evidence"].alias("evidence"), conditions.alias("conditions"), measurement_rows(x["measurements"]).alias("measurements"))
    p = F.col("payload")
    told = F.transform(p["hyperedges"], lambda h: whole(F.trim(F.coalesce(F.nullif(h["hyperedge_type"], F.lit("")), F.nullif(h["type"], F.lit("")), F.lit(HYPEREDGE))), F.trim(F.coalesce(F.nullif(h["label"], F.lit("")), h["hyperedge_type"], h["type"], F.lit(HYPEREDGE))), h["members"], h, condition_rows(h["conditions"])))
    linked = F.transform(p["relations"], lambda r: whole(F.lit("relation"), F.coalesce(F.nullif(r["predicate"], F.lit("")), F.nullif(r["type"], F.lit("")), F.lit("relation")), F.array(member(r["subject"], "subject"), member(r["object"], "object")), r, condition_rows(r["conditions"])))
    at = lambda v: F.struct(F.lit("time").alias("key"), F.lit("described_as").alias("operator"), v["time"].alias("value_text"), _number(v["time"]).alias("value_num"), none.cast("string").alias("unit"), none.cast("string").alias("qualifier"))
    timed = lambda v: F.when(v["time"].isNotNull() & ~F.exists(condition_rows(v["conditions"]), lambda c: c["key"] == "time"), F.concat(condition_rows(v["conditions"]), F.array(at(v)))).otherwise(condition_rows(v["conditions"]))
    happened = F.transform(p["events"], lambda v: whole(F.lit("event"), F.coalesce(F.nullif(v["trigger"], F.lit("")), F.lit("event")), F.transform(F.coalesce(v["participants"], F.array().cast("array<string>")), lambda n: member(n, ROLE)), v, timed(v)))
    older = F.concat(F.coalesce(linked, F.slice(happened, 1, 0)), F.coalesce(happened, F.slice(linked, 1, 0)))
    chosen = F.when(F.size(p["hyperedges"]) > 0, told).otherwise(older)
    return payloads.select("paper_key", "seq", F.posexplode(chosen).alias("place", "h")).select("paper_key", "seq", "place", "h.*")


def from_edges(edges: DataFrame) -> DataFrame:
    """Edges (edge_id, relation_type, source_node, target_node, confidence, evidence_tier, paper_key) as payloads for ``upsert``."""
    return _legacy(edges, F.col("edge_id"), "relation", F.col("relation_type"), F.array(_member(F.col("source_node"), "subject"), _member(F.col("target_node"), "object")), F.lit(None).cast("string"))


def from_events(events: DataFrame) -> DataFrame:
    """Event assertions (id, event_type, trigger, entity_refs, time_text, confidence, evidence_tier, paper_key) as payloads for ``upsert``."""
    label = F.coalesce(F.nullif("trigger", F.lit("")), "event_type")
    return _legacy(events, F.col("id"), "event", label, F.transform("entity_refs", lambda r: _member(r, ROLE)), F.col("time_text"))


def _member(node: Column, role: str) -> Column:
    return F.struct(node.cast("long").alias("node_id"), F.lit(role).alias("role"), F.lit(None).cast("int").alias("position"))


def _legacy(rows: DataFrame, seq: Column, kind: str, label: Column, members: Column, time: Column) -> DataFrame:
    timed = conditions_of_map(F.when(F.coalesce(time, F.lit("")) != "", F.create_map(F.lit("time"), time)))
    nothing = F.slice(conditions_of_map(F.create_map(F.lit("x"), F.lit("y"))), 1, 0)
    proof = F.array(F.struct(F.col("paper_key").cast("string").alias("paper_key"), F.lit(None).cast("string").alias("section"), F.lit("").alias("span_text")))
    return rows.select(seq.alias("seq"), F.lit(kind).alias("hyperedge_type"), label.alias("label"), "paper_key", F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(CONFIDENCE)).alias("confidence"), "evidence_tier", members.alias("members"), timed.alias("conditions"), nothing.alias("measurements"), F.when(F.col("paper_key").isNotNull(), proof).otherwise(F.slice(proof, 1, 0)).alias("evidence"))


def lookup_identity(names: DataFrame, dictionary: DataFrame, source: str | None = None) -> DataFrame:
    """Ref, identity_key, source for names (ref, names): the first term, by domain and place in its dictionary, that shares a name.

    ``dictionary`` has domain, ordinal, names, identity_key and source.
    """
    terms = dictionary if source is None else dictionary.filter(F.col("source") == source)
    asked = names.select("ref", F.explode("names").alias("_n")).select("ref", T.name_key(F.col("_n")).alias("_n")).filter("_n != ''").distinct()
    known = terms.select(F.explode("names").alias("_n"), F.struct("domain", "ordinal", "identity_key", "source").alias("_t")).select(T.name_key(F.col("_n")).alias("_n"), "_t").groupBy("_n").agg(F.min("_t").alias("_t"))
    return asked.join(known, "_n").groupBy("ref").agg(F.min("_t").alias("_t")).select("ref", "_t.identity_key", "_t.source")


def quartiles(venues: DataFrame, table: DataFrame, least: int = 12) -> DataFrame:
    """Venue, quartile: by the journal's key, or else by the first entry (venue_key, quartile, ordinal) of 12 characters and more that contains it or is contained.

    Venues are reduced to distinct keys.  The shorter of two strings is looked
    up by its first characters among the places of the longer one.
    """
    keys = venues.select("venue").distinct().withColumn("_k", T.journal_key(F.col("venue"))).filter("_k != ''")
    exact = table.groupBy(F.col("venue_key").alias("_k")).agg(F.min_by("quartile", "ordinal").alias("_exact"))
    rest = keys.join(exact, "_k", "left_anti").select("_k").distinct()
    long = table.filter(F.length("venue_key") >= least).select("venue_key", "quartile", "ordinal")
    parts = lambda c, n: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(F.col(c), i, n))))
    within = rest.select("_k", parts("_k", F.lit(least)).alias("_g")).join(long.withColumn("_g", F.substring("venue_key", 1, least)), "_g").filter(F.contains(F.col("_k"), F.col("venue_key")))
    sizes = F.explode(F.sequence(F.lit(1), F.lit(least))).alias("_size")
    grams = long.select("*", sizes).select("venue_key", "quartile", "ordinal", parts("venue_key", F.col("_size")).alias("_g"))
    around = rest.withColumn("_g", F.substring("_k", 1, least)).join(grams, "_g").filter(F.contains(F.col("venue_key"), F.col("_k")))
    cols = ["_k", "quartile", "ordinal"]
    loose = within.select(cols).unionByName(around.select(cols)).groupBy("_k").agg(F.min_by("quartile", "ordinal").alias("_loose"))
    return keys.join(exact, "_k", "left").join(loose, "_k", "left").select("venue", F.coalesce("_exact", "_loose").alias("quartile"))


def merge_quartiles(*files: DataFrame) -> DataFrame:
    """Entries (name, quartile, ordinal) of several files by journal key; later files win, only Q1 to Q4 count."""
    rows = None
    for i, df in enumerate(files):
        part = df.select(T.journal_key(F.col("name")).alias("venue_key"), F.upper(F.trim("quartile")).alias("quartile"), F.struct(F.lit(i).alias("file"), "ordinal").alias("_at")).filter(F.col("quartile").isin("Q1", "Q2", "Q3", "Q4") & (F.col("venue_key") != ""))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("venue_key").agg(F.max_by("quartile", "_at").alias("quartile"), F.min("_at").alias("_first")).select("venue_key", "quartile", (F.col("_first.file") * F.lit(1 << 32) + F.col("_first.ordinal")).alias("ordinal"))
