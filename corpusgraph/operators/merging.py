"""Folding nodes and edges: arriving mentions, merges of nodes, and cleaning of local labels (rows G02, G03, G10, G13, N03).

Nodes and edges keep what they are made of with the place where it came first
(``seq`` of the mention, ``pos`` in it), so that batches may be folded one
after the other: the result is that of one batch.  ``described`` shows a node
as a reader sees it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import stash, tasks
from .graph import link_components
from .hyperedges import repoint_members, swapped, swaps

# General words that a name without its code may be left with, and the least characters of a name that replaces another.
GENERIC = ("compound", "compd", "product", "intermediate", "entry", "item", "stage", "step", "substrate", "analyte", "derivative", "analog")
LEAST = 5
#: Place of a mention's own name, behind its aliases.
OWN = 1 << 20
NODE = """node_id long, node_type string, name string, normalized_name string, names array<struct<seq:long,pos:int,value:string,own:boolean>>,
 attributes array<struct<seq:long,pos:int,name:string,value:string>>, provenance array<struct<seq:long,pos:int,paper:string,evidence:string>>,
 confidence double, first_seen long, last_seen long, mentions long"""
EDGE = """edge_id long, relation_type string, source_node long, target_node long, attributes array<struct<seq:long,pos:int,name:string,value:string>>,
 confidence double, evidence_tier string, tier_seq long, provenance array<struct<seq:long,pos:int,paper:string,evidence:string>>"""
_NAME, _ALIAS, _ATTRIBUTE, _PROVENANCE = 0, 1, 2, 3
_MARK = "\x01"


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))


def _vertex(kind: Column | str, name: Column) -> Column:
    return F.concat(F.coalesce(F.col(kind) if isinstance(kind, str) else kind, F.lit("")), F.lit(_MARK), T.name_key(name))


_ENTRIES = ["_v", "_kind", "_a", "_b", "seq", "pos", "_conf", "_last", "_n"]


def _entries(rows: DataFrame, kind: int, items: Column, a: str, b: str | None, counted: bool = False) -> DataFrame:
    """One row for each item of an array (with seq, pos) of each row."""
    x = rows.select("_v", "_conf", "_last", "_n", F.explode(items).alias("x"))
    none = F.lit(None).cast("string")
    keep = lambda c, t: F.col(c) if counted else F.lit(None).cast(t)
    return x.select("_v", F.lit(kind).alias("_kind"), F.col(f"x.{a}").alias("_a"), (F.col(f"x.{b}") if b else none).alias("_b"), "x.seq", "x.pos", keep("_conf", "double").alias("_conf"), keep("_last", "long").alias("_last"), (F.col("_n") if counted else F.lit(0)).cast("long").alias("_n"))


def _filled(c: Column) -> Column:
    return T.strip(F.coalesce(c, F.lit(""))) != ""


def _placed(items: Column, fields: dict) -> Column:
    """Items of an array as structs with seq and their place."""
    return F.transform(items, lambda x, i: F.struct(F.col("seq").alias("seq"), i.cast("int").alias("pos"), *[f(x).alias(n) for n, f in fields.items()]))


def _of_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions as entries; those without a name that can be told go."""
    rows = mentions.withColumns({"_v": _vertex("node_type", F.col("name")), "_conf": clamp(F.col("confidence")), "_last": F.col("seq"), "_n": F.lit(1)}).filter(T.name_key(F.col("name")) != "")
    own = rows.select("_v", F.lit(_NAME).alias("_kind"), F.col("name").alias("_a"), F.lit(None).cast("string").alias("_b"), "seq", F.lit(OWN).alias("pos"), "_conf", "_last", F.col("_n").cast("long").alias("_n"))
    rows = rows.withColumns({
        "_aliases": F.filter(_placed(F.col("aliases"), {"value": lambda x: x}), lambda x: _filled(x["value"])),
        "_attributes": F.filter(_placed(F.map_entries("attributes"), {"name": lambda x: x["key"], "value": lambda x: x["value"]}), lambda x: _filled(x["value"])),
        "_provenance": _placed(F.col("provenance"), {"paper": lambda x: x["paper"], "evidence": lambda x: x["evidence"]}),
    })
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("_aliases", "_attributes", "_provenance")})
    rows = rows.select("_v", "_conf", "_last", "_n", "_aliases", "_attributes", "_provenance")
    parts = [_entries(rows, _ALIAS, F.col("_aliases"), "value", None), _entries(rows, _ATTRIBUTE, F.col("_attributes"), "name", "value"), _entries(rows, _PROVENANCE, F.col("_provenance"), "paper", "evidence")]
    return own.unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[2])


def _of_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes as entries; confidence and counts stand with the name that came first."""
    rows = nodes.withColumns({"_v": _vertex("node_type", F.col("name")), "_conf": F.col("confidence"), "_last": F.col("last_seen"), "_n": F.col("mentions")})
    head = lambda x: (x["seq"] == F.col("first_seen")) & x["own"]
    parts = [
        _entries(rows, _NAME, F.filter("names", head), "value", None, counted=True),
        _entries(rows, _NAME, F.filter("names", lambda x: x["own"] & ~head(x)), "value", None),
        _entries(rows, _ALIAS, F.filter("names", lambda x: ~x["own"]), "value", None),
        _entries(rows, _ATTRIBUTE, F.col("attributes"), "name", "value"),
        _entries(rows, _PROVENANCE, F.col("provenance"), "paper", "evidence"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _once(entries: DataFrame, key: str) -> DataFrame:
    """Each entry of a key once, where it came first."""
    at = F.min(F.struct("seq", "pos")).alias("_at")
    folded = entries.groupBy(key, "_kind", "_a", "_b").agg(at, F.max("_conf").alias("_conf"), F.max("_last").alias("_last"), F.sum("_n").alias("_n"))
    return folded.select(key, "_kind", "_a", "_b", "_at.seq", "_at.pos", "_conf", "_last", "_n")


def _gathered(entries: DataFrame, key: str, kinds: DataFrame | None = None) -> DataFrame:
    """Nodes out of entries that stand once for each key."""
    pick = lambda kind: F.when(F.col("_kind") == kind, F.struct("seq", "pos", "_a", "_b"))
    many = lambda *k: F.array_sort(F.collect_list(F.when(F.col("_kind").isin(*k), F.struct("seq", "pos", "_a", "_b", "_kind"))))
    out = entries.groupBy(key).agg(F.min(pick(_NAME)).alias("_head"), many(_NAME, _ALIAS).alias("_names"), many(_ATTRIBUTE).alias("_attributes"), many(_PROVENANCE).alias("_provenance"), F.max("_conf").alias("confidence"), F.max("_last").alias("last_seen"), F.sum("_n").alias("mentions"))
    parts = lambda c, a, b: F.transform(c, lambda x: F.struct(x["seq"].alias("seq"), x["pos"].alias("pos"), x["_a"].alias(a), x["_b"].alias(b)))
    return out.select(
        key, F.col("_head.seq").alias("node_id"), F.col("_head._a").alias("name"), T.name_key(F.col("_head._a")).alias("normalized_name"),
        F.transform("_names", lambda x: F.struct(x["seq"].alias("seq"), x["pos"].alias("pos"), x["_a"].alias("value"), (x["_kind"] == _NAME).alias("own"))).alias("names"),
        parts("_attributes", "name", "value").alias("attributes"), parts("_provenance", "paper", "evidence").alias("provenance"), "confidence", F.col("_head.seq").alias("first_seen"), "last_seen", "mentions",
    )


_COLUMNS = ["node_id", "node_type", "name", "normalized_name", "names", "attributes", "provenance", "confidence", "first_seen", "last_seen", "mentions"]


def upsert_nodes(nodes: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with arriving mentions folded in, and (drop, keep) of nodes that have become one.

    ``mentions`` has seq (unique, later ones larger), node_type, name, aliases,
    attributes (map), confidence, provenance (array of paper, evidence).  Rows
    of one type that share a normalised name or alias, directly or through
    others, are one node: the name is the first seen, whose seq is the id;
    confidence is the largest, clamped to 0..1; names, attributes and
    provenance are distinct, in order of first appearance.  Names are counted
    and linked by (type, normalised name), so that mentions of one name meet
    in partial sums.  A name without a letter or digit in it goes.
    """
    entries = stash(_once(_of_nodes(nodes).unionByName(_of_mentions(mentions)), "_v"), "entries")
    named = entries.filter(F.col("_kind").isin(_NAME, _ALIAS))
    links = named.select(F.col("_v").alias("a"), _vertex(F.split_part("_v", F.lit(_MARK), F.lit(1)), F.col("_a")).alias("b")).filter((F.col("a") != F.col("b")) & ~F.endswith("b", F.lit(_MARK))).distinct()
    labels = link_components(links).withColumnRenamed("node", "_v")
    whole = entries.join(labels.hint("merge"), "_v", "left").withColumn("_c", F.coalesce("label", "_v"))
    folded = stash(_gathered(_once(whole, "_c"), "_c").withColumn("node_type", F.split_part("_c", F.lit(_MARK), F.lit(1))), "nodes")
    own = nodes.select("node_id", _vertex("node_type", F.col("name")).alias("_v")).join(labels, "_v", "left").select(F.col("node_id").alias("drop"), F.coalesce("label", "_v").alias("_c"))
    mapping = own.join(folded.select("_c", F.col("node_id").alias("keep")), "_c").filter("drop != keep").select("drop", "keep")
    return folded.select(*_COLUMNS), mapping


def described(nodes: DataFrame) -> DataFrame:
    """Nodes with aliases, attributes (map to lists of values) and provenance as plain lists.

    A name that reads like the node's own is no alias.  An attribute with one
    value has a list of one; values differ and stand in order.
    """
    shown = F.filter("names", lambda x: ~x["own"] | (T.name_key(x["value"]) != F.col("normalized_name")))
    keys = F.array_distinct(F.col("attributes")["name"])
    values = F.transform(keys, lambda k: F.filter("attributes", lambda x: x["name"] == k)["value"])
    return nodes.withColumns({
        "aliases": F.array_distinct(shown["value"]),
        "attributes": F.map_from_arrays(keys, values),
        "provenance": F.transform("provenance", lambda x: F.struct(x["paper"].alias("paper"), x["evidence"].alias("evidence"))),
    }).drop("names")


def merge_attributes(pairs: DataFrame, key: str) -> DataFrame:
    """(key, seq, name, value) folded to (key, name, value): a list of the distinct values in order of first appearance; empty ones go."""
    once = pairs.filter(_filled(F.col("value"))).groupBy(key, "name", "value").agg(F.min("seq").alias("seq"))
    return once.groupBy(key, "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]).alias("value"))


def upsert_edges(edges: DataFrame, arriving: DataFrame, rows: int | None = None) -> DataFrame:
    """Edges with arriving ones (seq, relation_type, source_node, target_node, attributes, confidence, evidence_tier, provenance) folded in.

    The largest confidence, clamped; the attributes of the first; the last tier
    that is not empty; provenance distinct in order of first appearance.  An
    edge's id is the seq of the first.  ``rows`` is about how many edges and
    arriving ones there are, where that is known; they are counted otherwise.
    """
    key = ["relation_type", "source_node", "target_node"]
    tier = F.nullif("evidence_tier", F.lit(""))
    typed = _placed(F.map_entries("attributes"), {"name": lambda x: x["key"], "value": lambda x: x["value"]})
    fresh = arriving.select(
        F.col("seq").alias("edge_id"), *key, F.filter(typed, lambda x: _filled(x["value"])).alias("attributes"), clamp(F.col("confidence")).alias("confidence"), tier.alias("evidence_tier"), F.when(tier.isNotNull(), F.col("seq")).alias("tier_seq"),
        _placed(F.col("provenance"), {"paper": lambda x: x["paper"], "evidence": lambda x: x["evidence"]}).alias("provenance"),
    )
    n = tasks(edges.sparkSession, edges.count() + arriving.count() if rows is None else rows)
    each = edges.unionByName(fresh).repartition(n, *key).withColumn("_x", F.explode_outer("provenance"))
    # provenance is made distinct before it is gathered, so that a popular edge's list is no longer than its result
    tiered = F.when(F.col("tier_seq").isNotNull(), F.struct("tier_seq", "evidence_tier"))
    said = each.groupBy(*key, F.col("_x").isNotNull().alias("_said"), "_x.paper", "_x.evidence").agg(F.min(F.struct("_x.seq", "_x.pos")).alias("_at"), F.min("edge_id").alias("edge_id"), F.min_by("attributes", "edge_id").alias("attributes"), F.max("confidence").alias("confidence"), F.max(tiered).alias("_t"))
    item = F.when(F.col("_said"), F.struct("_at.seq", "_at.pos", "paper", "evidence"))
    out = said.groupBy(*key).agg(F.min("edge_id").alias("edge_id"), F.min_by("attributes", "edge_id").alias("attributes"), F.max("confidence").alias("confidence"), F.max("_t").alias("_t"), F.sort_array(F.collect_list(item)).alias("provenance"))
    return out.select("edge_id", *key, F.coalesce("attributes", F.array()).alias("attributes"), "confidence", "_t.evidence_tier", "_t.tier_seq", "provenance")


def resolve(mapping: DataFrame) -> DataFrame:
    """drop, root for merges (drop, keep), whose kept nodes may be dropped themselves.

    Pointers are doubled until each names a node that stays, so that rounds
    grow with the logarithm of the longest chain.  In a circle of merges the
    least node stays.  Of several merges of one node that into the least counts.
    """
    pairs = mapping.filter("drop != keep").groupBy("drop").agg(F.min("keep").alias("to"))
    state = stash(pairs.select("drop", "to", F.least("drop", "to").alias("low")), "pointers")
    most = state.count()
    span = 1
    while True:
        ahead = state.select(F.col("drop").alias("to"), F.col("to").alias("_t"), F.col("low").alias("_l"))
        joined = state.join(ahead.hint("merge"), "to", "left")
        state = stash(joined.select("drop", F.coalesce("_t", "to").alias("to"), F.least("low", "_l", F.coalesce("_t", "to")).alias("low"), F.col("_t").isNotNull().alias("_open")), "pointers")
        span *= 2
        if not state.filter("_open").limit(1).count():
            return state.select("drop", F.col("to").alias("root")).filter("drop != root")
        if span > most:
            break
    # what is still open leads into a circle, whose least node is the least among the steps behind its own pointer
    circle = state.select(F.col("drop").alias("to"), F.col("low").alias("_l"))
    return state.join(circle.hint("merge"), "to", "left").select("drop", F.coalesce("_l", "to").alias("root")).filter("drop != root")


def _moved(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    to = roots.select(F.col("drop").alias("_d"), F.col("root").alias("_r"))
    return df.join(to.hint("merge"), F.col(column) == F.col("_d"), "left").withColumn(column, F.coalesce("_r", column)).drop("_d", "_r")


def redirect_edges(edges: DataFrame, roots: DataFrame, n: int | None = None, gone: DataFrame | None = None) -> DataFrame:
    """Edges of dropped nodes at the nodes that stand for them: loops that arise go, edges that become equal fold.

    An edge that did not move stays before one that did, then the least id:
    its tier counts unless it is empty.  Attributes and provenance are united.
    ``n`` deals the edges over as many tasks; those of nodes of ``gone`` go.
    """
    key = ["relation_type", "source_node", "target_node"]
    to = swaps(roots.withColumnRenamed("root", "keep"), gone)
    was = edges.withColumns({"_s": F.col("source_node"), "_t": F.col("target_node")})
    moved = swapped(swapped(was, "source_node", to, n), "target_node", to, n)
    moved = moved if n is None else moved.repartition(n, *key)
    moved = moved.withColumn("_moved", (F.col("_s") != F.col("source_node")) | (F.col("_t") != F.col("target_node")))
    moved = moved.filter((F.col("source_node") != F.col("target_node")) | ~F.col("_moved")).drop("_s", "_t")
    order = F.struct("_moved", "edge_id")
    tier = F.when(F.coalesce("evidence_tier", F.lit("")) != "", F.struct(order.alias("o"), "evidence_tier", "tier_seq"))
    folded = moved.groupBy(*key).agg(F.min(order).alias("_o"), F.max("confidence").alias("confidence"), F.min(tier).alias("_tier"), *[F.array_sort(F.flatten(F.collect_list(c))).alias(c) for c in ("attributes", "provenance")])
    first = lambda c, a, b: F.filter(c, lambda x, i: ~F.exists(F.slice(c, 1, i), lambda y: y[a].eqNullSafe(x[a]) & y[b].eqNullSafe(x[b])))
    return folded.select(F.col("_o.edge_id").alias("edge_id"), *key, first(F.col("attributes"), "name", "value").alias("attributes"), "confidence", "_tier.evidence_tier", "_tier.tier_seq", first(F.col("provenance"), "paper", "evidence").alias("provenance"))


def redirect_refs(events: DataFrame, roots: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Events whose entity_refs (array of node ids) name kept nodes, each once and in order; those of ``gone`` (node_id) are left out.

    Only events that name a dropped node are taken apart.
    """
    swap = roots.select(F.col("drop").alias("_d"), F.col("root").alias("_r"))
    if gone is not None:
        swap = swap.unionByName(gone.select(F.col("node_id").alias("_d"), F.lit(None).cast("long").alias("_r")))
    each = events.select("id", F.posexplode("entity_refs").alias("_i", "_n"))
    hit = each.join(swap.select(F.col("_d").alias("_n")).hint("merge"), "_n", "left_semi").select("id").distinct()
    some = each.join(hit.hint("merge"), "id", "left_semi").join(swap.hint("merge"), F.col("_n") == F.col("_d"), "left").withColumn("_n", F.when(F.col("_d").isNotNull(), F.col("_r")).otherwise(F.col("_n")))
    lists = some.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n").isNotNull(), F.struct("_i", "_n")))), lambda x: x["_n"]).alias("_refs"))
    return events.join(lists.hint("merge"), "id", "left").withColumn("entity_refs", F.coalesce(F.array_distinct("_refs"), "entity_refs")).drop("_refs").select(*events.columns)


def _folded(rows: DataFrame, key: str, c: str, *by: str) -> DataFrame:
    """key, c: the items of the arrays of each key in order, the first of those that agree in ``by``; made distinct before they are gathered."""
    each = rows.select(key, F.explode(c).alias("_x"))
    once = each.groupBy(key, *[F.col(f"_x.{b}").alias(f"_by_{b}") for b in by]).agg(F.min("_x").alias("_x"))
    return once.groupBy(key).agg(F.array_sort(F.collect_list("_x")).alias(c))


def absorbed(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that stay, with aliases, attributes, provenance and the largest confidence of those merged into them; a dropped node's own name does not become an alias."""
    shown = F.transform(F.filter("names", lambda x: T.name_key(x["value"]) != F.col("normalized_name")), lambda x: F.struct(x["seq"].alias("seq"), x["pos"].alias("pos"), x["value"].alias("value"), F.lit(False).alias("own")))
    moved = nodes.join(roots.hint("merge"), F.col("node_id") == F.col("drop"), "left").withColumn("_to", F.coalesce("root", "node_id"))
    moved = moved.withColumn("names", F.when(F.col("root").isNull(), F.col("names")).otherwise(shown))
    head = F.struct("node_type", "name", "normalized_name", "first_seen")
    out = moved.groupBy("_to").agg(F.max(F.when(F.col("root").isNull(), head)).alias("_h"), F.max("confidence").alias("confidence"), F.max("last_seen").alias("last_seen"), F.sum("mentions").alias("mentions"))
    out = out.filter("_h is not null").select("_to", F.col("_to").alias("node_id"), "_h.*", "confidence", "last_seen", "mentions")
    for c, by in (("names", ("value", "own")), ("attributes", ("name", "value")), ("provenance", ("paper", "evidence"))):
        out = out.join(_folded(moved, "_to", c, *by).hint("merge"), "_to", "left").withColumn(c, F.coalesce(c, F.array().cast(nodes.schema[c].dataType)))
    return out.select(*nodes.columns)


def merge(graph: dict[str, DataFrame], mapping: DataFrame, level: str, operator: str, absorb: bool = True, gone: DataFrame | None = None, rows: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """The graph with nodes merged as ``mapping`` (drop, keep, reason) says, and its journal.

    ``graph`` has nodes, edges, members, measurements (with subject_node) and
    events (id, entity_refs).  Merges are followed to the node that stays; the
    journal has a row for each as it was asked for, with that node.  Edges and
    members of nodes of ``gone`` (node_id), or merged into those, go.  ``rows``
    is about how many edges and members there are, where that is known: they
    are dealt over tasks by it, so that a task holds no more of a larger graph.
    """
    n = {c: tasks(mapping.sparkSession, k) for c, k in (rows or {}).items()}
    roots = stash(resolve(mapping), "roots")
    journal = mapping.join(roots.hint("merge"), "drop", "left").select(F.array("drop").alias("from_ids"), F.col("keep").alias("to_id"), F.coalesce("root", "drop").alias("final_id"), F.lit(level).alias("rule_level"), "reason", F.lit(operator).alias("operator"))
    nodes = absorbed(graph["nodes"], roots) if absorb else graph["nodes"].join(roots.select(F.col("drop").alias("node_id")).hint("merge"), "node_id", "left_anti")
    return graph | {
        "nodes": nodes.select(*graph["nodes"].columns),
        "edges": redirect_edges(graph["edges"], roots, n.get("edges"), gone),
        "members": repoint_members(graph["members"], roots.withColumnRenamed("root", "keep"), n.get("members"), gone),
        "measurements": _moved(graph["measurements"], "subject_node", roots),
        "events": redirect_refs(graph["events"], roots),
        "journal": journal,
    }


def label_verdicts(nodes: DataFrame) -> DataFrame:
    """What becomes of nodes named by a code of one paper: node_id, action (rename, merge, drop), target, keep.

    In order of ids, a node takes its better name, or merges into the node
    that has it by then.  That is told without going node by node: the first
    owner of a name has it until its own turn comes, if it loses it then;
    before that turn others merge into it, and go where it goes; behind it,
    or where there was none, the first that wants the name takes it and the
    others merge into that one.  (type, normalised name) is unique, as
    ``upsert_nodes`` leaves it.
    """
    seen = described(nodes).select("node_id", "node_type", T.strip(F.coalesce("name", F.lit(""))).alias("_name"), "normalized_name", "aliases")
    cleaned = T.strip_local_codes(F.col("_name"))
    better = (cleaned != F.col("_name")) & (F.length(cleaned) >= LEAST) & ~F.lower(cleaned).isin(*GENERIC) & ~T.is_local_label(cleaned)
    local = T.is_local_label(F.col("_name"))
    target = F.when(better, cleaned).when(local, T.descriptive_alias(F.col("aliases")))
    told = seen.select("node_id", "node_type", "normalized_name", F.col("_name").alias("name"), target.alias("target"), (better | local).alias("_acts")).withColumn("_key", T.name_key(F.col("target")))
    leaves = F.col("_acts") & (F.col("target").isNull() | (F.col("_key") != F.col("normalized_name")))
    told = stash(told.withColumn("_until", F.when(leaves, F.col("node_id"))), "labels")
    owners = told.select("node_type", F.col("normalized_name").alias("_key"), F.col("node_id").alias("_owner"), "_until")
    acts = told.filter("_acts")
    wants = acts.filter("target is not null").drop("_until").join(owners.hint("merge"), ["node_type", "_key"], "left")
    held = F.col("_owner").isNotNull() & (F.col("_owner") != F.col("node_id")) & (F.col("_until").isNull() | (F.col("node_id") < F.col("_until")))
    wants = stash(wants.withColumn("_held", held), "wants")
    free = wants.filter("not _held")
    heads = free.groupBy("node_type", "_key").agg(F.min("node_id").alias("_head"))
    taken = free.join(heads.hint("merge"), ["node_type", "_key"]).select("node_id", "name", "target", F.when(F.col("node_id") != F.col("_head"), F.col("_head")).alias("keep"))
    merged = wants.filter("_held").select("node_id", "name", "target", F.col("_owner").alias("keep")).unionByName(taken)
    dropped = acts.filter("target is null").select("node_id", "name", F.lit(None).cast("string").alias("target"), F.lit(None).cast("long").alias("keep"))
    action = F.when(F.col("target").isNull(), "drop").when(F.col("keep").isNotNull(), "merge").otherwise("rename")
    return merged.unionByName(dropped).withColumn("action", action)


def clean_aliases(nodes: DataFrame) -> DataFrame:
    """Nodes whose aliases are no local labels, have lost their codes, and are neither general words nor the node's name."""
    bare = F.transform(F.filter("names", lambda x: ~x["own"] | (T.name_key(x["value"]) != F.col("normalized_name"))), lambda x: F.struct(x["seq"].alias("seq"), x["pos"].alias("pos"), F.when(~T.is_local_label(x["value"]), T.strip_local_codes(x["value"])).alias("value"), F.lit(False).alias("own")))
    good = F.filter(bare, lambda x: (F.coalesce(x["value"], F.lit("")) != "") & ~F.lower(x["value"]).isin(*GENERIC) & (x["value"] != F.col("name")))
    once = F.filter(good, lambda x, i: ~F.exists(F.slice(good, 1, i), lambda y: y["value"] == x["value"]))
    own = F.array(F.struct(F.col("first_seen").alias("seq"), F.lit(OWN).alias("pos"), F.col("name").alias("value"), F.lit(True).alias("own")))
    return nodes.withColumn("names", F.array_sort(F.concat(own, once)))


def cleanup(graph: dict[str, DataFrame], rows: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """The graph without local labels: renamed, merged or dropped nodes, clean aliases, no hyperedges without members; journal and counts.

    ``graph`` is as for ``merge``, with hyperedges, and conditions and evidence
    if it has them.  What a dropped node had, or what was merged into it, goes
    with it; measurements lose it as their subject, events as an entity.
    ``rows`` is as for ``merge``.
    """
    verdicts = stash(label_verdicts(graph["nodes"]), "verdicts")
    merges = verdicts.filter("action = 'merge'").select(F.col("node_id").alias("drop"), "keep", F.concat("name", F.lit(" -> "), "target").alias("reason"))
    gone = verdicts.filter("action = 'drop'").select("node_id")
    out = merge(graph, merges, "local_label", "cleanup", absorb=False, gone=gone, rows=rows)
    names = verdicts.filter("action = 'rename'").select("node_id", F.col("target").alias("_new"))
    nodes = out["nodes"].join(gone, "node_id", "left_anti").join(names, "node_id", "left")
    nodes = nodes.withColumn("name", F.coalesce("_new", "name")).withColumn("normalized_name", F.when(F.col("_new").isNotNull(), T.name_key(F.col("_new"))).otherwise(F.col("normalized_name"))).drop("_new")
    members = stash(out["members"], "members")
    held = members.select("hyperedge_id").distinct()
    children = {c: out[c].join(held, "hyperedge_id", "left_semi") for c in ("hyperedges", "conditions", "evidence") if c in out}
    left = gone.select(F.col("node_id").alias("_g"))
    measurements = out["measurements"].join(left, F.col("subject_node") == F.col("_g"), "left").withColumn("subject_node", F.when(F.col("_g").isNull(), F.col("subject_node"))).drop("_g").join(held, "hyperedge_id", "left_semi")
    counts = verdicts.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in (("rename", "renamed"), ("merge", "merged"), ("drop", "dropped"))])
    orphans = graph["hyperedges"].join(held, "hyperedge_id", "left_anti").agg(F.count("*").alias("dropped_hyperedges"))
    return out | children | {
        "nodes": clean_aliases(nodes).select(*graph["nodes"].columns),
        "members": members,
        "measurements": measurements.select(*graph["measurements"].columns),
        "events": redirect_refs(out["events"], merges.limit(0).select("drop", F.col("keep").alias("root")), gone),
        "counts": counts.unionByName(orphans, allowMissingColumns=True).agg(*[F.sum(c).alias(c) for c in ("renamed", "merged", "dropped", "dropped_hyperedges")]),
    }
