"""Queries of hyperedges, payloads and lookups: payloads are made from the part table, hyperedges from orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payloads as N
from ..functions import text as T
from ..operators import hyperedges as H
from ..storage import tasks
from . import bindings as B
from .registry import query


def answers(spark, d):
    """What a model might answer for each part, fenced and with a line break inside a text."""
    parts = [
        F.lit('Sure:\n```json\n{"entities":[{"name":" '), "p_name", F.lit(' ","type":"Material","confidence":'), (F.col("p_size") / 50).cast("string"),
        F.lit(',"aliases":["'), "p_type", F.lit(' x"]},{"name":"compound 5a","aliases":["5a","'), "p_name", F.lit(' derivative 12b"]},{"name":"These results show a\nbreak"},{"name":"x"}],"relations":[{"subject":"'), "p_name",
        F.lit('","object":"'), "p_type", F.lit('","type":"'), F.when(F.col("p_partkey") % 3 == 0, "related_to").otherwise("promotes"), F.lit('","predicate":"is","confidence":0.7},{"subject":"nobody","object":"'), "p_name",
        F.lit('"}],"events":[{"trigger":"heated '), "p_name", F.lit('","participants":["'), "p_name", F.lit('",""],"time":"5","confidence":0.9},{"trigger":"we found it"}]'),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(',"hyperedges":[{"type":"reaction","label":"yield of '), F.col("p_name"), F.lit('","members":[{"name":"'), F.col("p_name"), F.lit('","role":"product"}],"conditions":[],"measurements":[{"metric":"yield","value":"92","unit":"%"}]}]'))).otherwise(""),
        F.lit("}\n```"),
    ]
    return B.spread(B.table(spark, d, "part"), "p_partkey").select(F.concat(F.lit("p"), "p_partkey").alias("paper_key"), F.col("p_partkey").alias("seq"), F.lit(None).cast("double").alias("quality"), F.concat(*parts).alias("answer"))


def payloads(spark, d):
    return answers(spark, d).withColumn("payload", N.model_json(F.col("answer"), H.PAYLOAD)).drop("answer")


def named_nodes(spark, d):
    p = B.table(spark, d, "part")
    own = p.select(F.col("p_partkey").alias("node_id"), F.lit("Material").alias("node_type"), F.col("p_name").alias("name"), T.name_key(F.col("p_name")).alias("normalized_name"), F.array(F.concat("p_type", F.lit("/"), F.col("p_partkey").cast("string"))).alias("aliases"))
    kinds = p.groupBy("p_type").agg((F.min("p_partkey") + 10000000).alias("node_id")).select("node_id", F.lit("Kind").alias("node_type"), F.col("p_type").alias("name"), T.name_key(F.col("p_type")).alias("normalized_name"), F.array().cast("array<string>").alias("aliases"))
    return own.unionByName(kinds)


_NODES = "nodes as (select p_partkey as node_id, 'Material' as node_type, p_name as name, lower(p_name) as norm from part union all select min(p_partkey) + 10000000, 'Kind', p_type, lower(p_type) from part group by p_type)"


@query("n02_model_json", "select p_partkey as seq, 4 as entities, 2 as relations, 2 as events, case when p_partkey % 2 = 0 then 1 else 0 end as hyperedges, ' ' || p_name || ' ' as first_name from part")
def n02(spark, d):
    n = lambda c: F.coalesce(F.size(f"payload.{c}"), F.lit(0))
    return payloads(spark, d).select("seq", *[F.when(n(c) < 0, 0).otherwise(n(c)).alias(c) for c in ("entities", "relations", "events", "hyperedges")], F.col("payload.entities")[0]["name"].alias("first_name"))


@query("g09_entities", "select p_partkey as seq, 0 as place, 'Material' as node_type, p_name as name, p_type || ' x' as aliases, round(0.6 * least(1, p_size / 50.0) + 0.2, 6) as confidence from part union all select p_partkey, 1, 'Concept', p_name || ' derivative', '5a|' || p_name || ' derivative 12b|compound 5a', 0.5 from part")
def g09_entities(spark, d):
    return H.entities(payloads(spark, d)).select("seq", "place", "node_type", "name", F.array_join("aliases", "|").alias("aliases"), F.round("confidence", 6).alias("confidence"))


@query("g09_relations", f"with {_NODES}, k as (select norm, min(node_id) as id from nodes group by 1) select p_partkey as seq, 0 as place, case when p_partkey % 3 = 0 then 'related_to' else 'promotes' end as relation_type, a.id as source_node, b.id as target_node, cast(0.62 as double) as confidence, p_partkey % 3 <> 0 as candidate from part join k a on a.norm = lower(p_name) join k b on b.norm = lower(p_type)")
def g09_relations(spark, d):
    return H.relations(payloads(spark, d), named_nodes(spark, d), ["promotes"]).select("seq", "place", "relation_type", "source_node", "target_node", F.round("confidence", 6).alias("confidence"), "candidate")


@query("g16_event_assertions", "select p_partkey as seq, 0 as place, 'Event' as event_type, 'heated ' || p_name as trigger, p_name as participants, '5' as time_text, cast(0.9 as double) as confidence from part")
def g16(spark, d):
    return H.event_assertions(payloads(spark, d)).select("seq", "place", "event_type", "trigger", F.array_join("participants", "|").alias("participants"), "time_text", "confidence")


@query("g09_hyperedges", """select p_partkey as seq, 0 as place, 'reaction' as type, 'yield of ' || p_name as label, p_name || ':product' as members, '' as conditions, 'yield=92.0%' as measurements from part where p_partkey % 2 = 0
 union all select p_partkey, 0, 'relation', 'is', p_name || ':subject|' || p_type || ':object', '', '' from part where p_partkey % 2 = 1 union all select p_partkey, 1, 'relation', 'related_to', 'nobody:subject|' || p_name || ':object', '', '' from part where p_partkey % 2 = 1 and false
 union all select p_partkey, 1, 'relation', 'relation', 'nobody:subject|' || p_name || ':object', '', '' from part where p_partkey % 2 = 1
 union all select p_partkey, 2, 'event', 'heated ' || p_name, p_name || ':participant|:participant', 'time=5.0', '' from part where p_partkey % 2 = 1 union all select p_partkey, 3, 'event', 'we found it', '', '', '' from part where p_partkey % 2 = 1""")
def g09_hyperedges(spark, d):
    rows = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["key"], F.lit("="), x["value_num"].cast("string"), F.coalesce(x["unit"], F.lit("")))), "|")
    members = F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["name"], m["role"])), "|")
    return H.hyperedge_payloads(payloads(spark, d)).select("seq", "place", "type", "label", members.alias("members"), rows("conditions").alias("conditions"), rows("measurements").alias("measurements"))


@query("q01_issues", "select p_partkey as seq, part, place, issue from part, (values ('entitie', 0, 'unsure', 0), ('entitie', 1, 'unsure', 1), ('entitie', 2, 'reporting', 1), ('entitie', 3, 'reporting', 1), ('relation', 0, 'generic', 2), ('relation', 1, 'unsure', 1), ('event', 1, 'unsure', 1), ('hyperedge', 0, 'missing conditions', 3)) v(part, place, issue, w) where w = 1 or w = 0 and p_size / 50.0 < 0.6 or w = 2 and p_partkey % 3 = 0 or w = 3 and p_partkey % 2 = 0")
def q01(spark, d):
    return N.issues(payloads(spark, d)).select("seq", "part", "place", "issue")


@query("g04_register_types", "select distinct p_type as type_key, 'node' as kind, 'dynamic' as origin from part where p_type not in ('PROMO', 'SMALL')")
def g04(spark, d):
    registry = spark.createDataFrame([("PROMO",), ("SMALL",)], "type_key string")
    return H.register_types(registry, B.table(spark, d, "part").select(F.col("p_type").alias("type_key")), "node")


@query("j14_find_nodes", f"with {_NODES} select p_partkey as ref, case when p_partkey % 2 = 0 then p_partkey else (select min(node_id) from nodes where node_type = 'Material' and norm = lower(p_name)) end as node_id from part")
def j14(spark, d):
    p = B.table(spark, d, "part")
    alias = F.concat(F.lower("p_type"), F.lit(" -"), F.col("p_partkey").cast("string"))
    asked = p.select(F.col("p_partkey").alias("ref"), F.lit("Material").alias("node_type"), F.array(F.lit(""), F.when(F.col("p_partkey") % 2 == 0, alias).otherwise(F.upper("p_name"))).alias("names"))
    return H.find_nodes(asked, named_nodes(spark, d))


@query("j15_resolve_members", f"with {_NODES} select p_partkey as ref, case p_partkey % 4 when 0 then p_partkey when 1 then (select min(node_id) from nodes where node_type = 'Material' and norm = lower(p_name)) else (select min(node_id) from nodes where norm = lower(p_type)) end as node_id from part where p_partkey % 4 <> 3")
def j15(spark, d):
    k = F.col("p_partkey")
    members = B.table(spark, d, "part").select(k.alias("ref"), F.when(k % 4 == 0, "zzz").when(k % 4 == 1, F.col("p_name")).when(k % 4 == 2, F.col("p_type")).otherwise("unknown thing").alias("name"), F.when(k % 4 == 1, "Material").otherwise("Nowhere").alias("type"), F.when(k % 4 == 0, k).otherwise(-k).alias("node_id"))
    return H.resolve_members(members, named_nodes(spark, d)).select("ref", "node_id")


def _rows(spark, d):
    """Payloads of lines: those of a part with one flag are one hyperedge, whatever the order of their members."""
    line, k = B.table(spark, d, "lineitem"), F.col("l_partkey")
    member = lambda n, role: F.struct(n.cast("long").alias("node_id"), F.lit(role).alias("role"), F.lit(None).cast("int").alias("position"))
    both = F.when(F.col("l_linenumber") % 2 == 0, F.array(member(k, "product"), member(F.col("l_partkey") + 1, "source"))).otherwise(F.array(member(F.col("l_partkey") + 1, "source"), member(k, "product")))
    conditions = H.conditions_of_map(F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("temperature"), F.lit("80")))
    proof = F.array(F.struct(F.lit("p").alias("paper_key"), F.lit(None).cast("string").alias("section"), F.col("l_linestatus").alias("span_text")))
    return line.select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"), F.lit(" reaction ").alias("hyperedge_type"), F.lit("made").alias("label"), F.lit("p").alias("paper_key"), (1 - F.col("l_discount")).alias("confidence"), F.lit(None).cast("string").alias("evidence_tier"), both.alias("members"), conditions.alias("conditions"), F.slice(conditions, 1, 0).alias("measurements"), proof.alias("evidence"))


@query("g06_upsert_hyperedges", "select min(l_orderkey * 100 + l_linenumber) as first_seq, count(*) as n_payloads, max(1 - l_discount) as confidence, 'reaction' as hyperedge_type, 'unclassified' as evidence_tier, 2 as members, 2 as conditions, 1 as evidence, 0 as measurements from lineitem group by l_partkey, l_returnflag, l_linestatus")
def g06(spark, d):
    t = H.upsert(_rows(spark, d), B.table(spark, d, "lineitem").count())
    count = lambda name: t[name].groupBy("fingerprint").agg(F.count("*").alias(name))
    out = t["hyperedges"]
    for name in ("members", "conditions", "evidence", "measurements"):
        out = out.join(count(name), "fingerprint", "left")
    return out.fillna(0, ["measurements"]).select("first_seq", "n_payloads", "confidence", "hyperedge_type", "evidence_tier", "members", "conditions", "evidence", "measurements")


@query("g06_conditions", "select min(l_orderkey * 100 + l_linenumber) as first_seq, key, value_text, case when key = 'temperature' then cast(80 as double) end as value_num from (select *, unnest(['flag', 'temperature']) as key, unnest([l_returnflag, '80']) as value_text from lineitem) group by l_partkey, l_returnflag, l_linestatus, key, value_text")
def g06_conditions(spark, d):
    t = H.upsert(_rows(spark, d), B.table(spark, d, "lineitem").count())
    return t["conditions"].join(t["hyperedges"].select("fingerprint", "first_seq"), "fingerprint").select("first_seq", "key", "value_text", "value_num")


_HYPER = f"with {B.NODES}, {B.HYPEREDGES}, {B.MEMBERS}"


@query("g08_load_hyperedges", f"{_HYPER}, top as (select * from hyperedges where confidence >= 0.1 order by confidence desc, hyperedge_id desc limit 400), m as (select m.hyperedge_id, string_agg(role || '=' || name, '|' order by role, m.node_id) as members, count(*) as n from members m join nodes using (node_id) join top using (hyperedge_id) group by 1), c as (select l_orderkey as hyperedge_id, count(*) as conditions from lineitem where l_discount >= 0.05 group by 1) select hyperedge_id, confidence, members, n, coalesce(conditions, 0) as conditions from top join m using (hyperedge_id) left join c using (hyperedge_id) where exists (select 1 from members x where x.hyperedge_id = top.hyperedge_id and x.node_id % 3 = 0)")
def g08(spark, d):
    members = B.members(spark, d).withColumn("position", F.when(F.col("role") == "product", 0).otherwise(1))
    children = {"conditions": B.table(spark, d, "lineitem").filter("l_discount >= 0.05").select(F.col("l_orderkey").alias("hyperedge_id"), "l_linenumber", "l_partkey", "l_suppkey")}
    nodes = B.nodes(spark, d)
    got = H.load(B.hyperedges(spark, d), members, nodes, children, 0.1, 400, touching=nodes.filter("node_id % 3 = 0"))
    return got.select("hyperedge_id", "confidence", F.array_join(F.transform("members", lambda m: F.concat_ws("=", m["role"], m["name"])), "|").alias("members"), F.size("members").cast("long").alias("n"), F.coalesce(F.size("conditions"), F.lit(0)).cast("long").alias("conditions"))


_FOLD = "mapping as (select distinct l_partkey * 4 as \"drop\", (l_partkey - l_partkey % 2) * 4 as keep from lineitem where l_partkey % 2 = 1)"


@query("j09_both_members", f"with {B.MEMBERS}, {_FOLD} select distinct a.hyperedge_id, \"drop\", keep from members a join mapping on a.node_id = \"drop\" join members b on b.hyperedge_id = a.hyperedge_id and b.node_id = keep")
def j09(spark, d):
    return H.with_both(B.members(spark, d), _mapping(spark, d))


def _mapping(spark, d):
    k = F.col("l_partkey")
    return B.table(spark, d, "lineitem").filter("l_partkey % 2 = 1").select((k * 4).alias("drop"), ((k - k % 2) * 4).alias("keep")).distinct()


@query("g10_repoint_members", f"with {B.MEMBERS}, {_FOLD} select hyperedge_id, coalesce(keep, node_id) as node_id, role, min(node_id) as position from members left join mapping on node_id = \"drop\" group by 1, 2, 3")
def g10_members(spark, d):
    return H.repoint_members(B.members(spark, d).withColumn("position", F.col("node_id")), _mapping(spark, d), tasks(spark, B.sizes(spark, d)["members"]))


@query("g15_backfill", f"""with {B.NODES}, {B.EDGES}, e as (select 'relation' as hyperedge_type, relation_type as label, cast(source_node % 50 as varchar) as paper_key, max(case when confidence = 0 then 0.5 else confidence end) as confidence, 2 as members, 0 as conditions, count(*) as n from edges group by 2, 3, source_node, target_node),
 v as (select 'event' as hyperedge_type, case when event_id % 3 = 0 then 'heated' else event_type end as label, cast(null as varchar) as paper_key, 0.5 as confidence, 1 as members, case when event_id % 2 = 0 then 1 else 0 end as conditions, count(*) as n from events group by label, user_id, event_id % 2, conditions) select * from e union all select * from v""")
def g15(spark, d):
    e = B.edges(spark, d).select((F.col("source_node") * 100000000 + F.col("target_node")).alias("edge_id"), "relation_type", "source_node", "target_node", "confidence", F.lit("x").alias("evidence_tier"), (F.col("source_node") % 50).cast("string").alias("paper_key"))
    k = F.col("event_id")
    v = B.table(spark, d, "events").select(k.alias("id"), "event_type", F.when(k % 3 == 0, "heated").alias("trigger"), F.array("user_id").alias("entity_refs"), F.when(k % 2 == 0, "noon").otherwise("").alias("time_text"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("evidence_tier"), F.lit(None).cast("string").alias("paper_key"))
    t = H.upsert(H.from_edges(e).unionByName(H.from_events(v)), B.table(spark, d, "lineitem").count() + B.table(spark, d, "events").count())
    count = lambda name: t[name].groupBy("fingerprint").agg(F.count("*").alias(name))
    out = t["hyperedges"].join(count("members"), "fingerprint").join(count("conditions"), "fingerprint", "left").fillna(0, ["conditions"])
    return out.select("hyperedge_type", "label", "paper_key", "confidence", "members", "conditions", F.col("n_payloads").alias("n"))


@query("j16_identity_lookup", "select p_partkey as ref, case when p_type = 'PROMO' then 'a:2' when p_size % 5 = 0 then 'b:1' end as identity_key, case when p_type = 'PROMO' then 'one' else 'two' end as source from part where p_type = 'PROMO' or p_size % 5 = 0")
def j16(spark, d):
    terms = spark.createDataFrame([("b", 1, ["five", "promo"], "b:1", "two"), ("a", 2, ["Promo!", "promo"], "a:2", "one"), ("a", 7, ["promo"], "a:7", "one")], "domain string, ordinal int, names array<string>, identity_key string, source string")
    names = B.table(spark, d, "part").select(F.col("p_partkey").alias("ref"), F.array(F.concat("p_type", F.lit(",")), F.when(F.col("p_size") % 5 == 0, " FIVE ").otherwise("six")).alias("names"))
    return H.lookup_identity(names, terms)


_TABLE = [("organic letters", "Q1", 1), ("brand 3", "Q3", 2), ("journal of brand 11 studies", "Q2", 3), ("big brand 2 letters", "Q4", 4), ("brand 2", "Q1", 5)]


@query("j17_quartile_fallback", "select venue, case when venue like 'Organic Letters%' or venue like '%, organic letters' then 'Q1' when venue = 'Brand#3' then 'Q3' when venue = 'Brand#2' then 'Q1' when venue in ('Brand#11') or venue like 'X Journal of%' then 'Q2' when venue = 'Brand#1' then 'Q2' end as quartile from (select distinct case p_size % 4 when 0 then 'Organic Letters (Online)' when 1 then 'X Journal of Brand#11 studies, II' when 2 then p_name || ', organic letters' else p_brand end as venue from part)")
def j17_fallback(spark, d):
    s = F.col("p_size") % 4
    venue = F.when(s == 0, "Organic Letters (Online)").when(s == 1, "X Journal of Brand#11 studies, II").when(s == 2, F.concat("p_name", F.lit(", organic letters"))).otherwise(F.col("p_brand"))
    table = spark.createDataFrame(_TABLE, "venue_key string, quartile string, ordinal int").withColumn("venue_key", T.journal_key(F.col("venue_key")))
    return H.quartiles(B.table(spark, d, "part").select(venue.alias("venue")), table)


@query("x07_quartile_merge", "select lower(replace(n, '#', ' ')) as venue_key, case when k % 2 = 0 then 'Q4' else 'Q' || (k % 4 + 1) end as quartile from (select p_brand as n, min(p_partkey) as k from part group by 1)")
def x07(spark, d):
    p = B.table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("ordinal"))
    base = p.select("name", F.concat(F.lit("q"), F.col("ordinal") % 4 + 1).alias("quartile"), "ordinal")
    later = p.select(F.upper("name").alias("name"), F.when(F.col("ordinal") % 2 == 0, " Q4 ").otherwise("none").alias("quartile"), "ordinal")
    return H.merge_quartiles(base, later).select("venue_key", "quartile")


@query("n01_tolerant_json", "select event_id, case event_id % 4 when 0 then 2 when 1 then 0 when 2 then 0 else 0 end as items, case event_id % 4 when 1 then event_type end as value from events")
def n01(spark, d):
    k = F.col("event_id") % 4
    c = F.when(k == 0, F.concat(F.lit('["'), "event_type", F.lit('", "b"]'))).when(k == 1, F.concat(F.lit('{"a": "'), "event_type", F.lit('"}'))).when(k == 2, "[broken").otherwise(F.lit(None))
    return B.table(spark, d, "events").select("event_id", F.size(N.json_list(c)).alias("items"), F.element_at(N.json_object(c), "a").alias("value"))


@query("n04_sanitise", "select event_id, case when user_id % 3 = 0 then 'misplaced' when event_id % 10 < 5 then 'valid' else 'invalid' end as verdict from events")
def n04(spark, d):
    k = F.col("event_id") % 10
    rows = B.table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, "some prose about it").otherwise(F.concat(F.lit(" P-000"), k)).alias("value"))
    known = spark.range(5).select(F.concat(F.lit("P-000"), "id").alias("id"))
    return N.sanitise_references(rows, known).select("event_id", "verdict")


@query("n06_gap_defaults", "select p_partkey, trim(p_name) as source, 'related_to' as relation, '' as target, case when p_size % 2 = 0 then p_size else 0 end as support from part")
def n06(spark, d):
    g = F.struct(F.concat(F.lit(" "), "p_name").alias("source"), F.lit(" ").alias("relation"), F.lit(None).cast("string").alias("target"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("-3").alias("support"))
    return B.table(spark, d, "part").select("p_partkey", N.gap(g).alias("g")).select("p_partkey", "g.*")


@query("n08_resolve_fields", "select p_partkey as key, 'colour' as field, case when p_size % 3 = 0 then p_type when p_size % 3 = 1 then p_brand else p_name end as value, case p_size % 3 when 0 then 'user' when 1 then 'plan' else 'template' end as source from part")
def n08(spark, d):
    p, s = B.table(spark, d, "part"), F.col("p_size") % 3
    layer = lambda value: p.select(F.col("p_partkey").alias("key"), F.lit("colour").alias("field"), value.alias("value"))
    return N.resolve_fields(("user", layer(F.when(s == 0, F.col("p_type")).otherwise(" "))), ("plan", layer(F.when(s < 2, F.col("p_brand")))), ("template", layer(F.col("p_name"))))


@query("n09_brief", "select doc_id, case when length(t) <= 120 then t else substr(t, 1, 120) || '…' end as brief from (select doc_id, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as t from documents)")
def n09(spark, d):
    return B.table(spark, d, "documents").select("doc_id", N.brief(F.col("text")).alias("brief"))


@query("t22_attributes", "select p_partkey, 'boiling_point_' as key, p_size || ' °C' as value_text, cast(p_size as double) as value_num, '°C' as unit from part union all select p_partkey, 'kind', p_type, null, null from part")
def t22(spark, d):
    attributes = F.create_map(F.lit(" Boiling  Point (!)"), F.concat(F.col("p_size").cast("string"), F.lit(" °C")), F.lit("Kind"), F.col("p_type"), F.lit("none"), F.lit("  "), F.lit("nil"), F.lit(None).cast("string"))
    return B.table(spark, d, "part").select("p_partkey", F.explode(T.clean_attributes(attributes)).alias("a")).select("p_partkey", "a.*")


@query("t35_quantity_text", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'temperature ≤ ' || case when l_linenumber % 2 = 0 then 'room' else cast(cast(l_quantity as int) as varchar) || '.5' end || ' K' || case when l_returnflag = 'R' then '（' || l_linestatus || '）' else '' end as said from lineitem")
def t35(spark, d):
    even = F.col("l_linenumber") % 2 == 0
    said = T.quantity_text(F.lit("temperature"), F.lit("≤"), F.when(even, " room ").otherwise(""), F.floor("l_quantity") + 0.5, F.lit("K"), F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")))
    return B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", said.alias("said"))
