"""Views that are rebuilt from the graph: semantic domains, relation channels, health (rows A15, A21, G14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import components, degrees

# Relations that lead to a domain, parents that are too general for one, and the words of domains.
HIERARCHY = ("is_a", "part_of")
TOO_GENERAL = ("chemical", "chemicals", "compound", "compounds", "substance", "material", "materials", "method", "methods", "concept", "entity", "process", "thing", "item", "product", "products", "event")
DOMAIN_WORDS = (
    ("ynamides", ("ynamide", "ynamides", "ynamide-")),
    ("nitrogen heterocycles", ("benzimidazole", "imidazole", "indole", "indazole", "pyridine", "pyrimidine", "pyrazine", "pyridazine", "triazine", "triazole", "pyrazole", "pyrrole", "quinoline", "isoquinoline", "diazepine", "azepine", "piperazine", "oxazole", "thiazole", "azacycle")),
    ("catalysis and catalysts", ("catalyst", "catalysis", "catalytic", "palladium", "copper", "gold", "rhodium", "nickel", "iridium", "cobalt", "scandium")),
    ("disease and clinical outcomes", ("disease", "syndrome", "cancer", "carcinoma", "infection", "disorder", "clinical outcome")),
    ("drugs and interventions", ("drug", "inhibitor", "therapy", "treatment", "medication", "intervention")),
    ("proteins and genes", ("protein", "gene", "kinase", "receptor", "enzyme", "transcription factor")),
    ("materials and composites", ("material", "polymer", "ceramic", "composite", "hydrogel", "scaffold", "nanoparticle", "nanomaterial", "coating")),
    ("machine learning methods", ("neural network", "transformer", "algorithm", "classifier", "large language model", "graph neural network")),
    ("datasets and benchmarks", ("dataset", "benchmark", "corpus", "evaluation suite")),
    ("social institutions and policies", ("institution", "policy", "government", "organization", "population", "public administration")),
)
DOMAIN_PREFIX, CHANNEL_PREFIX, CHANNEL = "auto-semantic:", "auto:", " 角色通道"
Rules = tuple[tuple[str, tuple[str, ...]], ...]


def sure(confidence: Column) -> Column:
    """A confidence of 0 counts as a missing one does."""
    return F.coalesce(F.nullif(confidence, F.lit(0.0)), F.lit(0.5))


def domain_key(label: Column) -> Column:
    return F.concat(F.lit(DOMAIN_PREFIX), F.substring(F.sha1(label.cast("binary")), 1, 20))


def domain_members(nodes: DataFrame, edges: DataFrame, rules: Rules = DOMAIN_WORDS) -> DataFrame:
    """domain_key, label, node_id, weight, confidence: domains by a node's parents, and by words in its name or aliases.

    A parent that is named by a code of one paper, or too generally, is none.
    ``nodes`` has node_id, name, aliases, confidence.
    """
    name = T.strip(F.coalesce("name", F.lit("")))
    good = (name != "") & ~T.is_local_label(name) & ~F.lower(name).isin(*TOO_GENERAL)
    above = nodes.filter(good).select(F.col("node_id").alias("target_node"), name.alias("label"))
    parents = edges.filter(F.col("relation_type").isin(*HIERARCHY)).join(above, "target_node").select(F.col("source_node").alias("node_id"), "label")
    text = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " ", "")))
    held = [F.when(T.contains_any(text, list(words)), label) for label, words in rules]
    worded = nodes.select("node_id", F.explode(F.array_compact(F.array(*held))).alias("label"))
    pairs = parents.unionByName(worded).distinct()
    return pairs.join(nodes.select("node_id", sure(F.col("confidence")).alias("confidence")), "node_id").select(domain_key(F.col("label")).alias("domain_key"), "label", "node_id", F.lit(1.0).alias("weight"), "confidence")


def domains(members: DataFrame) -> DataFrame:
    """domain_key, label, domain_type, members."""
    return members.groupBy("domain_key", "label").agg(F.count("*").alias("members")).withColumn("domain_type", F.lit("semantic_cluster"))


def _json(c: Column) -> Column:
    """A text as JSON."""
    listed = F.to_json(F.array(F.coalesce(c, F.lit(""))))
    return F.when(c.isNull(), "null").otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))


def channel_members(hyperedges: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """channel_key, hyperedge_id, weight and what the channel is told by: relation_family, signature (sorted role:type of each member).

    A hyperedge without members has an empty signature.
    """
    typed = members.join(nodes.select("node_id", "node_type"), "node_id")
    label = F.concat_ws(":", F.coalesce("role", F.lit("None")), F.coalesce("node_type", F.lit("None")))
    shapes = typed.groupBy("hyperedge_id").agg(F.array_sort(F.collect_list(label)).alias("signature"))
    rows = hyperedges.join(shapes, "hyperedge_id", "left").withColumn("signature", F.coalesce("signature", F.array().cast("array<string>")))
    written = F.concat(F.lit("["), _json(F.col("hyperedge_type")), F.lit(", ["), F.array_join(F.transform("signature", _json), ", "), F.lit("]]"))
    key = F.concat(F.lit(CHANNEL_PREFIX), F.substring(F.sha1(written.cast("binary")), 1, 20))
    return rows.select(key.alias("channel_key"), "hyperedge_id", F.lit(1.0).alias("weight"), F.col("hyperedge_type").alias("relation_family"), "signature", "paper_key", sure(F.col("confidence")).alias("confidence"))


def role_profile(signature: Column) -> Column:
    """Types of each role in a sorted signature, each once."""
    parts = F.transform(signature, lambda x: F.struct(F.substring_index(x, ":", 1).alias("role"), F.regexp_replace(x, "^[^:]*:", "").alias("type")))
    roles = F.array_distinct(parts["role"])
    return F.map_from_arrays(roles, F.transform(roles, lambda r: F.array_distinct(F.filter(parts, lambda p: p["role"] == r)["type"])))


def channels(held: DataFrame) -> DataFrame:
    """channel_key, relation_family, role_profile, support_count, paper_count, confidence, summary."""
    papers = F.count_distinct(F.nullif(F.col("paper_key").cast("string"), F.lit("")))
    found = held.groupBy("channel_key").agg(F.first("relation_family").alias("relation_family"), F.first("signature").alias("_s"), F.count("*").alias("support_count"), papers.alias("paper_count"), F.avg("confidence").alias("confidence"))
    return found.select("channel_key", "relation_family", role_profile(F.col("_s")).alias("role_profile"), "support_count", "paper_count", "confidence", F.concat(F.coalesce("relation_family", F.lit("None")), F.lit(CHANNEL)).alias("summary"))


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, isolated and its ratio, components, largest_comp_ratio, multi_paper_nodes and ratio, avg_degree.

    ``nodes`` has node_id and papers (array).  Edges to unknown nodes count for
    degrees but join nothing.
    """
    known = nodes.select("node_id", (F.size(F.array_distinct(F.coalesce("papers", F.array().cast(nodes.schema["papers"].dataType)))) >= 2).alias("_multi"))
    both = edges.join(nodes.select(F.col("node_id").alias("source_node")), "source_node", "left_semi").join(nodes.select(F.col("node_id").alias("target_node")), "target_node", "left_semi")
    sizes = components(nodes, both).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("_largest"))
    ends = edges.agg(F.count("*").alias("edges"))
    per = degrees(edges, nodes).join(known, "node_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") == 0).alias("isolated"), F.count_if("_multi").alias("multi_paper_nodes"), F.sum("degree").alias("_degrees"))
    one = per.unionByName(sizes, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    one = one.agg(*[F.sum(c).alias(c) for c in one.columns])
    ratio = lambda c, digits: F.round(F.try_divide(F.col(c), F.col("nodes")), digits)
    return one.select("nodes", "edges", "isolated", ratio("isolated", 4).alias("isolated_ratio"), "components", ratio("_largest", 4).alias("largest_comp_ratio"), "multi_paper_nodes", ratio("multi_paper_nodes", 4).alias("multi_paper_ratio"), ratio("_degrees", 3).alias("avg_degree"))
