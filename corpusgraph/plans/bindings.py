"""The engine's tables over the test tables: papers, log, nodes, edges, hyperedges; for Spark, and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import tasks


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def placed(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table with _at, the place of each row in it: what an order leaves open goes by that, as in the SQL's engine."""
    df = table(spark, d, name)
    file = [F.col("_metadata.file_path").alias("file")] if len(df.inputFiles()) > 1 else []
    return df.withColumn("_at", F.struct(*file, F.col("_metadata.row_index").alias("row")))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all tasks of a shuffle: a table of few bytes is one split, however much work its rows are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def papers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.concat_ws(":", "source", "doc_id").alias("paper_key"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), "lang", "source", "n_chars", F.col("text").alias("clean_text"))


PAPERS = "papers as (select doc_id, source || ':' || doc_id as paper_key, split_part(text, chr(10), 1) as title, lang, source, n_chars, text as clean_text from documents)"


def works(spark: SparkSession, d: str) -> DataFrame:
    """part as works: venue, h proxy, citations and year."""
    lines, orders = table(spark, d, "lineitem").select("l_partkey", "l_orderkey"), table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    cited = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).groupBy("l_partkey").agg(F.count("*").alias("citation_count"), F.max("y").alias("pub_year"))
    return table(spark, d, "part").join(cited, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("venue"), F.col("p_size").alias("h"), "citation_count", "pub_year")


WORKS = """works as (select p_partkey, p_name as title, p_brand as venue, p_size as h, citation_count, pub_year from part left join
 (select l_partkey, count(*) as citation_count, max(year(o_orderdate)) as pub_year from lineitem join orders on l_orderkey = o_orderkey group by 1) c on p_partkey = l_partkey)"""


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("paper_id"), F.col("event_type").alias("event"), F.col("props").alias("details"), "ts", "value")


LOG = "log as (select event_id as id, user_id as paper_id, event_type as event, props as details, ts, value from events)"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    kinds = (("part", "p_partkey", "p_name", "material"), ("supplier", "s_suppkey", "s_name", "organization"), ("nation", "n_nationkey", "n_name", "place"), ("region", "r_regionkey", "r_name", "area"))
    out = None
    for i, (name, key, label, kind) in enumerate(kinds):
        df = table(spark, d, name).select((F.col(key).cast("long") * 4 + i).alias("node_id"), F.lit(kind).alias("node_type"), F.col(label).alias("name"))
        out = df if out is None else out.unionByName(df)
    return out


NODES = """nodes as (select p_partkey * 4 as node_id, 'material' as node_type, p_name as name from part
 union all select s_suppkey * 4 + 1, 'organization', s_name from supplier
 union all select cast(n_nationkey as bigint) * 4 + 2, 'place', n_name from nation
 union all select cast(r_regionkey as bigint) * 4 + 3, 'area', r_name from region)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """relation_type, source_node, target_node, confidence, support."""
    line = table(spark, d, "lineitem")
    lines = line.repartition(tasks(spark, line.count()), "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.max(F.col("l_discount") + F.col("l_tax")).alias("m"), F.count_distinct("l_orderkey").alias("support"))
    supplied = lines.select(F.lit("supplied_by").alias("relation_type"), (F.col("l_partkey") * 4).alias("source_node"), (F.col("l_suppkey") * 4 + 1).alias("target_node"), F.round(1 - 4 * F.col("m"), 4).alias("confidence"), "support")
    located = table(spark, d, "supplier").select(F.lit("located_in").alias("relation_type"), (F.col("s_suppkey") * 4 + 1).alias("source_node"), (F.col("s_nationkey").cast("long") * 4 + 2).alias("target_node"), F.lit(0.9).alias("confidence"), F.lit(1).cast("long").alias("support"))
    part_of = table(spark, d, "nation").select(F.lit("part_of").alias("relation_type"), (F.col("n_nationkey").cast("long") * 4 + 2).alias("source_node"), (F.col("n_regionkey").cast("long") * 4 + 3).alias("target_node"), F.lit(0.95).alias("confidence"), F.lit(1).cast("long").alias("support"))
    return supplied.unionByName(located).unionByName(part_of)


def sizes(spark: SparkSession, d: str) -> dict[str, int]:
    """About how many edges and members there are: a line makes one edge and two members at most."""
    n = table(spark, d, "lineitem").count()
    return {"edges": n, "members": 2 * n}


EDGES = """edges as (select 'supplied_by' as relation_type, l_partkey * 4 as source_node, l_suppkey * 4 + 1 as target_node, round(1 - 4 * max(l_discount + l_tax), 4) as confidence, count(distinct l_orderkey) as support from lineitem group by l_partkey, l_suppkey
 union all select 'located_in', s_suppkey * 4 + 1, cast(s_nationkey as bigint) * 4 + 2, 0.9, 1 from supplier
 union all select 'part_of', cast(n_nationkey as bigint) * 4 + 2, cast(n_regionkey as bigint) * 4 + 3, 0.95, 1 from nation)"""

_KIND = {"1-URGENT": "event", "2-HIGH": "mechanism", "3-MEDIUM": "reaction"}


def hyperedges(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    kind = F.lit("relation")
    for k, v in _KIND.items():
        kind = F.when(F.col("o_orderpriority") == k, v).otherwise(kind)
    return o.select(F.col("o_orderkey").alias("hyperedge_id"), kind.alias("hyperedge_type"), F.col("o_orderstatus").alias("label"), F.col("o_custkey").alias("paper_key"), F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.round(F.col("o_totalprice") / 600000, 3)).alias("confidence"))


HYPEREDGES = """hyperedges as (select o_orderkey as hyperedge_id, case o_orderpriority when '1-URGENT' then 'event' when '2-HIGH' then 'mechanism' when '3-MEDIUM' then 'reaction' else 'relation' end as hyperedge_type,
 o_orderstatus as label, o_custkey as paper_key, case when o_orderstatus = 'P' then 0.0 else round(o_totalprice / 600000, 3) end as confidence from orders)"""


def members(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    product = line.select(F.col("l_orderkey").alias("hyperedge_id"), (F.col("l_partkey") * 4).alias("node_id"), F.lit("product").alias("role"))
    source = line.select(F.col("l_orderkey").alias("hyperedge_id"), (F.col("l_suppkey") * 4 + 1).alias("node_id"), F.lit("source").alias("role"))
    return product.unionByName(source).repartition(tasks(spark, 2 * line.count()), "hyperedge_id").distinct()


MEMBERS = "members as (select distinct * from (select l_orderkey as hyperedge_id, l_partkey * 4 as node_id, 'product' as role from lineitem union all select l_orderkey, l_suppkey * 4 + 1, 'source' from lineitem))"
