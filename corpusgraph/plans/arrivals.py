"""Queries of the literature reader and of budgets over the test tables; pages of answers are written from the parts first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import budgets
from ..sources import readers
from ..storage import scratch_dir
from . import bindings as B
from .registry import query


def answered(spark, d) -> str:
    """A folder of pages: each part is an item of three services; one page of one service is cut short."""
    k = F.col("p_partkey")
    services = F.array(F.lit("arxiv"), F.lit("europepmc"), F.lit("openalex"))
    rows = B.table(spark, d, "part").select("p_partkey", "p_brand", "p_name", F.posexplode(services).alias("s", "service")).withColumn("page", (k / 100).cast("int"))
    doi = F.when(k % 2 == 0, F.concat(F.lit('"10.1/'), F.when(F.col("s") == 1, F.upper("p_name")).otherwise(F.col("p_name")), F.lit('"'))).otherwise("null")
    item = F.concat(F.lit('{"paper_key": "'), F.col("service"), F.lit(":"), k.cast("string"), F.lit('", "doi": '), doi, F.lit(', "brand": "'), "p_brand", F.lit('"}'))
    lists = rows.groupBy("service", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("i")))), lambda x: x["i"]), ", ").alias("_i"))
    whole = F.when((F.col("service") == "europepmc") & (F.col("page") % 5 == 2), F.concat(F.lit('{"items": ['), "_i")).otherwise(F.concat(F.lit('{"items": ['), "_i", F.lit("]}")))
    folder = f"{scratch_dir(spark)}/pages-{uuid.uuid4().hex}"
    # each task moves its own files into place; the folder is new, and read only once it is whole
    lists.select("service", "page", whole.alias("value")).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("service", "page").text(folder)
    return folder


_ITEMS = "i as (select p_partkey as k, p_partkey // 100 as page, p_brand, service, rank, case when p_partkey % 2 = 0 then '10.1/' || p_name end as doi from part, (values ('europepmc', 1), ('arxiv', 3), ('openalex', 5)) v(service, rank) where not (service = 'europepmc' and p_partkey // 100 % 5 = 2))"


@query("s01_search", f"with {_ITEMS}, firsts as (select *, row_number() over (partition by p_brand, coalesce(doi, service || k) order by rank, page, k) as n from i), kept as (select *, row_number() over (partition by p_brand order by rank, page, k) as place from firsts where n = 1) select p_brand as query, service, service || ':' || k as paper_key from kept where place <= 20")
def s01_search(spark, d):
    return readers.search(spark, answered(spark, d), "$.brand", "all", 20)[0].select("query", "service", "paper_key")


@query("s01_report", f"with {_ITEMS}, broken as (select count(distinct p_partkey // 100) as n from part where p_partkey // 100 % 5 = 2) select s.service, count(k) as hits, case when s.service = 'europepmc' then any_value(n) else 0 end as errors, s.service = 'europepmc' and any_value(n) > 0 as failed from (values ('europepmc'), ('pubmed'), ('arxiv'), ('semantic_scholar'), ('openalex')) s(service) left join i using (service), broken group by 1")
def s01_report(spark, d):
    return readers.search(spark, answered(spark, d), "$.brand", "all", 20)[1].select("service", "hits", "errors", F.col("first_error").isNotNull().alias("failed"))


@query("s09_pages", f"with {_ITEMS} select service, page::int as page, count(*) as items from i where service = 'europepmc' group by 1, 2")
def s09_pages(spark, d):
    rows = readers.pages(spark, answered(spark, d)).filter("service = 'europepmc' and error is null")
    return rows.groupBy("service", "page").agg(F.count("*").alias("items"))


def bundles(spark, d):
    """For each brand and size class the rendered parts, smaller ones as patterns, others as hyperedges."""
    card = F.concat(F.lit('{"id": '), F.col("p_partkey").cast("string"), F.lit(', "name": "'), "p_name", F.lit('"}'))
    rows = B.table(spark, d, "part").select("p_brand", "p_partkey", card.alias("card"), (F.col("p_size") % 3 == 0).alias("small"))
    lists = lambda small: F.transform(F.array_sort(F.collect_list(F.when(F.col("small") == small, F.struct("p_partkey", "card")))), lambda x: x["card"])
    return rows.groupBy("p_brand").agg(lists(True).alias("patterns"), lists(False).alias("hyperedges"))


_CARDS = """c as (select p_brand, p_size % 3 = 0 as small, length('{"id": ' || p_partkey || ', "name": "' || p_name || '"}') as n, row_number() over (partition by p_brand, p_size % 3 = 0 order by p_partkey) as k from part), b as (select p_brand, count(*) filter (small) as p, count(*) filter (not small) as h from c group by 1)"""


@query("w10_ladder", f"""with {_CARDS}, steps(step, p_most, h_most) as (values {', '.join(f"({i}, {s['patterns']}, {s['hyperedges']})" for i, s in enumerate(budgets.CONTENT_STEPS))}),
 sized as (select c.p_brand, step, p_most, h_most, 100 + sum(n) filter (k <= case when small then p_most else h_most end) + 2 * greatest(0, least(any_value(p), p_most) - 1) + 2 * greatest(0, least(any_value(h), h_most) - 1) as chars from c join b using (p_brand), steps group by 1, 2, 3, 4),
 best as (select p_brand, coalesce(min(step) filter (chars <= 600), {len(budgets.CONTENT_STEPS) - 1}) as step from sized group by 1)
 select p_brand, step, chars::bigint as chars, chars > 600 as truncated, least(p, p_most) as patterns, least(h, h_most) as hyperedges from best join sized using (p_brand, step) join b using (p_brand)""")
def w10_ladder(spark, d):
    shapes = [{n: s[n] for n in ("patterns", "hyperedges")} for s in budgets.CONTENT_STEPS]
    out = budgets.ladder(bundles(spark, d), {"patterns": "patterns", "hyperedges": "hyperedges"}, F.lit(100), shapes, 600)
    return out.select("p_brand", "step", "chars", "truncated", F.size("patterns").cast("long").alias("patterns"), F.size("hyperedges").cast("long").alias("hyperedges"))


@query("w10_consumer", f"""with recursive {_CARDS}, states as (select p_brand, 0 as step, least(h, 90) as h, least(p, 24) as p from b union all select p_brand, step + 1, case when h > 30 then h - 10 else h end, case when h > 30 then p else p - 4 end from states where h > 30 or p > 8),
 sized as (select c.p_brand, step, s.h, s.p, 50 + coalesce(sum(n) filter (k <= case when small then s.p else s.h end), 0) + 2 * greatest(0, s.p - 1) + 2 * greatest(0, s.h - 1) as chars from states s join c using (p_brand) group by 1, 2, 3, 4),
 ranked as (select *, row_number() over (partition by p_brand order by chars > 1500, case when chars > 1500 then -step else step end) as r from sized)
 select p_brand, chars::bigint as chars, h as hyperedges, p as patterns from ranked where r = 1""")
def w10_consumer(spark, d):
    rows = bundles(spark, d)
    out = budgets.ladder(rows, {"patterns": "patterns", "hyperedges": "hyperedges"}, F.lit(50), budgets.consumer_shapes(F.size("hyperedges"), F.size("patterns")), 1500)
    return out.select("p_brand", "chars", F.size("hyperedges").cast("long").alias("hyperedges"), F.size("patterns").cast("long").alias("patterns"))


@query("w11_targets", "with a as (select 'c' || o_custkey as key, 0 as l, o_orderkey as pos from orders where o_orderpriority = '1-URGENT' union all select 'c' || c_custkey, 1, c_custkey from customer), f as (select key, min(l * 1000000000 + pos) as first_at from a group by 1) select key, row_number() over (order by first_at, key)::int as place from f qualify place <= 900")
def w11(spark, d):
    urgent = B.table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderkey").alias("pos"))
    others = B.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_custkey").alias("pos"))
    return budgets.targets(900, urgent, others)
