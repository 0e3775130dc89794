"""Walks through nested JSON of any depth, level by level as VARIANT (rows A20, N04, X14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import stash

# Fixed value: keys whose lists of texts are references.
REFERENCE_KEY = r"(?i)(^|_)(ids?|evidence|references?|hyperedges?)$"
# Fixed value: more rows of a value than this are looked up by a broadcast, of which there are no more than rows / OFTEN.
OFTEN = 100_000
_COLUMNS = ["key", "node", "parent", "depth", "pos", "field", "name", "path", "kind", "v"]


def kind(v: Column) -> Column:
    """object, list, str, int, float, bool or None."""
    told = F.schema_of_variant(v)
    named = F.when(told.startswith("OBJECT"), "object").when(told.startswith("ARRAY"), "list").when(told == "STRING", "str").when(told == "BOOLEAN", "bool").when(told.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int").when(told == "VOID", "None")
    return named.otherwise(F.when(F.regexp_extract(told, r"^DECIMAL\(\d+,\s*(\d+)\)$", 1) == "0", "int").otherwise("float"))


def has(v: Column, field: str) -> Column:
    """Whether an object has a field, null or not."""
    return F.coalesce(F.map_contains_key(F.try_variant_get(v, "$", "map<string,variant>"), field), F.lit(False))


def walk(rows: DataFrame, key: str, text: str, enter: Column | None = None) -> list[DataFrame]:
    """The levels of every row's JSON, the outermost first: key, node, parent, depth, pos, field, name, path, kind, v.

    ``node`` tells a value by the places that lead to it, ``field`` is its key
    in an object, ``name`` the nearest key, ``path`` the keys that lead to it.
    ``enter`` says which objects and lists are entered, all without it.  Each
    level is written before the next is made of it; texts that are no JSON
    have no nodes.
    """
    v = F.try_parse_json(F.col(text))
    none = F.lit(None).cast("string")
    level = rows.select(F.col(key).alias("key"), F.lit("0").alias("node"), none.alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("pos"), none.alias("field"), F.lit("").alias("name"), F.lit("").alias("path"), v.alias("v")).filter("v is not null")
    level = stash(level.withColumn("kind", kind(F.col("v"))).select(*_COLUMNS), "level")
    levels = [level]
    inside = F.col("kind").isin("object", "list") & (F.lit(True) if enter is None else enter)
    while True:
        open_ = level.filter(inside).select("key", "node", "depth", "name", "path", "kind", "v")
        each = open_.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("pos").alias("_p"), F.col("key").alias("_k"), F.col("value").alias("_v")))
        below = each.select("key", F.concat_ws("/", "node", F.col("_p").cast("string")).alias("node"), F.col("node").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("_p").alias("pos"), F.when(F.col("kind") == "object", F.col("_k")).alias("field"), F.when(F.col("kind") == "object", F.col("_k")).otherwise(F.col("name")).alias("name"), F.when((F.col("kind") == "object") & (F.col("path") != ""), F.concat_ws(".", "path", "_k")).when(F.col("kind") == "object", F.col("_k")).otherwise(F.col("path")).alias("path"), F.col("_v").alias("v"))
        level = stash(below.withColumn("kind", kind(F.col("v"))).select(*_COLUMNS), "level")
        if not level.limit(1).count():
            return levels
        levels.append(level)


def attribute_audit(nodes: DataFrame, most: int = 20) -> DataFrame:
    """(metric, name, n) of nodes' attributes (JSON objects): empty ones by type, leaves by kind of value, the most frequent keys.

    An object with value and unit is a number; all others are entered, however
    deep; lists are not.
    """
    number = has(F.col("v"), "value") & has(F.col("v"), "unit")
    told = nodes.select(F.monotonically_increasing_id().alias("_id"), "node_type", "attributes")
    top = F.try_parse_json("attributes")
    bare = F.coalesce(F.size(F.try_variant_get(top, "$", "map<string,variant>")), F.lit(0)) <= 0
    empty = told.groupBy("node_type").agg(F.count_if(bare).alias("n")).select(F.lit("empty").alias("metric"), F.col("node_type").alias("name"), "n")
    levels = walk(told.filter(~bare), "_id", "attributes", (F.col("kind") == "object") & (~number | (F.col("depth") == 0)))
    below = levels[1:] or [levels[0].limit(0)]
    leaves = reduce(DataFrame.unionByName, below)
    shown = F.when((F.col("kind") == "object") & number, "num{value,unit}").when(F.col("kind") != "object", F.col("kind"))
    values = leaves.select(shown.alias("name")).filter("name is not null").groupBy("name").agg(F.count("*").alias("n")).select(F.lit("value").alias("metric"), "name", "n")
    keys = leaves.groupBy(F.col("path").alias("name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(most).select(F.lit("key").alias("metric"), "name", "n")
    return empty.unionByName(values).unionByName(keys)


def _known(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with whether their _value is an id, else null.

    Rows without a value need no look-up, and those of the few values that very
    many have are told by a broadcast, so that no key fills a task by itself.
    """
    asked = rows.filter("_value is not null")
    often = asked.groupBy("_value").agg(F.count("*").alias("_n")).filter(F.col("_n") > OFTEN).select(F.col("_value").alias("_id"))
    often = often.join(ids, "_id", "left").select(F.col("_id").alias("_value"), F.col("_known"), F.lit(True).alias("_often"))
    told = rows.join(F.broadcast(often), "_value", "left")
    rare = F.col("_value").isNotNull() & F.col("_often").isNull()
    looked_up = told.filter(rare).drop("_known").join(ids.hint("merge"), F.col("_value") == F.col("_id"), "left")
    return told.filter(~rare).select(*rows.columns, "_known").unionByName(looked_up.select(*rows.columns, "_known"))


def sanitise(rows: DataFrame, key: str, text: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, json) with references that are known, and (key, value, verdict, place) of those that are not.

    A list of texts whose nearest key names references keeps each known id
    once; of the others what is shaped like an id is invalid, and prose is
    misplaced.  Everything else stays, at any depth; objects have their keys in
    order.  ``known`` has id.
    """
    nodes = reduce(DataFrame.unionByName, walk(rows, key, text))
    # a list of references: all its children are texts
    children = nodes.filter("parent is not null").groupBy("key", F.col("parent").alias("node")).agg(F.bool_and(F.col("kind") == "str").alias("_texts"))
    lists = nodes.filter((F.col("kind") == "list") & F.col("name").rlike(REFERENCE_KEY)).select("key", "node").join(children.filter("_texts"), ["key", "node"]).select("key", F.col("node").alias("parent"), F.lit(True).alias("_listed"))
    ids = known.select(F.col("id").alias("_id")).distinct().withColumn("_known", F.lit(True))
    listed = nodes.join(lists.hint("merge"), ["key", "parent"], "left").withColumn("_value", F.when(F.col("_listed"), T.strip(F.try_variant_get("v", "$", "string"))))
    marked = stash(_known(stash(listed, "listed"), ids), "marked")
    verdict = F.when(T.is_reference_id(F.col("_value")), "invalid").otherwise("misplaced")
    notes = marked.filter("_listed and _known is null and _value != ''").select("key", F.col("_value").alias("value"), verdict.alias("verdict"), F.col("node").alias("place"))
    # of equal known ids in a list the first stays
    firsts = marked.filter("_listed and _known").groupBy("key", "parent", "_value").agg(F.min("pos").alias("pos")).select("key", "parent", "pos", F.lit(True).alias("_first"))
    kept = marked.join(firsts, ["key", "parent", "pos"], "left").filter("_listed is null or _first")
    leaf = F.when(F.col("_listed"), F.to_json(F.array("_value"))).otherwise(F.to_json(F.array("v")))
    bare = F.substring(leaf, F.lit(2), F.length(leaf) - 2)
    told = stash(kept.select("key", "node", "parent", "depth", "pos", "field", "kind", F.when(~F.col("kind").isin("object", "list"), bare).alias("json")), "told")
    deepest = told.agg(F.max("depth")).first()[0] or 0
    made = told.filter(F.col("depth") == deepest)
    quoted = F.to_json(F.array("field"))
    for depth in range(deepest, -1, -1):
        parts = made.withColumn("json", F.coalesce("json", F.when(F.col("kind") == "object", "{}").otherwise("[]")))
        if not depth:
            break
        item = F.when(F.col("field").isNotNull(), F.concat(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit(":"), "json")).otherwise(F.col("json"))
        inner = parts.groupBy("key", F.col("parent").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("j")))), lambda x: x["j"]), ",").alias("_inner"))
        made = told.filter(F.col("depth") == depth - 1).join(inner, ["key", "node"], "left")
        wrapped = F.when(F.col("kind") == "object", F.concat(F.lit("{"), "_inner", F.lit("}"))).when(F.col("kind") == "list", F.concat(F.lit("["), "_inner", F.lit("]")))
        made = made.withColumn("json", F.coalesce("json", wrapped)).drop("_inner")
    return parts.select(F.col("key").alias(key), "json"), notes.withColumnRenamed("key", key)
