"""What models answer, made into typed rows (rows N01, N02, N04, N06, N08, N09, Q01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# Relations that say little, traces of quantities, limits of an issue list.
GENERIC_RELATIONS = ("related_to",)
QUANTITY_HINTS = (
    "°c", "℃", " mol%", "mol %", " equiv", " h ", " min", "toluene", "thf", "dcm", "dce", "dmf", "dioxane", "yield", "收率", "产率", "%", "ee", "dr ",
    "p <", "p =", "p=", "n =", "n=", "小时", "当量", "催化剂", "溶剂", "温度",
)
LEAST, MOST = 0.6, 12


def json_list(c: Column, item: str = "string") -> Column:
    """A JSON array, or an empty one for anything else."""
    good = F.schema_of_variant(F.try_parse_json(c)).startswith("ARRAY")
    return F.coalesce(F.from_json(F.when(good, c), f"array<{item}>"), F.from_json(F.lit("[]"), f"array<{item}>"))


def json_object(c: Column) -> Column:
    """A JSON object as a map of texts, or an empty one for anything else."""
    good = F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT")
    return F.coalesce(F.from_json(F.when(good, c), "map<string,string>"), F.create_map().cast("map<string,string>"))


def model_json(c: Column, schema: str) -> Column:
    """The object from the first { to the last } of an answer, without code fences; control characters in texts are borne; null where there is none."""
    bare = F.regexp_replace(F.regexp_replace(T.strip(F.coalesce(c, F.lit(""))), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    found = F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))
    return F.from_json(found, schema, {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE"})


def sanitise_references(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (row_id, path, value) with verdict: valid, invalid (shaped like an id but unknown) or misplaced (prose where an id belongs)."""
    ids = known.select(F.col("id").alias("_k")).distinct().withColumn("_known", F.lit(True))
    value = F.trim(F.coalesce("value", F.lit("")))
    verdict = F.when(F.col("_known"), "valid").when(T.is_reference_id(F.col("_v")), "invalid").otherwise("misplaced")
    return rows.withColumn("_v", value).filter("_v != ''").join(ids, F.col("_v") == F.col("_k"), "left").select(*rows.columns, verdict.alias("verdict"))


def gap(c: Column) -> Column:
    """A gap (struct of texts and a support) with its fields trimmed and defaults for what is missing."""
    said = lambda name, other="": F.coalesce(F.nullif(F.trim(c[name]), F.lit("")), F.lit(other))
    return F.struct(said("source").alias("source"), said("relation", "related_to").alias("relation"), said("target").alias("target"), F.greatest(F.lit(0), F.coalesce(c["support"].try_cast("int"), F.lit(0))).alias("support"))


def resolve_fields(*layers: tuple[str, DataFrame]) -> DataFrame:
    """Key, field, value, source: each field's value by the first layer that gives one; layers are (name, rows of key, field, value), the strongest first."""
    rows = None
    for rank, (name, df) in enumerate(layers):
        part = df.filter(F.trim(F.coalesce("value", F.lit(""))) != "").select("key", "field", F.struct(F.lit(rank).alias("rank"), "value", F.lit(name).alias("source")).alias("_v"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("key", "field").agg(F.min("_v").alias("_v")).select("key", "field", "_v.value", "_v.source")


def brief(c: Column, most: int = 120) -> Column:
    """The start of a step's output on one line."""
    text = T.squeeze(F.coalesce(c, F.lit("")))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("…")))


def issues(payloads: DataFrame, least: float = LEAST, most: int = MOST) -> DataFrame:
    """Q01: paper_key, seq, n, part, place, issue: what of a payload should be asked again, the first ``most`` of each.

    Entities: no name, a reporting phrase, low confidence; relations: a
    generic type, low confidence; events: low confidence; hyperedges: traces of
    quantities without conditions or measurements.
    """
    part = lambda i, name: payloads.select("paper_key", "seq", F.lit(i).alias("order"), F.lit(name[:-1]).alias("part"), F.posexplode(f"payload.{name}").alias("place", "x"))
    x, low = F.col("x"), F.coalesce(F.col("x.confidence"), F.lit(0.5)) < least
    name = F.trim(F.coalesce(x["name"], F.lit("")))
    found = part(0, "entities").withColumn("issue", F.when(name == "", "unnamed").when(T.is_reporting_phrase(name), "reporting").when(low, "unsure")).drop("x")
    kind = F.lower(F.trim(F.coalesce(x["type"], F.lit(""))))
    found = found.unionByName(part(1, "relations").withColumn("issue", F.when(kind.isin(*GENERIC_RELATIONS), "generic").when(low, "unsure")).drop("x"))
    found = found.unionByName(part(2, "events").withColumn("issue", F.when(low, "unsure")).drop("x"))
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    blob = F.lower(F.concat_ws(" ", F.coalesce(x["label"], F.lit("")), F.coalesce(x["evidence"], F.lit("")), F.array_join(F.transform(x["members"], lambda m: F.coalesce(m["name"], F.lit(""))), " ")))
    lacking = F.array_join(F.array_compact(F.array(F.when(none(x["conditions"]), "conditions"), F.when(none(x["measurements"]), "measurements"))), "/")
    found = found.unionByName(part(3, "hyperedges").withColumn("issue", F.when((lacking != "") & T.contains_any(blob, list(QUANTITY_HINTS)), F.concat(F.lit("missing "), lacking))).drop("x"))
    one = found.filter("issue is not null").groupBy("paper_key", "seq").agg(F.slice(F.array_sort(F.collect_list(F.struct("order", "place", "part", "issue"))), 1, most).alias("_i"))
    return one.select("paper_key", "seq", F.posexplode("_i").alias("n", "i")).select("paper_key", "seq", "n", "i.part", "i.place", "i.issue")
