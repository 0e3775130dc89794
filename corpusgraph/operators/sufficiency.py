"""Whether a library can carry a section: six dimensions, their gates and a verdict (rows M13, M14, A09, A10).

Sections are a few settings that the caller has; papers are matched with all
of them in one scan, and what is counted of the matches are sums by section.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import stash
from .study import requirement_status

# Dimensions with their weights, decisions that let a paper count, and how much is looked at.
WEIGHTS = {"papers": 0.30, "knowledge": 0.25, "conditions": 0.20, "requirements": 0.15, "evidence": 0.10, "comparison": 0.05}
DECISIONS = ("knowledge", "direct", "flagged")
TOKENS, REQUIREMENTS, HYPEREDGES, EDGES = 12, 10, 40, 10


@dataclass(frozen=True)
class Section:
    """What a section asks for; with a template only its required dimensions are gates."""

    key: str
    tokens: tuple[str, ...] = ()
    requirements: tuple[str, ...] = ()
    cited: int = 0
    rounds_done: int = 0
    template: bool = False
    required: tuple[str, ...] = ()
    weights: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Floors:
    """The least of each dimension, and when collection ends; ``adaptive`` lowers those that a small library cannot reach."""

    papers: int = 6
    knowledge: float = 0.6
    conditions: float = 0.3
    requirements: float = 0.5
    evidence: int = 3
    comparison: int = 1
    threshold: float = 0.62
    rounds: int = 2
    adaptive: bool = True


def matched(papers: DataFrame, quality: DataFrame, sections: list[Section]) -> DataFrame:
    """section, paper_key of papers that are ingested, or decided for, and hold one of a section's first tokens."""
    known = papers.join(quality.select("paper_key", "decision"), "paper_key", "left").filter((F.col("status") == "ingested") | F.col("decision").isin(*DECISIONS))
    text = F.lower(F.concat_ws("\x01", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "abstract", "keywords")]))
    hits = [F.when(T.contains_any(text, [t.lower() for t in s.tokens[:TOKENS]]), F.lit(s.key)) for s in sections if s.tokens]
    none = F.array().cast("array<string>")
    return known.select("paper_key", F.explode(F.array_compact(F.array(*hits)) if hits else none).alias("section")).distinct()


def groups_of(rows: DataFrame, kind: str) -> Column | int:
    """Kinds that have more than one row."""
    return rows.groupBy(kind).agg(F.count("*").alias("n")).filter("n > 1").count()


def evaluate(tables: dict[str, DataFrame], sections: list[Section], floors: Floors = Floors()) -> DataFrame:
    """A row for each section: what was counted, the six scores, confidence, decision, failed gates.

    ``tables`` has papers (paper_key, status, title, abstract, keywords),
    quality (paper_key, decision), log (paper_key, event), hyperedges
    (hyperedge_id, hyperedge_type, paper_key), conditions and measurements
    (hyperedge_id), edges (relation_type), texts (text) and names (name) for
    requirements.  A weighted mean may hide a dimension that fails: each gate
    that fails caps the confidence below the threshold.
    """
    spark = tables["papers"].sparkSession
    hits = stash(matched(tables["papers"], tables["quality"], sections), "matched")
    extracted = tables["log"].filter("event = 'extracted'").select("paper_key").distinct()
    measured = tables["conditions"].select("hyperedge_id").unionByName(tables["measurements"].select("hyperedge_id")).distinct().withColumn("_q", F.lit(1))
    facts = tables["hyperedges"].select("hyperedge_id", "paper_key").join(hits, "paper_key").join(measured, "hyperedge_id", "left")
    asked = spark.createDataFrame([(s.key, t) for s in sections for t in [t for t in s.requirements if len(t) >= 2][:REQUIREMENTS]], "ref string, token string")
    status = requirement_status(asked, tables["texts"], tables["names"])
    sums = [
        hits.groupBy("section").agg(F.count("*").alias("matched")),
        hits.join(extracted, "paper_key", "left_semi").groupBy("section").agg(F.count("*").alias("extracted")),
        facts.groupBy("section").agg(F.count("*").alias("hyperedges"), F.count("_q").alias("quantified")),
        status.groupBy(F.col("ref").alias("section")).agg(F.count_if(F.col("status") == "covered").alias("covered"), F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "unverifiable").alias("unverifiable")),
    ]
    counts = ["matched", "extracted", "hyperedges", "quantified", "covered", "missing", "unverifiable"]
    # what holds for the whole library
    evidence = tables["hyperedges"].limit(HYPEREDGES).count() or tables["edges"].limit(EDGES).count()
    comparison = groups_of(tables["hyperedges"], "hyperedge_type") or groups_of(tables["edges"], "relation_type")
    library = tables["papers"].filter("status = 'ingested'").count()
    rows = []
    for s in sections:
        papers, proofs = floors.papers, floors.evidence
        if s.cited:
            papers, proofs = max(2, min(papers, s.cited + 1)), max(1, min(proofs, s.cited))
        elif floors.adaptive:
            papers = max(2, min(papers, library)) if papers > 2 and library else papers
            proofs = max(1, min(proofs, evidence or 1))
        weights = {d: float(s.weights.get(d, 0.0)) for d in WEIGHTS} if s.weights else dict(WEIGHTS)
        rows.append((s.key, papers, proofs, 1 if floors.adaptive and not comparison else floors.comparison, bool(s.tokens), s.template, list(s.required), s.rounds_done, weights))
    schema = "section string, min_papers int, min_evidence int, min_comparison int, _asked boolean, _template boolean, _required array<string>, rounds_done int, _w map<string,double>"
    out = spark.createDataFrame(rows, schema)
    for df in sums:
        out = out.join(F.broadcast(df), "section", "left")  # a row for each section
    out = out.fillna(0, counts).withColumns({"evidence_ids": F.lit(evidence), "comparison_groups": F.lit(comparison)})
    ratio = lambda a, b, other: F.coalesce(F.try_divide(F.col(a).cast("double"), b), F.lit(other))
    full = {
        "papers": F.least(F.lit(1.0), F.col("matched") / F.greatest(F.lit(1), "min_papers")),
        "knowledge": ratio("extracted", F.col("matched"), 0.0),
        "conditions": ratio("quantified", F.col("hyperedges"), 0.0),
        "requirements": ratio("covered", F.col("covered") + F.col("missing"), 1.0),
        "evidence": F.least(F.lit(1.0), F.col("evidence_ids") / F.greatest(F.lit(1), "min_evidence")),
        "comparison": F.least(F.lit(1.0), F.col("comparison_groups") / F.greatest(F.lit(1), "min_comparison")),
    }
    needs = lambda d: F.array_contains("_required", d)
    gates = {
        "papers": (F.col("_asked"), F.col("matched") >= F.col("min_papers")),
        "knowledge": (F.col("matched") > 0, full["knowledge"] >= floors.knowledge),
        "conditions": ((F.col("hyperedges") > 0) | (F.col("_template") & needs("conditions")), full["conditions"] >= floors.conditions),
        "requirements": (F.col("covered") + F.col("missing") + F.col("unverifiable") > 0, full["requirements"] >= floors.requirements),
        "evidence": (F.col("matched") > 0, F.col("evidence_ids") >= F.col("min_evidence")),
        "comparison": (F.col("_template") & needs("comparison"), F.col("comparison_groups") >= F.col("min_comparison")),
    }
    failed = F.array_compact(F.array(*[F.when(there & ~passed & (~F.col("_template") | needs(d)), d) for d, (there, passed) in gates.items()]))
    out = out.withColumns({d: F.round(c, 3) for d, c in full.items()} | {"failed": failed})
    total = reduce(lambda a, b: a + b, [F.col("_w")[d] for d in WEIGHTS])
    mean = reduce(lambda a, b: a + b, [F.col(d) * F.col("_w")[d] for d in WEIGHTS]) / F.when(total == 0, 1.0).otherwise(total)
    capped = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)), 3)
    out = out.withColumn("confidence", F.when(F.size("failed") > 0, F.round(F.least(capped, F.lit(floors.threshold - 0.001)), 3)).otherwise(capped))
    decision = F.when(F.col("confidence") >= floors.threshold, "sufficient").when(F.col("rounds_done") >= floors.rounds, "exhausted").otherwise("insufficient")
    return out.withColumn("decision", decision).drop("_asked", "_template", "_required", "_w")
