"""Scores as Column expressions (inventory rows M...)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import plural_variants

# Weights, thresholds and neutral scores.
QUARTILE_SCORES = {"Q1": 0.95, "Q2": 0.8, "Q3": 0.65, "Q4": 0.5}
AUTHORITY = {"venue": 0.5, "h": 0.3, "citations": 0.2}
HALF_LIFE = {"fast": 2.0, "medium": 4.0, "slow": 8.0}
DIRECT, FLAGGED = 0.8, 0.5


def venue_factor(quartile: Column, venue: Column, kind: Column) -> Column:
    """A venue's score by quartile, else a neutral one by type."""
    chain = None
    for q, score in QUARTILE_SCORES.items():
        chain = F.when(quartile == q, score) if chain is None else chain.when(quartile == q, score)
    kind, venue = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(venue, F.lit("")))
    return (
        chain.when(venue == "arxiv", 0.5)
        .when(kind == "journal", 0.6)
        .when(kind.isin("repository", "preprint", "posted-content"), 0.5)
        .when((kind == "proceedings") | venue.contains("conference"), 0.65)
        .otherwise(0.55)
    )


def h_factor(h: Column) -> Column:
    """M02."""
    return F.coalesce(F.least(F.lit(1.0), 0.4 + 0.58 * F.greatest(F.lit(0.0), F.least(h.cast("double"), F.lit(80.0))) / 80), F.lit(0.5))


def citation_factor(n: Column) -> Column:
    """M03."""
    return F.when(n.isNull(), 0.5).when(n <= 0, 0.3).otherwise(F.least(F.lit(1.0), 0.35 + 0.22 * F.log10(n + 1.0)))


def authority(venue: Column, h: Column, citations: Column) -> Column:
    """M04."""
    return AUTHORITY["venue"] * venue + AUTHORITY["h"] * h + AUTHORITY["citations"] * citations


def timeliness(year: Column, now: int, velocity: str = "medium") -> Column:
    """Full for work of this year, neutral without a year."""
    age = F.greatest(F.lit(now) - year, F.lit(0)).cast("double")
    decay = 0.7 * F.exp(F.lit(-0.6931471805599453) * age / HALF_LIFE[velocity]) + 0.3 * F.greatest(F.lit(0.0), 1 - age / 25)
    return F.when(year.isNull(), 0.5).when(age <= 0, 1.0).otherwise(decay)


def quality(authority: Column, timeliness: Column) -> Column:
    """M06."""
    return 0.6 * authority + 0.4 * timeliness


def route(q: Column) -> Column:
    """Where a quality leads."""
    return F.when(q >= DIRECT, "direct").when(q >= FLAGGED, "flagged").otherwise("human")


def decision(complete: Column, attempts: Column, route: Column) -> Column:
    """Enrich incomplete metadata up to three times, then ask a human."""
    return F.when(~complete & (attempts < 3), "enrich").when(~complete, "human").when(route == "direct", "knowledge").otherwise(route)


def blend(model: Column, q: Column, flagged: Column) -> Column:
    """A model's confidence with its paper's quality."""
    own = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(model.try_cast("double"), F.lit(0.5))))
    return 0.6 * own + 0.4 * q * F.when(flagged, 0.85).otherwise(1.0)


def token_score(tokens: Column, text: Column, weight: int = 1) -> Column:
    """Each token that stands in the text, in either number, counts by its length, 2 to 12."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hit = lambda t: F.exists(plural_variants(t), lambda v: F.contains(low, v))
    worth = lambda t: F.when(hit(t), weight * F.greatest(F.lit(2), F.least(F.length(t), F.lit(12)))).otherwise(0)
    return F.aggregate(tokens, F.lit(0), lambda a, t: a + worth(t))


def token_score_of(tokens: list[str], text: Column, weight: int = 1) -> Column:
    """M09 for tokens that are known beforehand; folds to plain string searches."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for t in tokens:
        other = t[:-3] + "y" if t.endswith("ies") and len(t) > 4 else t[:-2] if t.endswith("es") and len(t) > 3 else t[:-1] if t.endswith("s") and len(t) > 3 else t + "s"
        total = total + F.when(low.contains(t) | low.contains(other), weight * max(2, min(len(t), 12))).otherwise(0)
    return total


def topic_overlap(tokens: Column, text: Column) -> Column:
    """Share of the tokens' length that the text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    length = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))
    return F.coalesce(F.try_divide(length(F.filter(tokens, lambda t: F.contains(low, t))), length(tokens)), F.lit(0.0))


def keyword_hits(text: Column, words: list[str]) -> Column:
    """How many of the words the text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.when(low.contains(w.lower()), 1).otherwise(0) for w in words), F.lit(0))


def hyperedge_score(label_score: Column, name_score: Column, kind: Column, label: Column, mechanism: Column, condition: Column, confidence: Column, low_value: list[str]) -> Column:
    """M12."""
    low = (kind == "relation") & label.isin(low_value)
    return (label_score + name_score).cast("double") + F.when(kind == "event", 1.5).otherwise(0.0) + 2.0 * F.least(mechanism, F.lit(4)) + 0.5 * F.least(condition, F.lit(2)) - F.when(low, 3.0).otherwise(0.0) + 0.01 * F.coalesce(confidence, F.lit(0.0))


def candidate_score(rank: Column, ratio: Column, evidence: Column, breaks: Column, low: Column) -> Column:
    """M17."""
    return 3.0 * F.least(rank, F.lit(4)) + 2.5 * ratio + 1.5 * F.least(evidence, F.lit(6)) / 6 - breaks - low


def completeness(missing: Column) -> Column:
    """1 less a quarter for each missing part."""
    return 1 - F.size(missing) / 4
