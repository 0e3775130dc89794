"""URL verdicts by rules, and by trust that propagates over links between hosts.

Rules decide first.  Their allowed and blocked hosts are the seeds of two
walks with restart: trust follows links from trusted hosts, distrust follows
them backwards from blocked ones, since who links to a blocked host shares in
it.  A host is blocked whose distrust reaches a threshold and outweighs its
trust.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stash

#: (verdict, host with its path); the longest that fits wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING, EVERY = 0.85, 4
#: Walks go on until no score changes by more than PRECISION of a seed's weight in EVERY steps; MOST steps leave less than that in any graph.
PRECISION, MOST = 1e-8, 120
#: A host is blocked at this share of the distrust that a seed starts from.
THRESHOLD = 0.1
#: A host is a seed when this share of its pages falls under rules of one kind.
SEED_SHARE = 0.5


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next /, ? or #, lower-cased in A-Z; empty without ://."""
    return _lower(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits; null where none does."""
    chain = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, n: links between different hosts with their number; relative links stay on the host."""
    links = F.explode(F.regexp_extract_all(F.col(html), F.lit(r"""(?i)href\s*=\s*["']?([a-z][a-z0-9+.-]*:)?(//[^"'\s>/?#]+)"""), F.lit(2)))
    found = pages.select(host_of(F.col(url)).alias("src"), links.alias("_to"))
    dst = _lower(F.substring_index(F.substring(F.col("_to"), 3, 1 << 30), "@", -1))
    return found.select("src", dst.alias("dst")).filter("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, precision: float = PRECISION) -> DataFrame:
    """kind, host, score: both walks, in one frame, from seeds (kind, host).

    ``edges`` has kind, src, dst, n.  Every seed restarts with weight 1, so a
    score does not shrink as the web grows.  A step is a join on the source
    and a sum at the target, which is summed up before the shuffle; lineage
    is cut every few steps, and scores that only grow are compared there.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("_out"))
    steps = stash(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("_out")).alias("p")), "links")
    start = seeds.select("kind", "host", F.lit(1.0 - damping).alias("score"))
    if not steps.take(1):
        return start
    rank = before = start
    for i in range(MOST):
        moved = rank.withColumnRenamed("host", "src").join(steps, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.lit(damping) * F.col("score") * F.col("p")).alias("score"))
        rank = moved.unionByName(start).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if i % EVERY == EVERY - 1:
            rank = stash(rank, "rank")
            grown = F.max(F.col("score") - F.coalesce("_was", F.lit(0.0)))
            if (rank.join(before.withColumnRenamed("score", "_was"), ["kind", "host"], "left").agg(grown).first()[0] or 0.0) <= precision:
                break
            before = rank
    return rank


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of ``pages``: key, host, path, rule, verdict, trust, distrust.

    A null url, or one without ://, has an empty host and path; no rule fits
    it, and the empty host is never a seed, so it is allowed.  Trust and distrust
    are shown with six decimals.  A null html has
    no links.  Keys may be null or repeat.  An empty table gives no rows;
    other columns are not looked at.
    """
    rows = pages.select(F.col(key).alias("_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    share = lambda v: F.count_if(F.col("_rule.verdict") == v) / F.count("*")
    hosts = ruled.filter("host != ''").groupBy("host").agg(share("allow").alias("_a"), share("block").alias("_b"))
    kinds = F.explode(F.array(F.when(F.col("_a") > SEED_SHARE, "trust"), F.when(F.col("_b") > SEED_SHARE, "distrust")))
    seeds = stash(hosts.select("host", kinds.alias("kind")).filter("kind is not null"), "seeds")
    edges = stash(host_edges(pages, url, html), "edges")
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    score = propagate(both, seeds).groupBy("host").pivot("kind", ["trust", "distrust"]).agg((F.sum("score") / (1 - DAMPING)))
    scored = ruled.join(score, "host", "left").fillna(0.0, ["trust", "distrust"])
    method = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return scored.select(F.col("_key").alias(key), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", method).alias("verdict"), F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))
