"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct five-word shingles.  The least hash of each
of 128 buckets is kept as a register of its leading-zero count and ten
mantissa bits; bands of registers propose candidates, an estimate of the
Jaccard index that corrects for register collisions drops most of them, and
the rest is confirmed on the full sets.

Documents with equal sets are one node from the start.  In each bucket of a
band all nodes are compared with one leader, the node that shares most buckets
with others; what these links leave apart inside a bucket is then compared
across, so a large group of copies costs one comparison for each member and no
link between two components is lost.

Rows that are exploded are joined by a shuffle: a plan takes them for the size
of the file that they come from, and would send them whole through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import link_components as components
from .scratch import discard, stash
from .text import mix, ngrams, word_hashes

SHINGLE = 5
#: Link at 100 * intersection >= THRESHOLD * union.
THRESHOLD = 85
BUCKET_BITS, MANTISSA = 7, 10
REGISTERS = 1 << BUCKET_BITS
#: Registers in a band of a large set, and bands.
ROWS, BANDS = 5, 25
#: Standard errors that an estimate may lie below the threshold.
ERRORS = 5
#: Nodes of a bucket that are compared in a plain join; larger buckets are compared in blocks of so many nodes.
HOT, BLOCK = 40, 256
#: Nodes of large buckets that are compared in blocks without a look at their rarest shingles.
FEW = 1 << 13


def _levels(threshold: int) -> list[tuple[int, int]]:
    """(largest set, bands) of each level of small sets.

    Two sets of at most n shingles that reach the threshold differ in at most
    d = 2n * (100 - threshold) / (100 + threshold) of them, so one of d + 1
    bands is free of differences.
    """
    out, n = [], 6
    while True:
        bands = int(2 * n * (100 - threshold) / (100 + threshold)) + 1
        if bands >= BANDS - 4:
            return out
        out.append((n, bands))
        n = max(n + 1, n * 5 // 4)


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; all words as one shingle where there are fewer than five."""
    hashes, bounds, _, _ = word_hashes(texts)
    grams = ngrams(hashes, SHINGLE)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            own = np.sort(grams[a : b - SHINGLE + 1])
            yield own[np.append(True, own[1:] != own[:-1])]
        elif b > a:
            yield ngrams(hashes[a:b], b - a)
        else:
            yield hashes[:0]


def registers(least: np.ndarray) -> np.ndarray:
    """Bucket minima (bucket bits shifted out) as leading-zero count and mantissa, from 1 on; 0 stands for an empty bucket."""
    value = least | np.uint64(1)
    zeros = (63 - np.floor(np.log2(value.astype(np.float64)))).astype(np.int64).clip(0, 63 - MANTISSA)
    mantissa = (value << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    return (zeros * (1 << MANTISSA) + mantissa.astype(np.int64) + 1).astype(np.uint16)


def sketch_of(shingles: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set."""
    out = np.zeros((len(shingles), REGISTERS), dtype=np.uint16)
    rows, least = [], []
    for i, own in enumerate(shingles):
        bucket = (own >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(own) else bucket
        rows.append(i * REGISTERS + bucket[first])
        least.append(own[first] << np.uint64(BUCKET_BITS))
    if rows:
        out.reshape(-1)[np.concatenate(rows)] = registers(np.concatenate(least))
    return out


def prefix(own: np.ndarray, threshold: int) -> np.ndarray:
    """The least hashes of a sorted set, as many as it takes for two sets that reach the threshold to share one."""
    return own[: len(own) + -threshold * len(own) // 100 + 1]


def band_keys(shingles: list[np.ndarray], sketch: np.ndarray, threshold: int = THRESHOLD) -> list[np.ndarray]:
    """The band keys of each set, for every level from its own to that of its largest partner.

    The larger set's level has a band without differences for both.  Where
    that band is empty it says nothing about the sets, so its keys are then
    those of the band with each hash of the prefix.
    """
    sizes = np.array([len(x) for x in shingles], dtype=np.int64)
    levels = [*_levels(threshold), (1 << 62, BANDS)]
    tops = np.array([n for n, _ in levels])
    own = np.searchsorted(tops, sizes)
    most = np.searchsorted(tops, sizes * 100 // threshold)
    keys: list[list[np.ndarray]] = [[] for _ in sizes]
    with np.errstate(over="ignore"):
        for k, (_, bands) in enumerate(levels):
            rows = np.flatnonzero((sizes > 0) & (own <= k) & (k <= most))
            if not len(rows):
                continue
            small = k < len(levels) - 1
            edges = np.linspace(0, REGISTERS, bands + 1).astype(int) if small else np.arange(bands + 1) * ROWS
            for b in range(bands):
                part = sketch[rows, edges[b] : edges[b + 1]].astype(np.uint64)
                name = np.uint64((k + 1) * 1000 + b)
                key = np.full(len(rows), name, dtype=np.uint64)
                for j in range(part.shape[1]):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + part[:, j])
                filled = part.any(axis=1)
                for row, value in zip(rows[filled].tolist(), key[filled].view(np.int64), strict=True):
                    keys[row].append(value)
                for row in rows[~filled].tolist() if small else ():
                    keys[row].extend(mix(prefix(shingles[row], threshold) * np.uint64(0x9E3779B97F4A7C15) + name).view(np.int64))
    return [np.array(k, dtype=np.int64) for k in keys]


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers, less the share that agrees by chance, and the registers they rest on."""
    filled = ((a > 0) | (b > 0)).sum(axis=-1)
    same = ((a == b) & (a > 0)).sum(axis=-1)
    chance = 2.0**-MANTISSA / 3
    return (same / np.maximum(filled, 1) - chance) / (1 - chance), filled


def likely(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Whether the estimates are within ERRORS standard errors of the threshold, or above."""
    t = threshold / 100
    j, filled = estimate(a, b)
    return j >= t - ERRORS * np.sqrt(t * (1 - t) / np.maximum(filled, 1))


def linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= threshold * (len(x) + len(y) - common)


def sketches(docs: DataFrame, key: str, text: str, threshold: int = THRESHOLD) -> DataFrame:
    """_key, _hash (of the text), n, digest (of the set), registers, keys of each row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                own = list(sets_of(batch.column("_text")))
                sizes = np.array([len(x) for x in own], dtype=np.int64)
                sketch = sketch_of(own)
                keys = band_keys(own, sketch, threshold)
                cols = [batch.column("_key"), batch.column("_hash"), pa.array(sizes), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in own], pa.binary())]
                cols += [pa.array([r.tobytes() for r in sketch], pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["_key", "_hash", "n", "digest", "registers", "keys"])

    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_key {kind}, _hash long, n long, digest binary, registers binary, keys array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """digest, shingles of the nodes whose first row (_key, _hash) ``wanted`` lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                own = list(sets_of(whole.slice(lo, 1024).column("_text")))
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], ["digest", "shingles"])

    rows = docs.select(F.col(key).alias("_k"), F.xxhash64(text).alias("_h"), F.col(text).alias("_text"))
    # what is wanted grows with the documents, so that the join is a shuffle at every size
    chosen = rows.join(wanted.hint("merge"), F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_h") == F.col("_hash")), "left_semi").select("_text")
    return chosen.mapInArrow(run, "digest binary, shingles binary").dropDuplicates(["digest"])


def _close(a: Column, b: Column, threshold: int) -> Column:
    return 100 * F.least(a, b) >= threshold * F.greatest(a, b)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, threshold: int) -> DataFrame:
    """The pairs (a, b) of digests that are linked."""

    @F.arrow_udf("boolean")
    def near_enough(a: pa.Array, b: pa.Array) -> pa.Array:
        both = [np.frombuffer(b"".join(x.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for x in (a, b)]
        return pa.array(likely(*both, threshold))

    @F.arrow_udf("boolean")
    def confirmed(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([linked(np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64), threshold) for x, y in zip(a, b, strict=True)], pa.bool_())

    slim = nodes.select("digest", "registers")
    near = pairs.join(slim.toDF("a", "_ra"), "a").join(slim.toDF("b", "_rb"), "b").filter(near_enough("_ra", "_rb")).select("a", "b")
    near = stash(near, "candidates")
    sets = stash(full_sets(docs, near.select(F.explode(F.array("a", "b")).alias("digest")).distinct().join(nodes, "digest").select("_key", "_hash"), key, text), "sets")
    tested = near.join(sets.toDF("b", "_sb"), "b").join(sets.toDF("a", "_sa"), "a").filter(confirmed("_sa", "_sb"))
    links = stash(tested.select("a", "b"), "links")
    discard(near, sets)
    return links


def rarest(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """digest, key, n: of each set of ``members``, those of its rarest shingles that another one has too, and its size.

    As many are looked at as it takes for two sets that reach the threshold to
    share one, whatever the order, as long as it is the same for both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                batch = whole.slice(lo, 64)
                own = [np.frombuffer(x, dtype=np.int64) for x in batch.column("shingles").to_pylist()]
                sizes = np.array([len(x) for x in own], dtype=np.int64)
                rows = np.repeat(np.arange(len(own)), sizes)
                yield pa.RecordBatch.from_arrays([batch.column("digest").take(pa.array(rows)), pa.array(np.concatenate(own)), pa.array(sizes[rows])], ["digest", "key", "n"])

    each = stash(sets.join(members.select("digest").distinct().hint("merge"), "digest", "left_semi").mapInArrow(run, "digest binary, key long, n long"), "shingles")
    counted = each.join(each.groupBy("key").agg(F.count("*").alias("_f")).hint("merge"), "key")
    ranked = counted.withColumn("_r", F.row_number().over(Window.partitionBy("digest").orderBy("_f", "key")))
    out = stash(ranked.filter((F.col("_r") <= F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1) & (F.col("_f") > 1)).select("digest", "key", "n"), "rarest")
    discard(each)
    return out


def compared_in_blocks(members: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, threshold: int) -> DataFrame:
    """The links (a, b) that join different labels within the clusters of ``members`` (cluster, digest, label).

    A cluster's nodes are dealt to blocks of about BLOCK by hash; each pair of
    blocks is one group, which reads two blocks and returns at most a link
    for each node that it connects.
    """
    counted = members.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    dealt = members.join(counted, "cluster").withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select("cluster", "digest", "label", "_own", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))
    sets = stash(full_sets(docs, members.select("digest").distinct().join(nodes, "digest").select("_key", "_hash"), key, text), "sets")
    full = sets.join(nodes.select("digest", "registers"), "digest")

    def compare(table: pa.Table) -> pa.Table:
        names, labels, own = (table.column(c).to_pylist() for c in ("digest", "label", "_own"))
        found: list[tuple[bytes, bytes]] = []
        if len(set(labels)) > 1:
            sketch = np.frombuffer(b"".join(table.column("registers").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
            shingles = [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]
            sizes, side = np.array([len(x) for x in shingles]), np.array(own)
            parent = {x: x for x in labels}

            def top(x: bytes) -> bytes:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            single = len(set(own)) == 1
            alone = table.column("i")[0].as_py() == table.column("j")[0].as_py()
            for r in range(len(names)) if alone or not single else ():
                s = np.arange(r + 1, len(names))
                s = s[(100 * np.minimum(sizes[s], sizes[r]) >= threshold * np.maximum(sizes[s], sizes[r])) & (alone | (side[s] != side[r]))]
                for q in s[likely(sketch[s], sketch[r], threshold)].tolist() if len(s) else ():
                    a, b = top(labels[r]), top(labels[q])
                    if a != b and linked(shingles[r], shingles[q], threshold):
                        parent[a] = b
                        found.append((min(names[r], names[q]), max(names[r], names[q])))
        return pa.table({"a": pa.array([f[0] for f in found], pa.binary()), "b": pa.array([f[1] for f in found], pa.binary())})

    # a row for each member and block, which no plan foresees
    links = stash(pairs.join(full.hint("merge"), "digest").groupBy("cluster", "i", "j").applyInArrow(compare, "a binary, b binary"), "links")
    discard(sets)
    return links


def compared_in_clusters(hot: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, threshold: int) -> DataFrame:
    """The links (a, b) that join different labels among the nodes of ``hot`` (key, digest, label): buckets that share nodes are compared as one."""
    heads = hot.groupBy("key").agg(F.min("digest").alias("b"))
    clusters = components(hot.join(heads, "key").select(F.col("digest").alias("a"), "b"))
    members = hot.select("digest", F.col("label").alias("_own")).distinct().join(clusters, F.col("digest") == F.col("node"))
    members = stash(members.select(F.col("label").alias("cluster"), "digest", F.col("_own").alias("label")), "members")
    links = compared_in_blocks(members, nodes, docs, key, text, threshold)
    discard(members)
    return links


def compared_by_rarest(hot: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, threshold: int) -> DataFrame:
    """The links (a, b) that join different labels among the nodes of ``hot`` (key, digest, label).

    Nodes of a large bucket mostly share text that is common and nothing else.
    Linked ones also share one of their rarest shingles, and few have that; those
    of what is still a large bucket are compared in blocks.
    """
    own = stash(hot.select("digest", "label").distinct(), "members")
    sets = stash(full_sets(docs, own.join(nodes.hint("merge"), "digest").select("_key", "_hash"), key, text), "sets")
    keyed = rarest(own, sets, threshold)
    named = keyed.join(own.hint("merge"), "digest")
    mixed = named.groupBy("key").agg(F.count("*").alias("size"), (F.min("label") != F.max("label")).alias("mixed")).filter("mixed").drop("mixed")
    rare = stash(named.join(mixed.hint("merge"), "key"), "buckets")
    few = rare.filter(F.col("size") <= HOT)
    across = few.join(few.select("key", F.col("digest").alias("_d"), F.col("n").alias("_n"), F.col("label").alias("_l")).hint("merge"), "key")
    across = across.filter((F.col("digest") < F.col("_d")) & (F.col("label") != F.col("_l")) & _close(F.col("n"), F.col("_n"), threshold))
    pairs = stash(across.select(F.col("digest").alias("a"), F.col("_d").alias("b")).distinct(), "pairs")
    links = verified(pairs, nodes, docs, key, text, threshold)
    many = stash(rare.filter(F.col("size") > HOT).select("key", "digest", "label"), "hot")
    if many.take(1):
        links = links.unionByName(compared_in_clusters(many, nodes, docs, key, text, threshold))
    discard(own, sets, keyed, rare, pairs, many)
    return links


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """A row for each row of ``docs``: key, _hash (of the text), n_shingles, component_id, kept.

    component_id is the least key of all rows that links reach, a null key
    counting as larger than any other; kept says that the row has it.  Rows
    with a null or empty text, or with white space alone, have no shingles
    and are linked with nothing.  Rows with equal keys are judged each by its
    own text.  An empty table gives no rows; other columns are not looked at.
    """
    rows = stash(sketches(docs, key, text, threshold), "sketches")
    first = F.min(F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("_key"), F.col("_hash").alias("_hash")))
    grouped = rows.filter("n > 0").groupBy("digest").agg(first.alias("f"), F.first("n").alias("n"), F.first("registers").alias("registers"), F.first("keys").alias("keys"))
    nodes = stash(grouped.select("digest", "n", "f._key", "f._hash", "registers", "keys"), "nodes")
    keyed = nodes.select("digest", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = stash(keyed.join(shared.hint("merge"), "key"), "buckets")
    fame = buckets.groupBy("digest").agg(F.sum("size").alias("fame"))
    leader = buckets.join(fame, "digest").groupBy("key").agg(F.max(F.struct("fame", "digest", "n")).alias("l")).select("key", F.col("l.digest").alias("_lead"), F.col("l.n").alias("_n"))
    stars = buckets.join(leader, "key").filter(F.col("digest") != F.col("_lead")).filter(_close(F.col("n"), F.col("_n"), threshold))
    stars = stash(stars.select(F.least("digest", "_lead").alias("a"), F.greatest("digest", "_lead").alias("b")).distinct(), "pairs")
    links = verified(stars, nodes, docs, key, text, threshold)
    found = first_found = stash(components(links), "components")

    marked = buckets.join(found, F.col("digest") == F.col("node"), "left").select("key", "digest", "n", "size", F.coalesce("label", "digest").alias("label"))
    parts = marked.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("parts"), F.max(F.struct("c", "label")).alias("most"))
    mixed = marked.join(parts.filter("parts > 1").select("key", F.col("most.label").alias("_most")), "key")
    minor = mixed.filter("label != _most").select("key", F.col("digest").alias("_d"), F.col("n").alias("_n"), F.col("label").alias("_l"))
    across = minor.join(mixed.filter(F.col("size") <= HOT), "key").filter((F.col("label") != F.col("_l")) & _close(F.col("n"), F.col("_n"), threshold))
    rest = across.select(F.least("digest", "_d").alias("a"), F.greatest("digest", "_d").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = verified(stash(rest, "pairs"), nodes, docs, key, text, threshold)
    hot = stash(mixed.filter(F.col("size") > HOT).select("key", "digest", "label"), "hot")
    if hot.take(1):
        # up to FEW nodes all pairs are soon compared; beyond, they would grow with the square of the documents
        compare = compared_by_rarest if hot.select("digest").distinct().count() > FEW else compared_in_clusters
        more = more.unionByName(compare(hot, nodes, docs, key, text, threshold))
    if more.take(1):
        found = stash(components(links.unionByName(more)), "components")

    label = F.coalesce("label", "digest")
    named = nodes.join(found, F.col("digest") == F.col("node"), "left").select("digest", "_key", label.alias("label"))
    least = named.groupBy("label").agg(F.min("_key").alias("component_id"))
    by = named.join(least, "label").select("digest", "component_id")
    linked = rows.join(by.withColumnRenamed("digest", "_node"), (F.col("digest") == F.col("_node")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_key"))
    told = stash(linked.select(F.col("_key").alias(key), "_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_key").eqNullSafe(component).alias("kept")), "classes")
    # a few bytes a row stand for sketches and sets from here on
    discard(rows, nodes, buckets, stars, links, more, found, hot, first_found)
    return told
