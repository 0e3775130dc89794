"""Removal of repeated lines and of repeated passages within lines.

Texts are cut into units: lines, and within them sentences and what a
capitalised word begins.  Whole lines, and the shortest stretches of
consecutive units that reach a number of words, are normalised and hashed to
128 bits.  Digests are grouped over all documents, the earliest ranked
occurrence of each stays and the others are removed; what is removed keeps its
offsets in the original text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stash, unused
from .text import buffer_of, mix, word_hashes

#: A line of fewer words stays by itself: headings, menu entries and licence lines repeat for good reasons.
MIN_WORDS = 16
#: Words of the stretches of units that are compared, whatever lines they stand in.
RUN_WORDS = 40
#: A digest with more than the HOT-th part of all repeats is joined by broadcast.
HOT = 1000
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[ord(c) for c in ".!?"]] = True
_ROWS = 256


@lru_cache(maxsize=1)
def _capitals() -> np.ndarray:
    table = np.array([unicodedata.category(chr(c)) == "Lu" for c in range(0x20000)])
    return table


def capitalised(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a capital letter begins at each byte place."""
    table = _capitals()
    out = table[raw[at]]
    wide = np.flatnonzero(raw[at] >= 0x80)
    # a character ends within the text, so what is read behind it is of no account
    a, b, c, d = (raw[np.minimum(at[wide] + i, len(raw) - 1)].astype(np.int64) for i in range(4))
    point = np.where(a < 0xE0, (a & 31) << 6 | b & 63, np.where(a < 0xF0, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63))
    out[wide] = table[np.minimum(point, len(table) - 1)]
    return out


def _prefix_sums(values: np.ndarray, multiplier: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of value * multiplier^place before each place, and the inverse powers."""
    with np.errstate(over="ignore"):
        up, down = np.full(len(values) + 1, multiplier, np.uint64), np.full(len(values) + 1, pow(multiplier, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return np.append(np.uint64(0), np.cumsum(values * up[:-1], dtype=np.uint64)), down


def stretches(texts: pa.Array, min_words: int, run_words: int | None) -> tuple[np.ndarray, ...]:
    """Row, start and end in characters, and both halves of the digest of all stretches of a batch."""
    raw, at = buffer_of(texts)
    hashes, bounds, begin, stop = word_hashes(texts)
    if not len(hashes):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    doc = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
    begin, stop = begin + at[doc], stop + at[doc]
    line = np.searchsorted(np.flatnonzero(raw == 10), begin)
    opens = np.ones(len(hashes), dtype=bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
    inner = opens.copy()
    inner[1:] |= _STOPS[raw[stop[:-1] - 1]]
    inner |= capitalised(raw, begin)
    first = np.flatnonzero(inner)
    home, upto = doc[first], np.append(first[1:], len(hashes))
    heads = np.flatnonzero(opens[first])
    tails = np.append(heads[1:], len(first))
    long = upto[tails - 1] - first[heads] >= min_words
    spans = [np.stack([heads[long], tails[long]])]
    if run_words is not None:
        unit = np.arange(len(first))
        ahead = np.searchsorted(upto, first + run_words)
        fits = (ahead < len(first)) & (home[np.minimum(ahead, len(first) - 1)] == home)
        spans.append(np.stack([unit[fits], ahead[fits] + 1]))
        behind = np.searchsorted(first, upto - run_words, side="right") - 1
        fits = (behind >= 0) & (home[np.maximum(behind, 0)] == home)
        spans.append(np.stack([behind[fits], unit[fits] + 1]))
    both = np.concatenate(spans, axis=1)
    low, high = np.divmod(np.unique(both[0] * (len(first) + 1) + both[1]), len(first) + 1)
    a, b = first[low], upto[high - 1]
    digest = []
    with np.errstate(over="ignore"):
        for values, multiplier in ((hashes, 0x9E3779B97F4A7C15), (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), 0xD6E8FEB86659FD93)):
            total, down = _prefix_sums(values, multiplier)
            digest.append(mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)))
    # characters up to an edge: bytes less those that continue a character
    edges, where = np.unique(np.concatenate([at, begin[a], stop[b - 1]]), return_inverse=True)
    tail = (raw[edges[0] : edges[-1]] & 0xC0) == 0x80
    more = np.add.reduceat(tail, edges[:-1] - edges[0], dtype=np.int64) if len(edges) > 1 else np.zeros(0, np.int64)
    chars = (edges - np.append(0, np.cumsum(more)))[where]
    origin, start, end = chars[: len(at)], chars[len(at) : len(at) + len(a)], chars[len(at) + len(a) :]
    row = doc[a]
    return row, start - origin[row], end - origin[row], digest[0], digest[1]


def units(docs: DataFrame, key: str, text: str, min_words: int = MIN_WORDS, run_words: int | None = RUN_WORDS) -> DataFrame:
    """_key, _hash (of the text), start, end, d1, d2 (the digest) of every line and stretch; offsets are in characters."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(lo, _ROWS)
                row, start, end, d1, d2 = stretches(batch.column("_text"), min_words, run_words)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("_key").take(take), batch.column("_hash").take(take), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))], ["_key", "_hash", "start", "end", "d1", "d2"])

    return docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, _hash long, start int, end int, d1 long, d2 long")


def later(docs: DataFrame, key: str, text: str, min_words: int, run_words: int | None) -> DataFrame:
    """_key, _hash, start, end of all stretches that stood before, less those that overlap their first occurrence."""
    found = stash(units(docs, key, text, min_words, run_words), "units")
    counts = stash(found.groupBy("d1", "d2").agg(F.count("*").alias("_n")).filter("_n > 1"), "counts")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    # less than HOT digests can have more than their share; these rows are not shuffled
    hot = F.broadcast(counts.filter(F.col("_n") * HOT > total).select("d1", "d2"))
    # both sides of the other joins grow with the input, so that they are shuffles at every size
    cold = found.join(hot, ["d1", "d2"], "left_anti").join(counts.select("d1", "d2").hint("merge"), ["d1", "d2"], "left_semi")
    again = stash(cold.unionByName(found.join(hot, ["d1", "d2"], "left_semi")), "repeats")
    rank = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_hash").alias("hash"), F.col("start").alias("start"), F.col("end").alias("end"))
    firsts = again.groupBy("d1", "d2").agg(F.min(rank).alias("f")).select("d1", "d2", F.col("f.key").alias("_k"), F.col("f.hash").alias("_h"), F.col("f.end").alias("_e"))
    own = [again["d1"] == firsts["d1"], again["d2"] == firsts["d2"], again["_hash"] == F.col("_h"), again["_key"].eqNullSafe(F.col("_k")), again["start"] < F.col("_e")]
    return again.join(firsts.hint("merge"), own, "left_anti").select("_key", "_hash", "start", "end")


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, run_words: int | None = RUN_WORDS) -> DataFrame:
    """Passages to remove: key, _hash (of the text), start, end.

    A line of ``min_words`` words and more, and a stretch of consecutive units
    that has ``run_words`` words, is repeated where its words, in lower case,
    stood before; stretches that overlap are one passage.  A stretch does not
    repeat one that it overlaps.  None for ``run_words`` leaves all but whole
    lines.

    Ranked by key, then text hash, then place; a null key ranks last.  Rows
    with equal key and text are one document, treated alike; rows with the
    same key, or none, and other texts are documents each.  Null and empty
    texts have no units.  An empty table gives no rows; other columns are not
    looked at.  A script without spaces has one word a line, so that only
    ``min_words`` of 1 would compare its lines.

    A digest that is very frequent is summed up before the shuffle, and its
    rows are joined where they are: of such digests there are less than HOT.
    """
    found = later(docs, key, text, min_words, run_words)
    own = Window.partitionBy("_key", "_hash").orderBy("start", "end")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    parted = found.withColumn("_new", F.when(F.col("start") < reach, 0).otherwise(1))
    parted = parted.withColumn("_part", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = parted.groupBy("_key", "_hash", "_part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.select(F.col("_key").alias(key), "_hash", F.col("start").cast("long"), F.col("end").cast("long"))


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans; spaces behind a span go with it, and so does a line of which nothing is left."""
    out, at, spans = [], 0, sorted(spans)
    edge = 0
    for whole in text.split("\n"):
        end = at + len(whole)
        while edge < len(spans) and spans[edge][1] <= at:
            edge += 1
        kept, place, k = [], at, edge
        while k < len(spans) and spans[k][0] < end:
            kept.append(text[place : max(place, spans[k][0])])
            place = max(place, min(end, spans[k][1]))
            place += len(text[place:end]) - len(text[place:end].lstrip())
            k += 1
        if k == edge:
            out.append(whole)
        elif left := ("".join(kept) + text[place:end]).rstrip():
            out.append(left)
        at = end + 1
    return "\n".join(out)


def without(text: Column, gone: Column) -> Column:
    """``text`` without the spans (start, end) that ``gone`` lists."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, places: pa.Array) -> pa.Array:
        return pa.array([t.as_py() if not drop.as_py() else cut_out(t.as_py(), [(s["start"], s["end"]) for s in drop.as_py()]) for t, drop in zip(texts, places, strict=True)], pa.string())

    return cut(text, gone)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, run_words: int | None = RUN_WORDS) -> DataFrame:
    """``docs`` with the passages of ``repeated`` taken out of ``text``; other columns and all rows stay.

    A document that loses every unit keeps an empty text.  Null texts stay
    null; of rows with one key, only those with the repeating text are cut.
    Ties, repeated rows and empty tables are as for ``repeated``.
    """
    own, mark, places = unused(docs, "_key"), unused(docs, "_hash"), unused(docs, "_gone")
    found = repeated(docs, key, text, min_words, run_words)
    gone = found.groupBy(F.col(key).alias(own), F.col("_hash").alias(mark)).agg(F.collect_list(F.struct("start", "end")).alias(places))
    # as many rows as there are repeats, so that the join is a shuffle at every size
    joined = docs.join(gone.hint("merge"), F.col(key).eqNullSafe(F.col(own)) & (F.xxhash64(text) == F.col(mark)), "left")
    kept = F.when(F.col(places).isNull(), F.col(text)).otherwise(without(F.when(F.col(places).isNotNull(), F.col(text)), F.col(places)))
    return joined.select(*[kept.alias(c) if c == text else F.col(c) for c in docs.columns])
