"""Benchmark decontamination under edit distance.

A random walk (CGK) embeds a string so that edit distance becomes Hamming
distance; sampled positions of several embeddings are the keys of a
locality-sensitive hash of all benchmark items.  Windows of an item's size are
read at the places of a document that the edit limit leaves possible, embedded
and looked up among all items; a match is verified by its exact edit distance.

An item is cut into pieces of PIECE characters.  Each edit spoils one piece at
most, so as many pieces as there are more than edits stand in any match, each
within the edits of its place: windows begin only where so many pieces agree,
which loses none.  Of such places those are taken that most pieces name, and the
one that the item's first standing piece names, which is the match's beginning.

Behind an edit two walks go apart for some steps, and many deletions can keep
them apart for good.  Positions are therefore sampled at several scales: from
the whole walk, its first half, quarter and eighth.  The number of embeddings is
chosen so that each kind of edit, strewn evenly or at random at the limit,
reaches the target recall through the same proposals.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import unused

#: Edits allowed, as a share of the item's characters, and the recall aimed at.
EDITS, RECALL = 0.1, 0.99
#: Characters of a piece; an item of fewer than two pieces' length is cut into two.
PIECE = 8
#: Positions in a key, keys of an embedding, embeddings at most, keys that a match shares.
SAMPLED, TABLES, MOST, AGREE = 4, 24, 24, 2
#: Tables sample the whole walk, its first half, quarter and so on, by turns.
SCALES = 4
#: Places of an item, among those no further apart than its edits, at which windows are embedded: where most pieces agree; one more is where the first piece says.
PLACES = 2
#: Simulated edits of each kind at the least, and at the most.
TRIALS, MOST_TRIALS = 200, 1000
#: Characters of the grams that a match must share.
GRAM = 3
#: Characters of a document that are read at once, and windows that are embedded at once.
STEP, WINDOWS = 1 << 20, 4096
#: Characters of benchmark items that are searched for in one pass over the documents.
AT_ONCE = 4_000_000


def normalise(text: str) -> str:
    """Lower case, with one space for each run of white space."""
    return " ".join(text.lower().split())


def size_class(n: int) -> int:
    """The largest of 16, 20, 25, 31, ... that is at most n; shorter strings are their own class."""
    size = 16
    if n < size:
        return n
    while size * 5 // 4 <= n:
        size = size * 5 // 4
    return size


def embed(rows: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK: each row (code points, 0 behind the end) is copied out step by step, its pointer moving on where a random function of step and symbol says so."""
    n, width = rows.shape
    padded = np.hstack([rows, np.zeros((n, 1), rows.dtype)])
    at, out, every = np.zeros(n, dtype=np.int64), np.zeros((n, steps), dtype=np.uint32), np.arange(n)
    draws = np.random.default_rng(seed).integers(0, 1 << 32, size=(steps, 2), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    for j in range(steps):
        symbol = padded[every, at]
        out[:, j] = symbol
        at = np.minimum(at + (((symbol * draws[j, 0] + draws[j, 1]) * np.uint32(2654435761)) >> np.uint32(31)), width)
    return out


def matrix(strings: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(strings), width), dtype=np.uint32)
    for i, s in enumerate(strings):
        codes = np.frombuffer(s[:width].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        out[i, : len(codes)] = codes
    return out


def keys(strings: list[str], size: int, seed: int) -> np.ndarray:
    """The hash keys of each string in each table of one embedding; positions are drawn where a string of ``size`` has not ended yet."""
    steps = max(1, int(1.6 * size))
    walked = embed(matrix(strings, size), steps, seed)
    reach = np.maximum(1, steps >> (np.arange(TABLES) % SCALES))
    places = (np.random.default_rng(seed + 7919).random((TABLES, SAMPLED)) * reach[:, None]).astype(np.int64)
    with np.errstate(over="ignore"):
        out = np.full((len(strings), TABLES), seed * 0x9E37 + size, dtype=np.uint64) + np.arange(TABLES, dtype=np.uint64)
        for j in range(SAMPLED):
            out = (out ^ walked[:, places[:, j]]) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(29)
    return out


def best_end(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of pattern to any substring of text, and the first end at which it is reached (bit-parallel)."""
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    up, down, score = full, 0, len(pattern)
    best, end = score, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        d0 = ((((x & up) + up) & full) ^ up) | x
        hp, hn = down | (full & ~(d0 | up)), up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp <<= 1
        up = ((hn << 1) | (full & ~(d0 | hp))) & full
        down = hp & d0 & full
        if score < best:
            best, end = score, j + 1
    return best, end


def align(pattern: str, text: str) -> tuple[int, int, int]:
    """Distance, start and end of the substring of text that is nearest to pattern."""
    distance, end = best_end(pattern, text)
    _, back = best_end(pattern[::-1], text[:end][::-1])
    return distance, end - back, end


def window(text: str, begin: int, size: int) -> str:
    """``size`` characters from ``begin`` on; what lies before the text is filled."""
    return "\x01" * min(size, max(0, -begin)) + text[max(0, begin) : max(0, begin + size)]


def changed(text: str, kind: str, evenly: bool, edits: int, rng: np.random.Generator) -> str:
    """So many substitutions, insertions or deletions, at even distances or at random."""
    at = (np.arange(edits) + 0.5) * len(text) / edits if evenly else np.sort(rng.choice(len(text), edits, replace=False))
    parts, last = [], 0
    for k in at.astype(np.int64).tolist():
        parts += [text[last:k], "" if kind == "deletion" else "x"]
        last = k + (kind != "insertion")
    return "".join(parts) + text[last:]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def grams(points: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive characters, whose upper bits are well mixed; put together from halves that overlap."""
    many = len(points) - n + 1
    if many < 1:
        return np.zeros(0, np.uint64)
    out, size = points.astype(np.uint64) + np.uint64(1), 1
    with np.errstate(over="ignore"):
        while size < n:
            step = min(size, n - size)
            left = out[:-step] * np.uint64(0x9E3779B97F4A7C15)
            out = (left ^ (left >> np.uint64(31))) + out[step:]
            size += step
        return out * np.uint64(0xD6E8FEB86659FD93)


class Index:
    """Benchmark items by piece and by LSH key."""

    def __init__(self, items: list[tuple[object, str]], edits: float = EDITS, recall: float = RECALL):
        self.edits = edits
        self.grams: dict[int, np.ndarray] = {}
        self.items = [(k, normalise(t or "")) for k, t in items]
        self.sizes = np.array([size_class(len(t)) for _, t in self.items], dtype=np.int64)
        self.slack = np.array([int(len(t) * edits) for _, t in self.items], dtype=np.int64)
        usable = [any(c.isalnum() for c in t) for _, t in self.items]
        pieces = []
        self.need = np.zeros(len(self.items), dtype=np.int64)
        for n, (_, t) in enumerate(self.items):
            if usable[n]:
                # more pieces than edits, of PIECE characters where that leaves some
                many = max(int(self.slack[n]) + 1, len(t) // PIECE, min(2, len(t)))
                self.need[n] = many - int(self.slack[n])
                size = len(t) // many
                found = grams(codes(t), size)
                pieces += [(size, int(found[i * size]), n, i * size) for i in range(many)]
        self.by_size = {}
        for size in sorted({p[0] for p in pieces}):
            own = sorted(p[1:] for p in pieces if p[0] == size)
            hashes = np.array([p[0] for p in own], dtype=np.uint64)
            quick = np.zeros(1 << 20, dtype=bool)
            quick[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.by_size[size] = (quick, hashes, np.array([p[1] for p in own]), np.array([p[2] for p in own]))
        self.seeds = list(range(self.calibrate(recall)))
        by = defaultdict(list)
        for n, size in enumerate(self.sizes.tolist()):
            if usable[n]:
                by[size].append(n)
        found, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for size, members in by.items():
            for seed in self.seeds:
                found.append(keys([self.items[n][1] for n in members], size, seed).reshape(-1))
                owner.append(np.repeat(members, TABLES))
        self.keys, self.owner = np.concatenate(found), np.concatenate(owner)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.owner = self.keys[order], self.owner[order]

    def calibrate(self, recall: float) -> int:
        """Embeddings needed for the recall at the limit of edits, with windows where ``proposals`` has them: of each kind of edits, strewn evenly and at random, as many as the worst needs.

        Items are tried from the shortest to the longest, MOST_TRIALS of them at most.
        """
        rng = np.random.default_rng(11)
        usable = sorted((n for n, need in enumerate(self.need.tolist()) if need and self.slack[n]), key=lambda n: len(self.items[n][1]))
        if not usable:
            return 1
        tried = [usable[int(i)] for i in np.linspace(0, len(usable) - 1, min(len(usable), MOST_TRIALS))] * -(-TRIALS // len(usable))
        by, kinds = defaultdict(list), []
        for kind in ("substitution", "insertion", "deletion"):
            for evenly in (True, False):
                for n in tried:
                    pad = "." * int(self.slack[n] + 1)
                    shown = pad + changed(self.items[n][1], kind, evenly, int(self.slack[n]), rng) + pad
                    items, starts = self.proposals(codes(shown))
                    size = int(self.sizes[n])
                    by[size] += [(len(kinds), self.items[n][1], window(shown, b, size)) for b in starts[items == n].tolist()]
                    kinds.append((kind, evenly))
        found = np.zeros((len(kinds), MOST), dtype=bool)
        for size, trials in by.items():
            same = [(keys([t[1] for t in trials], size, e) == keys([t[2] for t in trials], size, e)).sum(axis=1) for e in range(MOST)]
            for (trial, _, _), hit in zip(trials, np.cumsum(np.stack(same, axis=1), axis=1) >= AGREE, strict=True):
                found[trial] |= hit
        share = found.reshape(6, len(tried), MOST).mean(axis=1).min(axis=0)
        enough = np.flatnonzero(share >= recall)
        if not len(enough):
            raise ValueError(f"{MOST} embeddings reach a recall of {share[-1]:.3f}, below {recall}")
        return int(enough[0]) + 1

    def proposals(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and places in ``points`` at which enough of an item's pieces let it begin."""
        item, start, piece = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, (quick, hashes, owner, offset) in self.by_size.items():
            found = grams(points, size)
            at = np.flatnonzero(quick[(found >> np.uint64(44)).astype(np.int64)])
            low, high = np.searchsorted(hashes, found[at]), np.searchsorted(hashes, found[at], side="right")
            many = high - low
            which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            item.append(owner[which])
            start.append(np.repeat(at, many) - offset[which])
            piece.append(offset[which])
        item, start, piece = np.concatenate(item), np.concatenate(start), np.concatenate(piece)
        order = np.lexsort((start, item))
        item, start, piece = item[order], start[order], piece[order]
        # in a match, places differ by twice the edits at most
        ahead = self.need[item] - 1
        last = np.minimum(np.arange(len(item)) + ahead, max(0, len(item) - 1))
        whole = (item[last] == item) & (start[last] - start <= 2 * self.slack[item]) & (np.arange(len(item)) + ahead < len(item))
        marks = np.zeros(len(item) + 1, dtype=np.int64)
        np.add.at(marks, np.flatnonzero(whole), 1)
        np.add.at(marks, last[whole] + 1, -1)
        keep = np.cumsum(marks[:-1]) > 0
        item, start, piece = item[keep], start[keep], piece[keep]
        if not len(item):
            return item, start
        first = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (start[1:] != start[:-1])))
        votes = np.diff(np.append(first, len(item)))
        item, start, piece = item[first], start[first], np.minimum.reduceat(piece, first)
        cell = start // (self.slack[item] + 1)
        head = np.append(True, (item[1:] != item[:-1]) | (cell[1:] != cell[:-1]))
        place = np.arange(len(item)) - np.maximum.accumulate(np.where(head, np.arange(len(item)), 0))
        chosen = np.zeros(len(item), dtype=bool)
        for rank, many in ((-votes, PLACES), (piece, 1)):
            chosen[np.lexsort((start, rank, cell, item))[place < many]] = True
        return item[chosen], start[chosen]

    def possible(self, n: int, text: str) -> bool:
        """Whether ``text`` has as many of an item's grams as a match leaves: an edit spoils GRAM of them at most."""
        own = self.grams.get(n)
        if own is None:
            own = self.grams[n] = grams(codes(self.items[n][1]), GRAM)
        return np.isin(own, grams(codes(text), GRAM)).sum() >= len(own) - GRAM * self.slack[n]

    def match(self, strings: list[str], sizes: list[int]) -> Iterator[tuple[int, int]]:
        """(string, item) for each pair that shares AGREE keys."""
        by = defaultdict(list)
        for i, size in enumerate(sizes):
            by[size].append(i)
        for size, members in by.items():
            shared: Counter = Counter()
            for seed in self.seeds:
                found = keys([strings[i] for i in members], size, seed)
                low, high = np.searchsorted(self.keys, found), np.searchsorted(self.keys, found, side="right")
                for r, c in zip(*np.nonzero(low < high), strict=True):
                    for n in self.owner[low[r, c] : high[r, c]].tolist():
                        if self.sizes[n] == size:
                            shared[int(r), n] += 1
            for (r, n), many in shared.items():
                if many >= AGREE:
                    yield members[r], n


def places(text: str) -> Sequence[int]:
    """Where in ``text`` each character of its normalised form comes from."""
    if len(normalise(text)) == len(text.lower()) == len(text):
        return range(len(text))
    out: list[int] = []
    open_gap = -1
    for k, c in enumerate(text):
        if c.isspace():
            open_gap = k if out and open_gap < 0 else open_gap
            continue
        if open_gap >= 0:
            out.append(open_gap)
            open_gap = -1
        out += [k] * len(c.lower())
    return out


def _search(index: Index, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, start, end, distance) in characters of each row's text."""
    reach = max((len(t) for _, t in index.items), default=0)
    low: dict[int, str] = {}
    offered: set[tuple[int, int, int]] = set()
    best: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
    held = 0

    def flush() -> None:
        chosen = sorted({(row, b, int(index.sizes[n])) for row, b, n in offered})
        matched = sorted({(*chosen[i][:2], n) for i, n in index.match([window(low[row], b, size) for row, b, size in chosen], [size for _, _, size in chosen])})
        for row, b, n in matched:
            item, slack, old = index.items[n][1], int(index.slack[n]), best[row, n]
            # what no count of pieces lets begin here is beyond the edit limit; what begins near a match is that match
            if (row, b, n) not in offered or any(abs(f[1] - b) <= slack for f in old):
                continue
            first = max(0, b - 2 * slack - 1)
            area = low[row][first : max(0, b) + len(item) + 3 * slack + 1]
            if not index.possible(n, area):
                continue
            distance, x, y = align(item, area)
            if distance <= len(item) * index.edits and y > x:
                found = (distance, first + x, first + y)
                if not any(f[1] < found[2] and found[1] < f[2] and f[0] <= distance for f in old):
                    best[row, n] = [f for f in old if not (f[1] < found[2] and found[1] < f[2])] + [found]
        low.clear(), offered.clear()

    for row, text in enumerate(texts):
        whole = normalise(text.as_py() or "")
        points = codes(whole)
        for lo in range(0, len(points), STEP):
            items, starts = index.proposals(points[lo : lo + STEP + 2 * reach])
            for a in range(0, len(items), WINDOWS):
                low[row] = whole
                begin = (starts[a : a + WINDOWS] + lo).tolist()
                offered.update((row, b, n) for b, n in zip(begin, items[a : a + WINDOWS].tolist(), strict=True))
                held += len(whole)
                if len(offered) >= WINDOWS or held >= 8 * STEP:
                    flush()
                    held = 0
    flush()
    home: Sequence[int] = ()
    last = -1
    for (row, n), all_found in sorted(best.items()):
        if all_found and row != last:
            home, last = places(texts[row].as_py()), row
        for distance, x, y in all_found:
            yield row, n, home[x], home[y - 1] + 1, distance


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """Benchmark passages in documents: key, item, start, end (in characters of the text), distance.

    A row for each item and place whose edit distance, in lower case and with
    one space for white space, is at most ``edits`` of the item's length;
    places of one item in one document do not overlap.  Null and empty texts
    and items match nothing, nor do items without a letter or digit.  Equal
    items are reported each under its own id, rows with equal keys each.  An
    empty table on either side gives no rows; other columns are not looked at.

    Items reach the tasks in slices of at most AT_ONCE characters (an item
    that is longer is a slice), one pass over the documents for each, so that
    what is sent has a bound.  Raises where the target recall is not reached.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    schema = f"_key {kind}, _hash long, _item {item_kind}, start long, end long, distance int"
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))

    def search(part: list[tuple[object, str]]) -> DataFrame:
        index = Index(part, edits, recall)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = sorted(_search(index, batch.column("_text")))
                own = pa.array([f[0] for f in found], pa.int64())
                cols = [batch.column("_key").take(own), batch.column("_hash").take(own), pa.array([index.items[f[1]][0] for f in found], item_type)]
                cols += [pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int32())]
                if found:
                    yield pa.RecordBatch.from_arrays(cols, ["_key", "_hash", "_item", "start", "end", "distance"])

        return rows.mapInArrow(run, schema)

    out, part, size = None, [], 0
    for r in benchmark.filter(F.col(item_text).isNotNull()).select(item, item_text).orderBy(item, item_text).toLocalIterator():
        if part and size + len(r[1]) > AT_ONCE:
            out = search(part) if out is None else out.unionByName(search(part))
            part, size = [], 0
        part.append((r[0], r[1]))
        size += len(r[1])
    if part:
        out = search(part) if out is None else out.unionByName(search(part))
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumnRenamed("_key", key).withColumnRenamed("_item", item)


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows in whose own text ``find`` finds an item; all columns stay.

    Of rows with one key, or none, only those with a passage go, repeated rows
    alike.  Null and empty texts stay, as does everything where either table is
    empty.
    """
    own, mark = unused(docs, "_id"), unused(docs, "_hash")
    found = find(docs, benchmark, key, text, **options).select(F.col(key).alias(own), F.col("_hash").alias(mark)).distinct()
    # as many rows as there are contaminated documents, so that the join is a shuffle at every size
    return docs.join(found.hint("merge"), F.col(key).eqNullSafe(F.col(own)) & (F.xxhash64(text) == F.col(mark)), "left_anti")
