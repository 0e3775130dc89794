"""Language-model scores by deleted interpolation.

The probability of a word mixes the maximum-likelihood estimates of its bigram
and its unigram with a uniform one; the weights depend on how frequent the
context is.  They are learned by expectation-maximisation on held-out counts:
each block of training documents is deleted in turn, and its bigrams are
predicted from the counts of all others.

Counts cover all training documents and stay distributed.  A block of
documents sends its distinct words and bigrams once, as sorted hashes with
their counts, to the hash ranges that sum them up; a range answers with the
totals that differ from the block's own, in the order in which they were sent,
so that no hash travels back.  Words are told apart by 64 bits of
hash, bigrams by 56.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .langid import held_out
from .scratch import stash, unused
from .text import hash_word, mix, word_hashes

#: Bytes of text in a block, and of all text for one hash range.
BLOCK, RANGE = 8 << 20, 16 << 20
#: Blocks at least: of a single one, nothing would be left to learn the weights from when it is deleted.
FEWEST = 16
#: Context-frequency buckets are powers of two up to this one.
BUCKETS = 24
#: Held-out events are summed up in cells of this width in ln(count) and ln(probability).
CELL = 0.25
ROUNDS = 60
_START, _END = np.uint64(hash_word("\x01") ^ 0x5BD1E995), np.uint64(hash_word("\x02") ^ 0x5BD1E995)
WORD, BIGRAM = 0, 1


def _width(values: np.ndarray) -> int:
    return max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1


def _planes(values: np.ndarray, width: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplane(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def encode(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending hashes, as gaps, and counts, both in planes of as many bytes as they need."""
    gaps = np.diff(hashes, prepend=np.uint64(0))
    a, b = _width(gaps), _width(counts)
    return np.array([len(hashes), a, b], dtype="<u4").tobytes() + _planes(gaps, a) + _planes(counts, b)


def decode(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, a, b = np.frombuffer(data[:12], dtype="<u4").tolist()
    with np.errstate(over="ignore"):
        return np.cumsum(_unplane(data[12 : 12 + n * a], n, a), dtype=np.uint64), _unplane(data[12 + n * a :], n, b)


def reply(differs: np.ndarray, totals: np.ndarray) -> bytes:
    """A bit for each hash that was sent, and the totals of those whose bit is set."""
    width = _width(totals)
    return np.array([len(differs), len(totals), width], dtype="<u4").tobytes() + np.packbits(differs).tobytes() + _planes(totals, width)


def apply_reply(data: bytes, total: np.ndarray) -> None:
    """Writes the totals of a reply over those of the hashes that were sent."""
    n, changed, width = np.frombuffer(data[:12], dtype="<u4").tolist()
    body = 12 + -(-n // 8)
    differs = np.unpackbits(np.frombuffer(data[12:body], dtype=np.uint8), count=n).astype(bool)
    total[differs] = _unplane(data[body:], changed, width)


def tokens(texts: pa.Array, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts with an end after each, their bigram hashes, each text's bounds, and whether a token is of a training text."""
    hashes, bounds, _, _ = word_hashes(texts)
    sizes = np.diff(bounds) + 1
    edges = np.append(0, np.cumsum(sizes))
    word = np.empty(edges[-1], dtype=np.uint64)
    ends = edges[1:] - 1
    inner = np.ones(len(word), dtype=bool)
    inner[ends] = False
    word[inner], word[ends] = hashes, _END
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[edges[:-1]] = _START
    with np.errstate(over="ignore"):
        pair = mix(context * np.uint64(0x9E3779B97F4A7C15) + word) >> np.uint64(8)
    return word, pair, edges, np.repeat(train, sizes)


def _local(values: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, where each token's is, and their training counts."""
    found, where = np.unique(values, return_inverse=True)
    return found, where, np.bincount(where, weights=train, minlength=len(found)).astype(np.uint64)


def _range_of(found: np.ndarray, kind: int, ranges: int) -> np.ndarray:
    top = found >> np.uint64(32 if kind == WORD else 24)
    return ((top * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def merge(blocks: list[int], parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, dict[int, bytes]]:
    """How many of the parts' hashes have a count, and for each block the totals that differ from its own."""
    hashes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    home = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    found, where = np.unique(hashes, return_inverse=True)
    total = np.zeros(len(found), dtype=np.uint64)
    np.add.at(total, where, counts)
    out, other = {}, total[where] != counts
    edges = np.searchsorted(home, np.arange(len(parts) + 1))
    for i, block in enumerate(blocks):
        own = slice(edges[i], edges[i + 1])
        pick = other[own]
        if pick.any():
            out[block] = reply(pick, total[where[own][pick]])
    return int((total > 0).sum()), out


def _totals(found: np.ndarray, own: np.ndarray, kind: int, ranges: int, answers: list[tuple[int, bytes]]) -> np.ndarray:
    total = own.copy()
    edges = np.searchsorted(_range_of(found, kind, ranges), np.arange(ranges + 1))
    for r, data in answers:
        apply_reply(data, total[edges[r] : edges[r + 1]])
    return total


def _cells(x: np.ndarray) -> np.ndarray:
    """Cells of a positive number's logarithm; -1000 for 0."""
    return np.where(x > 0, np.floor(np.log(np.maximum(x, 1e-300)) / CELL), -1000).astype(np.int32)


def bucket_of(counts: np.ndarray) -> np.ndarray:
    """0 for a context that was never seen, then one bucket for each power of two."""
    return np.where(counts > 0, np.minimum(np.floor(np.log2(np.maximum(counts, 1))) + 1, BUCKETS), 0).astype(np.int64)


def learn(cells: list[tuple[int, int, int, float]], n: int, v: int) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket from (bucket, cell of the bigram's probability, cell of the word's count, events)."""
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS + 1, 1))
    weights[0] = [0.0, 0.8, 0.2]
    if not cells:
        return weights
    bucket, two, one, events = (np.array(x) for x in zip(*cells, strict=True))
    middle = lambda c: np.where(c > -1000, np.exp((c + 0.5) * CELL), 0.0)
    p = np.stack([np.minimum(middle(two), 1.0), np.minimum(middle(one) / max(n, 1), 1.0), np.full(len(two), 1 / (v + 1))], axis=1)
    for _ in range(ROUNDS):
        share = weights[bucket] * p
        share = share / share.sum(axis=1, keepdims=True) * events[:, None]
        for k in range(3):
            weights[:, k] = np.bincount(bucket, weights=share[:, k], minlength=BUCKETS + 1)
        # one event for each estimate that the bucket can have keeps weights off 0
        weights += np.where(np.arange(BUCKETS + 1)[:, None] > 0, 1.0, [[0.0, 1.0, 1.0]])
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


def numbered(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns that tell its rows apart, repeated ones too, and stay the same when a task runs again.

    Files' rows have their file and place; of any other frame ``columns`` are
    written down once, under row numbers.
    """
    row = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    try:
        return docs, docs.select(*row) and row
    except AnalysisException:
        name = unused(docs, "_place")
        return stash(docs.select(*columns, F.monotonically_increasing_id().alias(name)), "numbered"), [F.col(name)]


def count(docs: DataFrame, key: str, text: str, parts: int, part: int) -> DataFrame:
    """Each row's counts under the training documents, with the held-out events of its block.

    Document rows: _key, held_out, n_tokens, n_known, words and bigrams (each
    token's counts, little-endian).  Rows with a bucket: a cell of held-out
    events.  Rows with a vocabulary: distinct training tokens of hash ranges.
    """
    kind = docs.schema[key].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks, ranges = max(FEWEST, -(-size // BLOCK)), max(1, -(-size // RANGE))
    out = held_out(F.col(key), parts, part)
    docs, row = numbered(docs, [key, text])
    rows = docs.select(F.pmod(F.xxhash64(*row), F.lit(blocks)).cast("int").alias("block"), F.col(key).alias("_key"), out.alias("held_out"), F.col(text).alias("_text"))

    def send(table: pa.Table) -> pa.Table:
        train = ~table.column("held_out").to_numpy()
        word, pair, _, own = tokens(table.column("_text"), train)
        block = table.column("block")[0].as_py()
        to, what, data = [], [], []
        for k, values in ((WORD, word), (BIGRAM, pair)):
            found, _, counts = _local(values, own)
            home = _range_of(found, k, ranges)
            edges = np.searchsorted(home, np.arange(ranges + 1))
            for r in np.flatnonzero(np.diff(edges)).tolist():
                to.append(r), what.append(k), data.append(encode(found[edges[r] : edges[r + 1]], counts[edges[r] : edges[r + 1]]))
        return pa.table({"range": pa.array(to, pa.int32()), "kind": pa.array(what, pa.int32()), "block": pa.array([block] * len(to), pa.int32()), "data": pa.array(data, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        what, home, data = (table.column(c).to_pylist() for c in ("kind", "block", "data"))
        block, kinds, totals, vocabulary = [], [], [], []
        own_range = table.column("range")[0].as_py()
        for k in (WORD, BIGRAM):
            mine = [i for i, x in enumerate(what) if x == k]
            if not mine:
                continue
            known, by = merge([home[i] for i in mine], [decode(data[i]) for i in mine])
            for b, d in by.items():
                block.append(b), kinds.append(k), totals.append(d), vocabulary.append(None)
            if k == WORD:
                block.append(-1 - own_range), kinds.append(k), totals.append(None), vocabulary.append(known)
        return pa.table({"block": pa.array(block, pa.int32()), "range": pa.array([own_range] * len(block), pa.int32()), "kind": pa.array(kinds, pa.int32()), "data": pa.array(totals, pa.binary()), "vocabulary": pa.array(vocabulary, pa.int64())})

    schema = f"_key {kind}, held_out boolean, n_tokens long, n_known long, words binary, bigrams binary, bucket int, two int, one int, events long, vocabulary long"

    def resolve(mine: pa.Table, answers: pa.Table) -> pa.Table:
        docs_out, cell, known = {}, [], [x for x in answers.column("vocabulary").to_pylist() if x is not None]
        n = mine.num_rows
        if n:
            train = ~mine.column("held_out").to_numpy()
            word, pair, edges, own = tokens(mine.column("_text"), train)
            data = defaultdict(list)
            for k, r, d in zip(answers.column("kind").to_pylist(), answers.column("range").to_pylist(), answers.column("data").to_pylist(), strict=True):
                if d is not None:
                    data[k].append((r, d))
            w, at_w, mine_w = _local(word, own)
            p, at_p, mine_p = _local(pair, own)
            all_w, all_p = _totals(w, mine_w, WORD, ranges, data[WORD]), _totals(p, mine_p, BIGRAM, ranges, data[BIGRAM])
            count_w, count_p = all_w[at_w].astype("<u8"), all_p[at_p].astype("<u8")
            first = np.zeros(len(word), dtype=bool)
            first[edges[:-1]] = True
            # held-out events: the block's own counts are deleted
            del_w = (all_w - mine_w).astype(np.float64)
            end = np.searchsorted(w, _END)
            context = np.empty(len(word), dtype=np.float64)
            context[1:] = del_w[at_w[:-1]]
            context[first] = del_w[end]
            one, two = del_w[at_w], (all_p - mine_p).astype(np.float64)[at_p]
            prob = np.divide(two, context, out=np.zeros(len(two)), where=context > 0)
            events = np.stack([bucket_of(context), _cells(prob), _cells(one)], axis=1)[own]
            cell, number = np.unique(events, axis=0, return_counts=True) if len(events) else ([], [])
            wide = 4 if not len(count_w) or int(count_w.max()) < 1 << 32 else 8
            take = lambda c: [wide.to_bytes(1, "little") + c[a:b].astype(f"<u{wide}").tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            seen = np.add.reduceat((count_w > 0).astype(np.int64), edges[:-1])
            docs_out = {"_key": mine.column("_key").combine_chunks(), "held_out": mine.column("held_out").combine_chunks(), "n_tokens": np.diff(edges), "n_known": seen, "words": pa.array(take(count_w), pa.binary()), "bigrams": pa.array(take(count_p), pa.binary())}
        more = [{"bucket": int(c[0]), "two": int(c[1]), "one": int(c[2]), "events": int(e)} for c, e in zip(cell, number, strict=True)] if len(cell) else []
        more += [{"vocabulary": x} for x in known]
        types = {"bucket": pa.int32(), "two": pa.int32(), "one": pa.int32(), "events": pa.int64(), "vocabulary": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "words": pa.binary(), "bigrams": pa.binary(), "_key": key_type}
        cols = {}
        for name in ("_key", "held_out", "n_tokens", "n_known", "words", "bigrams", "bucket", "two", "one", "events", "vocabulary"):
            head = docs_out.get(name)
            head = pa.nulls(n, types[name]) if head is None else pa.array(head) if isinstance(head, np.ndarray) else head
            cols[name] = pa.chunked_array([head.cast(types[name]), pa.array([m.get(name) for m in more], types[name])])
        return pa.table(cols)

    key_type = to_arrow_type(docs.schema[key].dataType)
    sent = rows.groupBy("block").applyInArrow(send, "range int, kind int, block int, data binary")
    totals = sent.groupBy("range").applyInArrow(answer, "block int, range int, kind int, data binary, vocabulary long")
    return rows.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(resolve, schema)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int = 7, part: int = 2) -> DataFrame:
    """A row for each row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents outside the held-out part; a null key is not held
    out.  A null or empty text is its end token alone.  Rows with equal keys
    are documents each.  Without training documents every estimate but the
    uniform one is 0.  An empty table gives no rows; other columns are not
    looked at.
    """
    kind = docs.schema[key].dataType.simpleString()
    counted = stash(count(docs, key, text, parts, part), "counts")
    n, v, known = counted.agg(F.sum(F.when(~F.col("held_out"), F.col("n_tokens"))), F.sum("vocabulary"), F.count_if(~F.col("held_out"))).first()
    n, v, starts = n or 0, v or 0, known or 0
    # at most buckets times cells of either logarithm
    cells = [tuple(r) for r in counted.filter("bucket is not null").groupBy("bucket", "two", "one").agg(F.sum("events")).collect()]
    weights = learn(cells, n, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, full = [], []
            for words, bigrams in zip(batch.column("words"), batch.column("bigrams"), strict=True):
                words, bigrams = words.as_py(), bigrams.as_py()
                c = np.frombuffer(words[1:], dtype=f"<u{words[0]}").astype(np.float64)
                two = np.frombuffer(bigrams[1:], dtype=f"<u{bigrams[0]}").astype(np.float64)
                context = np.append(starts, c[:-1])
                lam = weights[bucket_of(context)]
                p = lam[:, 0] * np.divide(two, context, out=np.zeros(len(two)), where=context > 0) + lam[:, 1] * c / max(n, 1) + lam[:, 2] / (v + 1)
                base.append(float(np.sum(np.log10((c + 1) / (n + v + 1)))))
                full.append(float(np.sum(np.log10(p))))
            cols = [batch.column(c) for c in ("_key", "held_out", "n_tokens", "n_known")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([n] * batch.num_rows, pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64())], ["_key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = counted.filter("words is not null").select("_key", "held_out", "n_tokens", "n_known", "words", "bigrams")
    return rows.mapInArrow(run, f"_key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("_key", key)
