"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of documents.  In each window a queue is credited with
its share of the window's tokens and sends documents from its head while its
credit covers them; what is left over is its deficit and carries on to the
next window.  A document is therefore sent in the first window whose summed-up
credit reaches the document's end in its queue, which is a function of that
end alone: no window waits for another, and credits run on across partitions.
The windows' documents, source after source, form one stream of tokens that is
cut into full sequences, so that only the last sequence is padded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stash

SEQUENCE = 2048
#: Sequences in a window.
WINDOW = 64
END = 1
BUCKETS, BLOCKS = 256, 4096
#: Pieces in a batch of the result, which has offsets of 32 bits.
PIECES = 4096
#: White space that tiktoken's backtracking may not bear.
LONG_SPACE = re.compile(r"\s{10000}")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a tokenizer file as an encoder from text to an array of ids.

    Ids are those of the tokenizers library with add_special_tokens=False, so
    that an added token's literal in a text is that token.  The vocabulary of
    the file is run by tiktoken, which gives the same ids (tests compare them)
    in a quarter of the time; texts with an added token, or with white space so
    long that its pattern gives up, are left to the library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = [t["content"] for t in spec["added_tokens"]]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(chars[c] for c in word): i for word, i in spec["model"]["vocab"].items() if all(c in chars for c in word) and word not in added}
    # fixed value: the pre-tokenising pattern of byte-level vocabularies, which their files do not spell out
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    bpe = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    library = Tokenizer.from_file(path)

    def encode(text: str) -> np.ndarray:
        if LONG_SPACE.search(text) or any(t in text for t in added):
            return np.array(library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return bpe.encode_to_numpy(text, disallowed_special=())

    return encode


def width(path: str) -> str:
    """The type of a stored id: 16 bits where they hold every id of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return "<u2" if max(END, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])) < 1 << 16 else "<u4"


def tokenize(docs: DataFrame, path: str, key: str, text: str, source: str) -> DataFrame:
    """_row, _key, _source, n, ids (little-endian 16-bit; 32-bit where the vocabulary is larger) of each document with END."""
    kind, stored = docs.schema[key].dataType.simpleString(), width(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [np.append(encode(t or ""), END).astype(stored) for t in part.column("_text").to_pylist()]
                sizes = pa.array([len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("_row"), part.column("_key"), part.column("_source"), sizes, pa.array([x.tobytes() for x in ids], pa.binary())], ["_row", "_key", "_source", "n", "ids"])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_row long, _key {kind}, _source string, n long, ids binary")


def _served(at: F.Column, totals: dict[str, int], weights: dict[str, float]) -> F.Column:
    """Tokens that all queues have sent when the round-robin's clock shows ``at``."""
    queues = F.array(*[F.struct(F.lit(float(weights[s])).alias("w"), F.lit(float(n)).alias("n")) for s, n in sorted(totals.items())])
    return F.aggregate(queues, F.lit(0.0), lambda a, q: a + F.least(q["n"], q["w"] * at))


def plan(counts: DataFrame, sequence: int = SEQUENCE, window: int = WINDOW, weights: dict[str, float] | None = None) -> DataFrame:
    """Each row of ``counts`` (_row, _key, _source, n) with its window and its first token's place in the stream.

    Queue order is by hash of the key.  Prefix sums are taken in buckets of a
    queue and in blocks of windows, whose totals are summed up apart, so that
    no queue and no window passes through one task.
    """
    spark = counts.sparkSession
    rows = counts.withColumn("_bucket", F.pmod(F.xxhash64("_key", "_row"), F.lit(BUCKETS)))
    sums = stash(rows.groupBy("_source", "_bucket").agg(F.sum("n").alias("_sum")), "queues")
    total = sums.agg(F.sum("_sum")).first()[0] or 0
    windows = max(1, -(-total // (sequence * window)))
    queue = Window.partitionBy("_source")
    upto = queue.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select("_source", "_bucket", (F.sum("_sum").over(upto) - F.col("_sum")).alias("_base"), F.sum("_sum").over(queue).alias("_all"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_key", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = rows.join(sums, ["_source", "_bucket"]).withColumn("_end", F.col("_base") + F.sum("n").over(inside))
    if weights is None:
        turn = F.ceil(F.col("_end").cast("double") * windows / F.col("_all"))
    else:
        totals = {r[0]: r[1] for r in sums.groupBy("_source").agg(F.first("_all")).limit(len(weights) + 1).collect()}
        if set(totals) - set(weights):
            raise ValueError("weights must name every source")
        rate = F.element_at(F.create_map(*[F.lit(x) for s in totals for x in (s, float(weights[s]))]), F.col("_source")) if totals else F.lit(1.0)
        turn = F.ceil(_served(F.col("_end") / rate, totals, weights) / (sequence * window))
    sent = ends.withColumn("window", F.greatest(F.lit(0), F.least(F.lit(windows - 1), turn - 1)).cast("long"))
    sent = sent.withColumn("_block", F.floor(F.col("window") * min(BLOCKS, windows) / windows))
    sent = stash(sent.select("_row", "n", "_source", "_end", "window", "_block"), "sent")
    blocks = sent.groupBy("_block").agg(F.sum("n").alias("_sum"))
    before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # at most BLOCKS rows
    blocks = blocks.select("_block", (F.sum("_sum").over(before) - F.col("_sum")).alias("_base"))
    stream = Window.partitionBy("_block").orderBy("window", "_source", "_end", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sent.withColumn("_upto", F.sum("n").over(stream)).join(F.broadcast(blocks), "_block")
    return placed.select("_row", "window", (F.col("_base") + F.col("_upto") - F.col("n")).alias("_at"))


def cut(placed: DataFrame, kind: str, sequence: int, stored: str = "<u2") -> DataFrame:
    """One row for each piece of a document that lies in one sequence; ids come as ``stored`` and are little-endian 32-bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                n, at = batch.column("n").to_numpy(), batch.column("_at").to_numpy()
                first, last = at // sequence, (at + n - 1) // sequence
                parts = last - first + 1
                doc = np.repeat(np.arange(len(n)), parts)
                seq = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts) + first[doc]
                begin = np.maximum(at[doc], seq * sequence)
                length = np.minimum(at[doc] + n[doc], (seq + 1) * sequence) - begin
                ids = np.concatenate([np.frombuffer(x.as_buffer(), dtype=stored) for x in batch.column("ids")])
                edges = np.append(0, np.cumsum(length))
                step = max(1, min(PIECES, (1 << 28) // sequence))
                for a in range(0, len(doc), step):
                    z = min(a + step, len(doc))
                    ends = ((edges[a : z + 1] - edges[a]) * 4).astype(np.int32)
                    pieces = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(ends), pa.py_buffer(ids[edges[a] : edges[z]].astype("<u4"))])
                    own, seqs = doc[a:z], seq[a:z]
                    whole_of = {c: batch.column(c).take(pa.array(own)) for c in ("_key", "_source", "window")}
                    yield pa.RecordBatch.from_arrays(
                        [whole_of["_key"], pa.array(begin[a:z] - at[own]), pa.array(length[a:z]), pieces, pa.array(n[own]), pa.array(seqs), pa.array(begin[a:z] - seqs * sequence), whole_of["_source"], whole_of["window"]],
                        ["_key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "source", "window"],
                    )

    return placed.mapInArrow(run, f"_key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, source string, window long")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str | None = None, sequence: int = SEQUENCE, window: int = WINDOW, weights: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all documents: key, start, length, ids, doc_tokens, sequence_id, offset, source, window.

    A null or empty text is the end id alone.  A null source is a queue of its
    own; a null key, or one that repeats, is a document for each row.  Without
    ``weights`` every queue's share is its share of all tokens, so that all
    queues last to the end; with them a queue that has run dry leaves its
    share to the others.  An empty table gives no rows; other columns are not
    looked at.
    """
    path = tokenizer or tokenizer_path()
    tokens = stash(tokenize(docs, path, key, text, source), "tokens")
    # both sides grow with the input, so that the join is a shuffle at every size
    placed = tokens.join(plan(tokens.select("_row", "_key", "_source", "n"), sequence, window, weights).hint("merge"), "_row")
    return cut(placed, docs.schema[key].dataType.simpleString(), sequence, width(path)).withColumnRenamed("_key", key)
