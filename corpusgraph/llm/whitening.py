"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Each partition keeps the count, the mean and the full-rank singular values and
right vectors of its centred rows; batch after batch is merged into it.  A
merge stacks both sides' scaled vectors and one row that corrects the means,
sqrt(n1 n2 / (n1 + n2)) (m1 - m2), and decomposes the stack anew, so that no
direction is ever dropped and any tree of merges has the covariance of all
rows.  Partitions' summaries are merged FAN at a time on the executors; what
the driver gets is the last one's values, and a vector for each component.

Entries are whole numbers, floor(64 c) + OFFSET.  OFFSET cancels out of every
centred figure and is left away; sums and deviations are exact integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stash

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
FAN = 16
ROWS = 2048
#: Directions whose singular value is a smaller share of the largest have no variance but rounding's, and are no components.
LEAST = 1e-10
_SUMMARY = "n long, dim int, sums array<string>, mean array<double>, scale array<double>, vectors binary"


@dataclass
class Summary:
    """Count, exact sums, mean, singular values and right vectors of centred rows."""

    n: int
    sums: list[int]
    mean: np.ndarray
    scale: np.ndarray
    vectors: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.mean)

    def row(self) -> dict:
        return {"n": self.n, "dim": self.dim, "sums": [str(x) for x in self.sums], "mean": self.mean.tolist(), "scale": self.scale.tolist(), "vectors": np.ascontiguousarray(self.vectors).tobytes()}

    @staticmethod
    def of(row: dict) -> Summary:
        return Summary(row["n"], [int(x) for x in row["sums"]], np.array(row["mean"]), np.array(row["scale"]), np.frombuffer(row["vectors"]).reshape(len(row["scale"]), row["dim"]))


def summed(whole: np.ndarray) -> list[int]:
    """Exact column sums of 64-bit integers."""
    high, low = (whole >> 32).sum(axis=0), (whole & 0xFFFFFFFF).sum(axis=0)
    return [(int(h) << 32) + int(x) for h, x in zip(high, low, strict=True)]


def summary(whole: np.ndarray) -> Summary:
    """Of a batch of integer rows."""
    rows = whole.astype(np.float64)
    mean = rows.mean(axis=0)
    _, scale, vectors = np.linalg.svd(rows - mean, full_matrices=False)
    return Summary(len(rows), summed(whole), mean, scale, vectors)


def merged(a: Summary, b: Summary) -> Summary:
    """Of both sides' rows; without loss, for all directions of either side and of the means' difference are kept."""
    n = a.n + b.n
    apart = np.sqrt(a.n / n * b.n) * (a.mean - b.mean)
    _, scale, vectors = np.linalg.svd(np.vstack([a.scale[:, None] * a.vectors, b.scale[:, None] * b.vectors, apart]), full_matrices=False)
    return Summary(n, [x + y for x, y in zip(a.sums, b.sums, strict=True)], a.mean + (b.mean - a.mean) * (b.n / n), scale, vectors)


def entries(vector: Column) -> Column:
    """floor(64 c) of each entry; null where the vector is null or has an entry that is null, not finite, or whose whole number is no long."""
    wide = vector.cast("array<double>")
    good = wide.isNotNull() & F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 56)))
    return F.when(good, F.transform(wide, lambda c: F.floor(c * SCALE)))


def vectors_of(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """_key, _x of the rows whose vector can be used."""
    return rows.select(F.col(key).alias("_key"), entries(F.col(vector)).alias("_x")).filter("_x is not null and size(_x) > 0")


def _blocks(column: pa.Array, rows: int = ROWS) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end, matrix) of runs of equally long lists."""
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    lo = 0
    while lo < len(sizes):
        other = np.flatnonzero(sizes[lo : lo + rows] != sizes[lo])
        hi = lo + int(other[0]) if len(other) else min(lo + rows, len(sizes))
        yield lo, hi, values[ends[lo] : ends[hi]].reshape(hi - lo, sizes[lo])
        lo = hi


def _tree(parts: DataFrame, join: Callable, name: str, fan: int) -> DataFrame:
    """One row out of all, ``fan`` rows at a time."""
    parts = stash(parts, name)
    left = parts.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                held = join(held, batch.slice(i, 1).to_pylist()[0])
        if held is not None:
            yield pa.RecordBatch.from_pylist([held], schema=batch.schema)

    while left > 1:
        tasks = -(-left // fan)
        parts = stash(parts.repartition(tasks).mapInArrow(run, parts.schema), name)
        left = min(tasks, parts.count())
    return parts


@dataclass
class Model:
    """What whitening needs: n, exact sums without OFFSET, all eigenvalues, and the components as rows."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        return self.values[: len(self.components)] / self.values.sum()


def fit(vectors: DataFrame, components: int = COMPONENTS, fan: int = FAN, rows: int = ROWS) -> Model | None:
    """The model of all ``vectors`` (_x), whatever their partitions; None where there is none.

    The dimension is that of the longest vector: a shorter one lacks entries,
    as if they were null, and does not count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for _, _, block in _blocks(batch.column(0), rows):
                if held is None or block.shape[1] > held.dim:
                    held = summary(block)
                elif block.shape[1] == held.dim:
                    held = merged(held, summary(block))
        if held is not None:
            yield pa.RecordBatch.from_pylist([held.row()], schema=schema)

    schema = pa.schema([("n", pa.int64()), ("dim", pa.int32()), ("sums", pa.list_(pa.string())), ("mean", pa.list_(pa.float64())), ("scale", pa.list_(pa.float64())), ("vectors", pa.binary())])

    def join(held, row):
        if held is None or row["dim"] > held["dim"]:
            return row
        return held if row["dim"] < held["dim"] else merged(Summary.of(held), Summary.of(row)).row()

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r | {"vectors": r["vectors"][: 8 * components * r["dim"]]} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    last = _tree(vectors.select("_x").mapInArrow(run, _SUMMARY), join, "decompositions", fan).mapInArrow(trim, _SUMMARY).first()
    if last is None:
        return None
    scale = np.array(last["scale"])
    used = int(np.count_nonzero(scale[:components] > LEAST * scale[0])) if len(scale) and scale[0] > 0 else 0
    parts = np.frombuffer(bytes(last["vectors"])).reshape(-1, last["dim"])[:used]
    largest = np.abs(parts).argmax(axis=1) if used else []
    sign = np.sign(parts[np.arange(used), largest]) if used else np.ones(0)
    return Model(last["n"], [int(x) for x in last["sums"]], scale**2 / last["n"], parts * sign[:, None])


def squares(gap: np.ndarray) -> list[int]:
    """Exact sums of each row's squares."""
    most, dim = int(np.abs(gap).max(initial=0)), gap.shape[1]
    if most**2 * dim < 1 << 63:
        return (gap * gap).sum(axis=1).tolist()
    if most < 1 << 52 and dim <= 1 << 11:
        high, low = gap >> 26, gap & (1 << 26) - 1
        parts = zip(*[(a * b).sum(axis=1).tolist() for a, b in ((high, high), (high, low), (low, low))], strict=True)
        return [(h << 52) + (m << 27) + x for h, m, x in parts]
    return [sum(int(g) ** 2 for g in row) for row in gap]


def project(model: Model, whole: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Whitened rows, and each row's exact sum of (n x - S)^2."""
    n, far = model.n, max(map(abs, model.sums), default=0)
    wide = n * int(np.abs(whole).max(initial=0)) + far >= 1 << 62
    gap = n * (whole.astype(object) if wide else whole) - np.array(model.sums, dtype=object if wide else np.int64)
    centred = gap.astype(np.float64) / n
    return centred @ model.components.T / np.sqrt(model.values[: len(model.components)]), squares(gap)


def whiten(model: Model, vectors: DataFrame, rows: int = ROWS) -> DataFrame:
    """_key, deviation, whitened (array of double, a value for each component) of ``vectors``; rows shorter than the model are left out."""
    kind, dim = vectors.schema["_key"].dataType.simpleString(), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, block in _blocks(batch.column("_x"), rows):
                if block.shape[1] != dim:
                    continue
                white, deviation = project(model, block)
                ends = pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1])
                lists = pa.ListArray.from_arrays(ends, pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("_key").slice(lo, hi - lo), pa.array(deviation, pa.decimal128(38, 0)), lists], ["_key", "deviation", "whitened"])

    return vectors.select("_key", "_x").mapInArrow(run, f"_key {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(model: Model, vectors: DataFrame, fan: int = FAN, rows: int = ROWS) -> float:
    """The largest entry of |covariance of the whitened vectors - identity|; batches are centred, and merged with their means' difference."""
    dim, size = len(model.sums), len(model.components)
    schema = pa.schema([("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("moments", pa.list_(pa.float64()))])

    def join(held, row):
        if held is None:
            return row
        n, apart = held["n"] + row["n"], np.array(row["mean"]) - np.array(held["mean"])
        moments = np.array(held["moments"]) + np.array(row["moments"]) + (np.outer(apart, apart) * (held["n"] / n * row["n"])).ravel()
        return {"n": n, "mean": (np.array(held["mean"]) + apart * (row["n"] / n)).tolist(), "moments": moments.tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for _, _, block in _blocks(batch.column(0), rows):
                if block.shape[1] == dim:
                    white, _ = project(model, block)
                    mean = white.mean(axis=0)
                    held = join(held, {"n": len(white), "mean": mean.tolist(), "moments": ((white - mean).T @ (white - mean)).ravel().tolist()})
        if held is not None:
            yield pa.RecordBatch.from_pylist([held], schema=schema)

    last = _tree(vectors.select("_x").mapInArrow(run, "n long, mean array<double>, moments array<double>"), join, "moments", fan).first()
    return float(np.abs(np.array(last["moments"]).reshape(size, size) / last["n"] - np.eye(size)).max())


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, fan: int = FAN) -> DataFrame:
    """A row for each vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, or hold null or non-finite entries (or such
    whose whole number is no long) are left out, and so are those shorter than
    the longest, which lack entries.  Repeated rows and null keys count as rows
    each.  Directions without variance are no components; equal vectors alone,
    and an empty table, give no rows.  A deviation beyond a long raises.  Other
    columns are not looked at.
    """
    vectors = vectors_of(rows, key, vector)
    model = fit(vectors, components, fan)
    kind = rows.schema[key].dataType.simpleString()
    if model is None or not len(model.components):
        return rows.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(model, vectors, fan)
    each = whiten(model, vectors).select("_key", "deviation", F.posexplode("whitened").alias("_i", "whitened"))
    explained = F.array(*[F.lit(float(x)) for x in model.explained])
    return each.select(F.col("_key").alias(key), (F.col("_i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened", F.get(explained, F.col("_i")).alias("explained"), F.lit(error).alias("identity_error"))
