"""Whitening of embeddings with an exact covariance.

1. Every entry becomes a whole number. Each is split into signed digits of
   ``DIGIT_BITS`` bits, one matrix a digit, with a last column of ones. Over at most ``BLOCK_ROWS`` rows
   every partial sum of a product of two digit matrices is a whole number below 2^53,
   so float64 matrix products are exact in any order.
2. A task adds products of the same power of the base over its blocks and emits one row for each pair of
   dimensions and power; Spark adds those as decimals. The corpus reaches the driver as these
   sums alone, one for each pair of dimensions and power.
3. The driver puts the digits together as big integers: the column of ones has given n and the sums S,
   and n * sum(x x') - S S' is the exact numerator of the covariance. It is divided once, correctly rounded,
   and decomposed.
4. Rows are projected where they are; means and products of the projections are summed for the check of identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm import _kernel, _shared

SCALE, OFFSET = 1024.0, 100_000
DIGIT_BITS = 18
#: Digits are at most 2^17 in size, so sums over a block stay below 2^34 * 2^16 = 2^50.
BLOCK_ROWS = 1 << 16
#: Numbers saturate here, far beyond any embedding.
MOST = 1 << 62
#: Blocks whose exact sums, below 2^50 each and four to a power at most, fit one 64-bit number.
MOST_BLOCKS = 1 << 10


class Model(NamedTuple):
    n: int
    sums: list[int]
    #: Covariance of the whole numbers, each entry correctly rounded.
    covariance: np.ndarray
    #: Falling, with the unit eigenvectors as columns.
    values: np.ndarray
    vectors: np.ndarray

    @property
    def trace(self) -> float:
        return float(np.trace(self.covariance))


def usable(vector: Column) -> Column:
    """True if the vector and all its entries are there and finite."""
    entry = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.coalesce(vector.isNotNull() & F.forall(vector.cast("array<double>"), entry), F.lit(False))


def whole_numbers(column: pa.Array, dims: int) -> np.ndarray:
    """floor(1024 * c) + 100000 of every entry, rows by dimensions."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)
    with np.errstate(over="ignore"):
        floor = np.floor(flat * SCALE)
    # The bound is a power of two, so it is exact as a float.
    return np.clip(floor, -float(MOST), float(MOST)).astype(np.int64) + OFFSET


def digits(x: np.ndarray) -> list[np.ndarray]:
    """x = sum of digit_k * 2^(18 k), each digit in [-2^17, 2^17) as float64; as many as the largest number takes."""
    half, base, out = 1 << (DIGIT_BITS - 1), 1 << DIGIT_BITS, []
    rest = x
    while len(out) == 0 or np.any(rest):
        low = ((rest + half) & (base - 1)) - half
        out.append(low.astype(np.float64))
        rest = (rest - low) >> DIGIT_BITS
    return out


def products(x: np.ndarray) -> dict[int, np.ndarray]:
    """By power of the base, the exact sums of x x' over one block, with a column of ones behind x."""
    parts = digits(np.column_stack([x, np.ones(len(x), dtype=np.int64)]))
    out: dict[int, np.ndarray] = {}
    for j, left in enumerate(parts):
        for k, right in enumerate(parts):
            made = (left.T @ right).astype(np.int64)
            out[j + k] = out[j + k] + made if j + k in out else made
    return out


GRAM = "i int, j int, power int, value long"


def _grams(dims: int):
    upper = np.triu_indices(dims + 1)

    def rows(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for power, total in sums.items():
            columns = [upper[0].astype(np.int32), upper[1].astype(np.int32), np.full(len(upper[0]), power, dtype=np.int32), total[upper]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "power", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        blocks = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                for power, made in products(whole_numbers(batch.column("vector").slice(at, BLOCK_ROWS), dims)).items():
                    sums[power] = sums[power] + made if power in sums else made
                blocks += 1
                if blocks == MOST_BLOCKS:
                    yield from rows(sums)
                    sums, blocks = {}, 0
        yield from rows(sums)

    return run


def fit(vectors: DataFrame, dims: int) -> Model | None:
    """The exact covariance of all rows of ``vector``, decomposed; None without rows."""
    sums = vectors.mapInArrow(_grams(dims), GRAM).groupBy("i", "j", "power").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    gram = [[0] * (dims + 1) for _ in range(dims + 1)]
    for i, j, power, value in sums.collect():
        gram[i][j] += int(value) << (DIGIT_BITS * power)
    n, total = gram[dims][dims], [gram[i][dims] for i in range(dims)]
    if not n:
        return None
    covariance = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            # Division of big integers is correctly rounded.
            covariance[i, j] = covariance[j, i] = (n * gram[i][j] - total[i] * total[j]) / (n * n)
    values, vectors_ = np.linalg.eigh(covariance)
    return Model(n, total, covariance, values[::-1], vectors_[:, ::-1])


def components(model: Model, most: int) -> int:
    """How many of the first ``most`` components have a variance that is not rounding."""
    floor = len(model.values) * np.finfo(np.float64).eps * max(float(model.values[0]), 0.0)
    return int((model.values[:most] > floor).sum()) if len(model.values) else 0


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, list[int]]:
    """(x - S/n as float64, sum of (n*x - S)^2 as whole numbers)."""
    largest = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    reach = n * largest + max(map(abs, sums), default=0)
    if reach < 1 << 62:
        y = n * x - np.array(sums, dtype=np.int64)
        most = int(np.abs(y).max(initial=0))
        if most * most * x.shape[1] < 1 << 63:
            return y / n, (y * y).sum(axis=1).tolist()
        # Two halves of 31 bits: squares and products of halves fit, their sums are put together as big integers.
        high, low = y >> 31, y & ((1 << 31) - 1)
        if x.shape[1] < 1 << 30:
            parts = [_wide(high, high), _wide(high, low), _wide(low, low)]
            return y / n, [(a << 62) + (b << 32) + c for a, b, c in zip(*parts)]
    y = n * x.astype(object) - np.array(sums, dtype=object)
    return np.array([[v / n for v in row] for row in y.tolist()], dtype=np.float64).reshape(x.shape), [sum(v * v for v in row) for row in y.tolist()]


def _wide(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Row sums of a * b, below 2^62 each, as big integers: their upper and lower 32 bits are summed apart."""
    made = a * b
    upper, lower = (made >> 32).sum(axis=1).tolist(), (made & 0xFFFFFFFF).sum(axis=1).tolist()
    return [(u << 32) + v for u, v in zip(upper, lower)]


def _projector(model: Model, dims: int, count: int):
    basis = model.vectors[:, :count] / np.sqrt(model.values[:count])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred, squares = deviations(whole_numbers(batch.column("vector"), dims), model.n, model.sums)
            # A fixed order of summing, whatever rows a batch holds, so equal vectors get equal results.
            made = np.einsum("rd,dk->rk", centred, basis)
            far = pa.array([str(v) for v in squares], pa.string())
            white = _kernel.lists(made.ravel(), np.full(batch.num_rows, count), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), far, white], ["vec_id", "deviation", "white"])

    return run


def _moments(count: int, means: np.ndarray | None):
    """Sums of the projections (``j`` is -1), or with means of their products once centred."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, count) if means is not None else (count, 1))
        for batch in batches:
            white = batch.column("white").flatten().to_numpy().reshape(batch.num_rows, count)
            total += white.sum(axis=0)[:, None] if means is None else (white - means).T @ (white - means)
        i, j = np.indices(total.shape)
        columns = [i.ravel().astype(np.int32), (j.ravel() - (means is None)).astype(np.int32), total.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "value"])

    return run


def identity_error(white: DataFrame, n: int, count: int) -> float:
    """Largest entry, by size, of the covariance of ``white`` minus the identity; centred before multiplying."""

    def summed(means: np.ndarray | None) -> np.ndarray:
        out = np.zeros((count, count + 1))
        for i, j, value in white.select("white").mapInArrow(_moments(count, means), "i int, j int, value double").groupBy("i", "j").agg(F.sum("value")).collect():
            out[i, j] = value
        return out[:, :count] if means is not None else out[:, -1]

    means = summed(None) / n
    return float(np.abs(summed(means) / n - np.eye(count)).max())


def dimensions(vectors: DataFrame) -> int:
    """The length that most vectors have; of equally frequent lengths the largest."""
    size = F.size("vector")
    found = vectors.groupBy(size.alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    return found[0].dims if found else 0


RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(table: DataFrame, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each vector and component.

    Vectors that are null or hold null or non-finite entries are dropped, then those of another length than the
    most frequent one (of equally frequent ones the longest). Entries become
    x = floor(1024 * c) + 100000, up to 2^62 in size, where they saturate. Components run from 1 by falling
    variance up to ``most``; those whose variance is zero, or not above rounding, can't be whitened and are left out, so
    a table of equal vectors, a single vector, vectors without entries and an empty table have no rows. ``deviation`` is the exact sum of
    (n*x - S)^2, null if it takes more than 38 digits. Null and repeated ids and repeated vectors are
    rows of their own; other columns are not read.
    """
    spark = table.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    vectors = table.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).filter(usable(F.col("vector")))
    dims = dimensions(vectors)
    vectors = vectors.filter(F.size("vector") == dims)
    model = fit(vectors, dims) if dims else None
    count = components(model, most) if model else 0
    if not count:
        return spark.createDataFrame([], RESULT)
    white = _shared.materialize(vectors.mapInArrow(_projector(model, dims, count), "vec_id long, deviation string, white array<double>"), "white")
    error = identity_error(white, model.n, count)
    shares = F.array(*[F.lit(float(v) / model.trace) for v in model.values[:count]])
    each = white.select("vec_id", F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"), F.posexplode("white").alias("k", "whitened"))
    return each.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"),
    )
