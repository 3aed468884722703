"""Whitening of embeddings on exact covariances: digit-slice products of integers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, spare_names

#: Entries are quantised to floor(SCALE * c) + SHIFT.
SCALE = 1024
SHIFT = 100_000
#: Bits of a limb, and rows of a product: ROWS * 4 ** LIMB stays below 2 ** 53, where doubles are exact.
LIMB = 16
ROWS = 8192
#: Digits in which long sums travel, so that sums over tasks stay far from a long's end.
DIGIT = 32


def quantise(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + SHIFT as longs; entries beyond 2 ** 62 stop there."""
    return np.clip(np.floor(SCALE * flat.astype(np.float64)), -(2.0**62), 2.0**62).astype(np.int64) + SHIFT


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Arrays of doubles l with x = sum of l[k] * 2 ** (LIMB * k), each below 2 ** LIMB in size and with its entry's sign: as many as the largest needs."""
    sign, rest = np.where(x < 0, -1, 1), np.abs(x)
    out = []
    while rest.any():
        out.append((sign * (rest & (1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums: longs if all fit, Python's integers otherwise. The whole part of the mean goes first, so that what n multiplies is small."""
    means = np.array([s // n for s in sums], np.int64)
    rest, off = [s % n for s in sums], x - means
    if n * (int(np.abs(off).max(initial=0)) + 1) < 2**62:
        return n * off - np.array(rest, np.int64)
    return n * off.astype(object) - np.array(rest, object)


class Gram:
    """The sum of z' z over rows of integers, by limbs. Products are doubles and exact, their sums longs, and whole numbers are made once, at the end."""

    def __init__(self, dimensions: int):
        self.dimensions, self.parts, self.whole, self.rows = dimensions, {}, np.zeros((dimensions, dimensions), object), 0

    def add(self, z: np.ndarray) -> None:
        for at in range(0, len(z), ROWS):
            some = limbs(z[at : at + ROWS])
            for i, j in combinations_with_replacement(range(len(some)), 2):
                product = some[i].T @ some[j]
                if i != j:
                    product += product.T
                held = self.parts.setdefault(i + j, np.zeros((self.dimensions, self.dimensions), np.int64))
                held += product.astype(np.int64)
            self.rows += ROWS
            if self.rows >= 1 << 27:  # some products share a power, and doubling takes one bit
                self.settle()

    def settle(self) -> None:
        for power, part in self.parts.items():
            self.whole += part.astype(object) << (LIMB * power)
        self.parts, self.rows = {}, 0


def digits(values: list[int]) -> list[list[int]]:
    """Signed digits of DIGIT bits of each number, lowest first."""
    out = []
    for v in values:
        sign, rest, row = (-1 if v < 0 else 1), abs(v), []
        while rest:
            row.append(sign * (rest & (1 << DIGIT) - 1))
            rest >>= DIGIT
        out.append(row or [0])
    return out


def _rows(keys: list[tuple[int, int]], values: list[int]) -> pa.RecordBatch:
    rows = [(i, j, k, d) for (i, j), ds in zip(keys, digits(values), strict=True) for k, d in enumerate(ds)]
    columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["i", "j", "k", "digit"])


def _whole(parts: DataFrame) -> dict[tuple[int, int], int]:
    """The numbers whose digits tasks have given, added up by Spark: as many as the dimensions have pairs, at any number of rows."""
    out: dict[tuple[int, int], int] = {}
    for i, j, k, digit in parts.groupBy("i", "j", "k").agg(F.sum("digit").alias("digit")).toLocalIterator():
        out[i, j] = out.get((i, j), 0) + (digit << DIGIT * k)
    return out


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return quantise(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), dimensions)


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers alone."""
    c = F.col(vector)
    return df.where(c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))))


def moments(rows: DataFrame, dimensions: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S and the sum of (n*x-S)'(n*x-S) over rows of one column of vectors: exact, in two passes."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(dimensions, np.int64), [0] * dimensions
        for batch in batches:
            x = _matrix(batch.column(0), dimensions)
            n += len(x)
            low += (x & (1 << DIGIT) - 1).sum(axis=0)
            high = [h + int(s) for h, s in zip(high, (x >> DIGIT).sum(axis=0), strict=True)]
        if n:
            yield _rows([(i, 0) for i in range(dimensions)] + [(-1, 0)], [int(b) + (h << DIGIT) for b, h in zip(low, high, strict=True)] + [n])

    shape = "i int, j int, k int, digit long"
    found = _whole(rows.mapInArrow(sums, shape))
    n, total = found.get((-1, 0), 0), [found.get((i, 0), 0) for i in range(dimensions)]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, seen = Gram(dimensions), False
        for batch in batches:
            seen = True
            gram.add(centred(_matrix(batch.column(0), dimensions), n, total))
        gram.settle()
        keys = [(i, j) for i in range(dimensions) for j in range(i, dimensions)]
        if seen:
            yield _rows(keys, [gram.whole[k] for k in keys])

    square = np.zeros((dimensions, dimensions), object)
    for (i, j), v in _whole(rows.mapInArrow(products, shape)).items():
        square[i, j] = square[j, i] = v
    return n, total, square


def deviations(z: np.ndarray) -> list[int]:
    """The sum of squares of each row of integers, exact."""
    parts = limbs(z)
    out = [0] * len(z)
    for i, j in combinations_with_replacement(range(len(parts)), 2):
        times = 2 if i != j else 1
        sums = [0] * len(z)
        for at in range(0, z.shape[1], ROWS):
            sums = [s + int(v) for s, v in zip(sums, (parts[i][:, at : at + ROWS] * parts[j][:, at : at + ROWS]).sum(axis=1), strict=True)]
        out = [o + (times * s << LIMB * (i + j)) for o, s in zip(out, sums, strict=True)]
    return out


def whiten(df: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row per remaining row of ``df`` and component, from 1 on.

    Entries become integers (``quantise``). One pass sums them; a second centres each row times n, slices the integers into limbs,
    multiplies the limbs as doubles in BLAS, recombines whole numbers a task, and Spark adds up their digits: the covariance is
    exact until it's divided. Its eigenvectors are the components. The result is projected once more and written, and
    identity_error is the largest entry of its covariance less the identity, from the written rows.

    To the driver come as many numbers as dimensions have pairs, whatever the rows. deviation is a decimal, null from 10 ** 38 on.
    Vectors that are null, or hold null, NaN or an infinity, are dropped; so are those of another length than the commonest
    (the longest of equally common ones), as entries are missing, and empty ones. Components without variance (all rows alike, a single row)
    don't exist, so they give no rows; ``components`` is a bound. Null and repeated keys each keep their row; other columns are
    ignored; an empty table gives an empty result. Entries beyond 2 ** 62 after scaling count as that.
    """
    spark = df.sparkSession
    bounded_batches(spark, ROWS)
    own, x = spare_names(df, "own", "x")
    fit = usable(df.select(F.col(key).alias(own), F.col(vector).alias(x)), x).where(F.size(x) > 0)
    shape = fit.groupBy(F.size(x).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dimensions = shape[0] if shape else 0
    fit = fit.where(F.size(x) == dimensions)
    n, sums, square = moments(fit.select(x), dimensions) if dimensions else (0, [], np.zeros((0, 0), object))
    # sums are of n times as much, so the covariance is the square over n ** 3; dividing whole numbers rounds once
    covariance = np.array([[v / n**3 for v in row] for row in square.tolist()], np.float64).reshape(dimensions, dimensions)
    values, vectors = np.linalg.eigh(covariance) if dimensions else (np.zeros(0), np.zeros((0, 0)))
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(covariance))
    kept = int((values[:components] > max(trace, 0.0) * dimensions * np.finfo(float).eps).sum())
    project = vectors[:, :kept] / np.sqrt(values[:kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = centred(_matrix(batch.column(1), dimensions), n, sums)
            flat = (z / n).astype(np.float64) @ project
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * kept), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(str, deviations(z))), pa.string()), lists], ["own", "deviation", "whitened"])

    kind = df.schema[key].dataType.simpleString()
    done = materialise(fit.select(own, x).mapInArrow(run, f"own {kind}, deviation string, whitened array<double>"), "whitened")
    at = [F.col("whitened")[i] for i in range(kept)]
    error = None
    if kept:
        pairs = list(combinations_with_replacement(range(kept), 2))
        row = done.agg(*[F.covar_pop(at[i], at[j]).alias(f"v{i}_{j}") for i, j in pairs]).first()
        error = max(abs(v - (i == j)) for v, (i, j) in zip(row, pairs, strict=True))
    each = done.select(F.col("own").alias(key), F.expr("try_cast(deviation as decimal(38,0))").alias("deviation"), F.posexplode("whitened").alias("place", "whitened"))
    shares = F.array(*[F.lit(float(v / trace)) for v in values[:kept]]) if kept else F.array().cast("array<double>")
    return each.select(key, (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("place")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
