"""Whitening of embeddings from exact integer covariances, summed by population counts over bit planes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.common import bound_batches, stored

COMPONENTS = 16
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond are treated as not finite: their squares would leave the range of longs.
LARGEST = 2.0 ** 40
#: Vectors packed into bit planes at once inside a task.
STEP_ROWS = 16_384


def fixed_point(vector: Column) -> Column:
    """The vector's entries as longs; null if the vector or an entry is null or not finite."""
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST))
    return F.when(F.size(wide).isNotNull() & ~bad, F.transform(wide, lambda c: F.floor(c * SCALE).cast("long") + SHIFT))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column without nulls as a matrix of one row a list."""
    return np.asarray(column.flatten(), np.int64).reshape(len(column), dims)


def bit_sliced_products(rows: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """(minima, products) of non-negative offsets from each dimension's minimum, as exact integers.

    Every dimension is cut into bit planes, whose bits of 64 rows fill a word. The product of two dimensions is the sum
    over pairs of planes of 2^(a + b) times the number of rows with both bits set, an AND and a population count.
    """
    n, dims = rows.shape
    low = rows.min(0)
    offsets = (rows - low).astype(np.uint64)
    depth = max(1, int(offsets.max()).bit_length())
    words = -(-n // 64)
    bits = np.zeros((depth, dims, words * 64), np.uint8)
    for b in range(depth):
        bits[b, :, :n] = (offsets.T >> np.uint64(b)) & np.uint64(1)
    planes = np.packbits(bits, axis=-1).view(np.uint64)
    products = [[0] * dims for _ in range(dims)]
    for i in range(dims):
        for a in range(depth):
            # (depth, dims - i): rows in which bit a of dimension i and bit b of dimension j stand together
            both = np.bitwise_count(planes[:, i:] & planes[a, i]).sum(-1, dtype=np.int64)
            weight = [int(sum(int(c) << b for b, c in enumerate(column))) << a for column in both.T]
            for j, value in enumerate(weight, i):
                products[i][j] += value
    return [int(x) for x in low], products


def _scatter(dims: int):
    """Per task one row (i, j, total) for each pair of dimensions, i up to j, and sums as (i, -1) and (-1, -1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        total = [[0] * dims for _ in range(dims)]
        for batch in batches:
            for first in range(0, len(batch), STEP_ROWS):
                rows = _matrix(batch.column(0)[first:first + STEP_ROWS], dims)
                low, products = bit_sliced_products(rows)
                own = [int(x) for x in rows.sum(0)]
                n += len(rows)
                for i in range(dims):
                    sums[i] += own[i]
                    for j in range(i, dims):  # back from offsets to the entries themselves
                        total[i][j] += products[i][j] + low[j] * own[i] + low[i] * own[j] - len(rows) * low[i] * low[j]
        if n:
            cells = [(-1, -1, n), *((i, -1, s) for i, s in enumerate(sums)), *((i, j, total[i][j]) for i in range(dims) for j in range(i, dims))]
            i, j, value = zip(*cells, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in value])], names=["i", "j", "value"])

    return run


def exact_moments(vectors: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, scatter) of ``vectors`` (x): scatter is n times the products less the sums' products, in whole numbers.

    Only ``dims`` squared numbers reach the driver.
    """
    cells = vectors.select("x").mapInArrow(_scatter(dims), "i int, j int, value string")
    found = {(r.i, r.j): int(r.value) for r in cells.groupBy("i", "j").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()}
    n, sums = found[(-1, -1)], [found[(i, -1)] for i in range(dims)]
    scatter = np.array([[n * found[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)], object)
    return n, sums, scatter


def principal(n: int, scatter: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(directions, eigenvalues, trace) of the covariance scatter / n^2; directions are columns by falling eigenvalue."""
    covariance = np.array([[value / (n * n) for value in row] for row in scatter], float)  # quotients of whole numbers, rounded once
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    return vectors[:, order], values[order], float(np.trace(covariance))


def _projected(n: int, sums: list[int], directions: np.ndarray, values: np.ndarray):
    scale = np.where(values > 0, 1 / np.sqrt(np.where(values > 0, values, 1)), 0.0)
    total = np.array(sums, object)
    small = max(map(abs, sums), default=0) < 2 ** 62

    def centred(rows: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        if small and n * int(np.abs(rows).max(initial=0)) < 2 ** 62:
            return rows * n - total.astype(np.int64)
        return rows.astype(object) * n - total

    def whitened(offsets: np.ndarray) -> np.ndarray:
        return (offsets.astype(float) / n) @ directions * scale

    return centred, whitened


def _gram(n: int, sums: list[int], directions: np.ndarray, values: np.ndarray):
    """Per task the sums and products of whitened vectors, as rows (i, j, value)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centred, whitened = _projected(n, sums, directions, values)
        k = len(values)
        total = np.zeros((k + 1, k))
        for batch in batches:
            for first in range(0, len(batch), STEP_ROWS):
                z = whitened(centred(_matrix(batch.column(0)[first:first + STEP_ROWS], len(sums))))
                total[:k] += z.T @ z
                total[k] += z.sum(0)
        i, j = np.divmod(np.arange((k + 1) * k), k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "value"])

    return run


def identity_error(vectors: DataFrame, n: int, sums: list[int], directions: np.ndarray, values: np.ndarray) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, measured on all of them."""
    k = len(values)
    cells = vectors.select("x").mapInArrow(_gram(n, sums, directions, values), "i int, j int, value double")
    found = np.zeros((k + 1, k))
    for i, j, value in cells.groupBy("i", "j").agg(F.sum("value")).collect():
        found[i, j] = value
    mean = found[k] / n
    return float(np.abs(found[:k] / n - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def _rows_out(n: int, sums: list[int], directions: np.ndarray, values: np.ndarray, explained: np.ndarray, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centred, whitened = _projected(n, sums, directions, values)
        k = len(values)
        for batch in batches:
            for first in range(0, len(batch), STEP_ROWS):
                part = batch.slice(first, STEP_ROWS)
                offsets = centred(_matrix(part.column(1), len(sums)))
                rough = (offsets.astype(float) ** 2).sum(1)
                if (rough > 9.2e18).any():
                    raise OverflowError("a deviation leaves the range of longs")
                deviation = (offsets * offsets).sum(1).astype(np.int64)
                row = np.repeat(np.arange(len(part)), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                     pa.array(np.full(len(row), n)), pa.array(deviation[row]), pa.array(whitened(offsets).ravel()),
                     pa.array(np.tile(explained, len(part))), pa.array(np.full(len(row), error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): up to ``components`` rows for each vector.

    Rows whose vector is null or empty or holds a null, NaN, infinite or huge (over 2^40) entry are left out, and so are those
    that have not the table's most frequent number of entries (the larger of equally frequent ones). The fit takes each distinct
    vector once, so copies weigh nothing; all other rows are projected, repeated ones and null ids too. A component without
    variance has ``whitened`` 0, which ``identity_error`` then shows as 1; without any variance ``explained`` is 0. A table
    without usable vectors gives no rows. Extra columns are ignored.
    """
    spark = embeddings.sparkSession
    bound_batches(spark)
    kind = embeddings.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fixed = embeddings.select(F.col(vec_id).alias("vec_id"), fixed_point(F.col(vector)).alias("x")).where(F.size("x") > 0)
    sizes = fixed.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if sizes is None:
        return spark.createDataFrame([], schema).withColumnRenamed("vec_id", vec_id)
    dims = sizes.dims
    fixed = fixed.where(F.size("x") == dims)
    vectors = stored(fixed.select("x").distinct(), "distinct-vectors")  # equal vectors meet inside tasks before the shuffle
    n, sums, scatter = exact_moments(vectors, dims)
    directions, values, trace = principal(n, scatter, components)
    error = identity_error(vectors, n, sums, directions, values)
    explained = values / trace if trace > 0 else np.zeros(len(values))
    return fixed.mapInArrow(_rows_out(n, sums, directions, values, explained, error), schema).withColumnRenamed("vec_id", vec_id)
