"""Operator 12, embedding whitening: principal components of the distributed covariance, each scaled to unit variance.

Components of the vectors become whole numbers, floor(64 c) + 1,000,000. One pass adds up rows and dimensions exactly; a
second one centres every vector and adds up the products, so a task hands on one matrix. That matrix, as wide as the
vectors and no larger with more rows, is reduced to tridiagonal form by Householder reflections on the driver;
bisection over Sturm counts finds the leading eigenvalues, inverse iteration their eigenvectors, those of close
eigenvalues being made orthogonal to each other, and the reflections carry them back. The components are broadcast, and
the vectors projected where they are read. Two more passes over the projections measure how far their covariance is from
the identity.

Centring subtracts the whole number next to the mean first, exactly, and then the remainder of under a half, so nothing is
lost to the offset.

Defined results: vectors that are null or hold null or non-finite entries take no part; a vector shorter than the longest
counts as followed by zeros; entries of 2^45 and more raise an error, as do deviations beyond 64 bits; eigenvalues under
1e-11 of the first count as zero, and their components, which have no variance to scale, are left out: so one vector, or
none, or only equal ones, give no rows; rows that share an id, a null one too, are vectors of their own; of eigenvectors,
the entry largest in size is positive; equal eigenvalues have components in any orthogonal position; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

SCALE, OFFSET = 64, 1_000_000
#: Eigenvalues below this share of the first are zero; those within this share of the matrix norm are close to each other.
NOTHING, CLOSE = 1e-11, 1e-3
#: Rows projected together.
TOGETHER = 1 << 12


def tridiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit Householder vectors (over the last entries) of a symmetric matrix."""
    a, n, mirrors = matrix.astype(np.float64).copy(), len(matrix), []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        v = v / size if size > 0 else v
        mirrors.append(v)
        below = a[k + 1 :, k + 1 :]
        p = below @ v
        w = p - (v @ p) * v
        below -= 2 * (np.outer(v, w) + np.outer(w, v))
        first = a[k + 1 :, k]
        first -= 2 * v * (v @ first)
        a[k, k + 1 :] = first
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def carry_back(vectors: np.ndarray, mirrors: list[np.ndarray]) -> np.ndarray:
    """Columns of the tridiagonal form's space in the matrix's own."""
    out = vectors.copy()
    for k in range(len(mirrors) - 1, -1, -1):
        out[k + 1 :] -= 2 * np.outer(mirrors[k], mirrors[k] @ out[k + 1 :])
    return out


def sturm_counts(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each point: the negative terms of the Sturm sequence."""
    tiny = np.finfo(float).tiny * max(1.0, float((off**2).max(initial=0.0)))
    q, counts = np.ones(len(at)), np.zeros(len(at), dtype=np.int64)
    for i, d in enumerate(diagonal):
        q = d - at - (off[i - 1] ** 2 / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        counts += q < 0
    return counts


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until its interval no longer halves."""
    n = len(diagonal)
    reach = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    spread = max(float((diagonal + reach).max() - (diagonal - reach).min()), np.finfo(float).tiny)
    low, high = np.full(k, (diagonal - reach).min() - 1e-12 * spread), np.full(k, (diagonal + reach).max() + 1e-12 * spread)
    below = n - 1 - np.arange(k)  # the j-th largest has at most so many below it
    for _ in range(200):
        middle = (low + high) / 2
        stuck = (middle <= low) | (middle >= high)
        if stuck.all():
            break
        over = sturm_counts(diagonal, off, middle) > below
        high, low = np.where(over & ~stuck, middle, high), np.where(~over & ~stuck, middle, low)
    return (low + high) / 2


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """x of (T - shift) x = right by elimination with row exchanges; a zero pivot becomes a very small one."""
    n, small = len(diagonal), np.finfo(float).eps * max(float(np.abs(diagonal).max()), float(np.abs(off).max(initial=0.0)), np.finfo(float).tiny)
    a, b, c = diagonal - shift, np.append(off, 0.0), np.zeros(n)
    x = right.copy()
    for i in range(n - 1):
        under = off[i]
        if abs(under) > abs(a[i]):
            m = a[i] / under
            a[i], b[i], c[i], after, next_b = under, a[i + 1], b[i + 1], b[i], b[i + 1]
            a[i + 1], b[i + 1] = after - m * b[i], -m * next_b
            x[i], x[i + 1] = x[i + 1], x[i] - m * x[i + 1]
        else:
            m = under / (a[i] if abs(a[i]) > small else small)
            a[i] = a[i] if abs(a[i]) > small else small
            a[i + 1] -= m * b[i]
            x[i + 1] -= m * x[i]
    a[-1] = a[-1] if abs(a[-1]) > small else small
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - (b[i] * x[i + 1] if i + 1 < n else 0.0) - (c[i] * x[i + 2] if i + 2 < n else 0.0)) / a[i]
        if abs(x[i]) > 1e150:
            x *= 1e-150
    return x / np.linalg.norm(x)


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors by inverse iteration; within a cluster of close eigenvalues each is made orthogonal to those before it."""
    n, out = len(diagonal), np.zeros((len(diagonal), len(values)))
    norm = max(float((np.abs(diagonal) + np.append(np.abs(off), 0) + np.append(0, np.abs(off))).max()), np.finfo(float).tiny)
    start, rng, first = None, np.random.default_rng(12), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLOSE * norm:
            first, start = j, None
        shift = value if start is None else min(value, start - 10 * np.finfo(float).eps * norm)  # equal values apart by a hair
        start = shift
        x = rng.standard_normal(n)
        for _ in range(5):
            for _ in range(2):
                x -= out[:, first:j] @ (out[:, first:j].T @ x)
            x = solve_shifted(diagonal, off, shift, x / np.linalg.norm(x))
        for _ in range(2):
            x -= out[:, first:j] @ (out[:, first:j].T @ x)
            x /= np.linalg.norm(x)
        out[:, j] = x
    return out


def principal_components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the `most` largest eigenvalues that are not zero."""
    n = len(covariance)
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    diagonal, off, mirrors = tridiagonalise((covariance + covariance.T) / 2)
    values = leading_eigenvalues(diagonal, off, min(most, n))
    values = values[values > max(NOTHING * values[0], np.finfo(float).tiny)]
    vectors = carry_back(tridiagonal_vectors(diagonal, off, values), mirrors)
    return values, vectors * np.sign(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], axis=0))


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    x = F.col(vector_col)
    return vectors.where(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    """floor(64 c) + 1,000,000 of a column of lists, followed by zeros up to `width`."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) and np.abs(flat).max() >= 1 << 45:
        raise ValueError("a component is too large for whole numbers of 64 bits")
    out = np.full((len(sizes), width), OFFSET, dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(SCALE * flat).astype(np.int64) + OFFSET
    return out


def added_up(rows: DataFrame, vector_col: str, part: Callable[[pa.Array], np.ndarray], length: int) -> np.ndarray:
    """The sum of `part`, a matrix of doubles of `length` lines, over all batches of vectors.

    Each task adds up its own; the lines of all tasks are then added up by Spark, and one matrix reaches the driver.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                more = part(batch.column(0).slice(at, TOGETHER))
                total = more if total is None else total + more
        if total is not None:
            yield pa.record_batch({"i": pa.array(np.arange(len(total), dtype=np.int32)), "v": pa.array(list(total), pa.list_(pa.float64()))})

    lines = rows.select(vector_col).mapInArrow(add, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "x"))
    sums = lines.groupBy("i", "j").agg(F.sum("x").alias("x")).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "x"))).alias("v")).select("i", F.col("v.x").alias("v")).collect()
    out = np.zeros((length, len(sums[0]["v"]) if sums else 0))
    for row in sums:
        out[row["i"]] = row["v"]
    return out


class Whitener:
    """The fitted model: counts, exact sums, eigenvalues and the scaled components."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, most: int):
        self.n, self.width = n, len(sums)
        self.centre = np.array([round(s / n) if n else 0 for s in sums], dtype=np.int64)
        self.left = np.array([s - n * int(c) for s, c in zip(sums, self.centre, strict=True)], dtype=np.int64)
        self.values, self.vectors = principal_components(covariance, most)
        self.explained = self.values / np.trace(covariance) if len(self.values) else self.values
        self.scaled = self.vectors / np.sqrt(self.values)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.centre, self.left, self.n) @ self.scaled

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sums of (n x - S)^2 over the dimensions, exact, or an error beyond 64 bits."""
        apart = x - self.centre
        rough = ((self.n * apart.astype(np.float64) - self.left) ** 2).sum(axis=1)
        if len(rough) and rough.max() > 9.2e18:
            raise OverflowError("a deviation needs more than 64 bits")
        return ((self.n * apart - self.left) ** 2).sum(axis=1)


def centred(x: np.ndarray, centre: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
    """x less its mean, which is centre + left / n."""
    return (x - centre).astype(np.float64) - left / n


def fit(vectors: DataFrame, most: int = 32, vector_col: str = "embedding") -> Whitener | None:
    """The components of all usable vectors; None where there are none."""
    rows = usable(vectors, vector_col)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size(vector_col)), F.lit(0))).first()
    if not n or not width:
        return None
    entries = rows.select(F.posexplode(vector_col).alias("j", "c")).groupBy("j").agg(F.sum(F.floor(F.col("c").cast("double") * SCALE).cast("long")).alias("s"))
    sums = [OFFSET * n] * width
    for row in entries.collect():
        sums[row["j"]] += row["s"]
    mean = Whitener(n, sums, np.zeros((0, 0)), 0)
    centre, left = mean.centre, mean.left

    def products(column: pa.Array) -> np.ndarray:
        c = centred(whole_numbers(column, width), centre, left, n)
        return c.T @ c

    return Whitener(n, sums, added_up(rows, vector_col, products, width) / n, most)


def identity_error(vectors: DataFrame, model: Whitener, vector_col: str = "embedding") -> float:
    """The largest entry, in size, of the whitened vectors' covariance less the identity, measured on all of them."""
    rows, shared, n = usable(vectors, vector_col), vectors.sparkSession.sparkContext.broadcast(model), model.n
    whiten = lambda column: shared.value.whitened(whole_numbers(column, shared.value.width))
    k = len(model.values)
    means = added_up(rows, vector_col, lambda column: whiten(column).sum(axis=0)[None], 1)[0] / n

    def products(column: pa.Array) -> np.ndarray:
        w = whiten(column) - means
        return w.T @ w

    return float(np.abs(added_up(rows, vector_col, products, k) / n - np.eye(k)).max())


def whiten(vectors: DataFrame, most: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: one row for each usable vector and component."""
    made = [StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()), *[StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error")]]
    schema = StructType([StructField(id_col, vectors.schema[id_col].dataType), *made])
    spark = vectors.sparkSession
    model = fit(vectors, most, vector_col)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    shared, error = spark.sparkContext.broadcast(model), identity_error(vectors, model, vector_col)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.values)
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                batch = whole.slice(at, TOGETHER)
                x, rows = whole_numbers(batch.column(1), model.width), batch.num_rows
                each = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n)), pa.array(np.repeat(model.deviations(x), k)),
                    pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, rows)), pa.array(np.full(rows * k, error)),
                ], names=schema.names)

    return usable(vectors, vector_col).select(id_col, vector_col).mapInArrow(project, schema)
