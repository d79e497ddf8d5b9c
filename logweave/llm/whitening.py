"""Whitening of embeddings by spectral divide and conquer (operator 13).

Entries c become integers x = floor(scale * c) + offset.  The covariance of all fitted
rows is split into its components without an eigenvalue routine:

* The polar factor of the covariance less a shift has the eigenvalues 1 and -1, by QDWH:
  dynamically weighted Halley steps, each from one QR decomposition.  Half of its sum with
  the identity is the projector to the components above the shift.
* An orthonormal basis of the projector's range and of its complement parts the matrix in
  two smaller ones, each split again until one component is left.  Only subspaces that hold
  one of the wanted leading components are split further.
* The components (dimensions x ``count`` numbers, whatever the number of rows) are
  broadcast, and rows are projected where they lie.

Sums, cross products and the check of the result are each one pass over the rows: a task
adds up its batches, and the tasks' totals are added in two rounds of streams, so that
neither the driver nor a task holds more than a total.

Defined cases: rows whose vector is null or holds a null, an infinity or NaN are left
out, and so are rows whose vector has not the most frequent length (of equally frequent
ones the greatest).  Scaled entries beyond 2^45 count as 2^45.  Components of no variance
are left out (all, if the rows are equal or there is one row only), hence there may be
fewer than wanted.  Rows of equal or null id are rows of their own.  ``deviation`` is null
where it exceeds 64 bits.  Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.llm.common import id_type, ship_package

LIMIT = float(1 << 45)
EPS = float(np.finfo(float).eps)


# ---------------------------------------------------------------- decomposition

def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley steps."""
    m = len(a)
    x = a / np.linalg.norm(a)  # no singular value above 1
    least = EPS  # a lower bound of the singular values that matter
    for _ in range(40):
        if least < 1 - 10 * EPS:
            d = (4 * (1 - least * least) / least ** 4) ** (1 / 3)
            w = math.sqrt(1 + d) + math.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - least * least) / (least * least * math.sqrt(1 + d)))) / 2
        else:
            w = 3.0
        b = (w - 1) ** 2 / 4
        c = w + b - 1
        q, _ = np.linalg.qr(np.vstack([math.sqrt(c) * x, np.eye(m)]))
        new = b / c * x + (w - b / c) / math.sqrt(c) * (q[:m] @ q[m:].T)
        least = min(1.0, least * (w + b * least * least) / (1 + c * least * least))
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        if least >= 1 - 10 * EPS and moved < 1e-9 * math.sqrt(m):  # the last step had a cubic effect
            break
    return x


def split(a: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of an upper and a lower invariant subspace; none, if all eigenvalues are as good as equal."""
    m = len(a)
    diagonal = np.sort(np.diag(a))
    spread = np.linalg.norm(a - np.eye(m) * diagonal.mean())
    if spread <= 4 * EPS * m * np.linalg.norm(a):
        return None
    best, error = None, math.inf
    for shift in [diagonal.mean(), (diagonal[(m - 1) // 2] + diagonal[m // 2]) / 2,
                  *(diagonal.mean() + spread / math.sqrt(m) * t for t in (0.13, -0.13, 0.31, -0.31))]:
        u = polar_factor(a - np.eye(m) * shift)
        rank = round((m + np.trace(u)) / 2)
        if not 0 < rank < m:
            continue
        p = (u + np.eye(m)) / 2
        basis = rng.standard_normal((m, rank))
        for _ in range(2):
            basis, _ = np.linalg.qr(p @ basis)
        full, _ = np.linalg.qr(np.hstack([basis, rng.standard_normal((m, m - rank))]))
        upper, lower = full[:, :rank], full[:, rank:]
        off = np.linalg.norm(lower.T @ a @ upper)
        if off < error:
            best, error = (upper, lower), off
        if off <= 8 * EPS * m * np.linalg.norm(a):
            break
    return best


def leading_components(a: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` greatest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    rng = np.random.default_rng(1)
    todo, values, vectors = [np.eye(len(a))] if len(a) else [], [], []
    while todo and len(values) < count:
        basis = todo.pop()
        part = basis.T @ a @ basis
        part = (part + part.T) / 2
        halves = split(part, rng) if len(part) > 1 else None
        if halves:
            todo += [basis @ halves[1], basis @ halves[0]]  # the upper one is next
        else:
            values += np.diag(part).tolist()
            vectors.append(basis)
    if not values:
        return np.zeros(0), np.zeros((len(a), 0))
    values, vectors = np.array(values), np.hstack(vectors)
    order = np.argsort(-values, kind="stable")[:count]
    return values[order], vectors[:, order]


# ---------------------------------------------------------------- passes over the rows

def totals(df: DataFrame, per_batch: Callable[[pa.RecordBatch], np.ndarray], add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """``add`` over the arrays of all batches: within tasks, then in two rounds of streams; none of no rows."""
    spark = df.sparkSession
    ship_package(spark)

    def fold(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in arrays:
            total = x if total is None else add(total, x)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([total.dtype.str])], ["total", "kind"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fold(per_batch(b) for b in batches if b.num_rows)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fold(np.frombuffer(t, k) for b in batches for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))

    shape = "total binary, kind string"
    out = df.mapInArrow(within, shape)
    some = max(1, math.isqrt(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    row = out.repartition(some).mapInArrow(across, shape).repartition(1).mapInArrow(across, shape).first()
    return None if row is None else np.frombuffer(bytes(row.total), row.kind)


def matrix(column: pa.Array, scale: int, offset: int) -> np.ndarray:
    """The integer rows of a batch of valid vectors."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(flat * scale), -LIMIT, LIMIT)
    return x.astype(np.int64).reshape(len(column), -1) + offset


def merged_moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Two totals (rows, means, cross products about the means) of parts as that of both."""
    k = (math.isqrt(1 + 4 * (len(x) - 1)) - 1) // 2
    n, m = x[0], y[0]
    gap = y[1:k + 1] - x[1:k + 1]
    cross = x[k + 1:] + y[k + 1:] + (n * m / (n + m) * np.outer(gap, gap)).ravel()
    return np.concatenate([[n + m], x[1:k + 1] + gap * (m / (n + m)), cross])


def moments(values: np.ndarray) -> np.ndarray:
    mean = values.mean(axis=0)
    centred = values - mean
    return np.concatenate([[len(values)], mean, (centred.T @ centred).ravel()])


def whitened(df: DataFrame, count: int = 32, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id",
             vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every fitted row and leading component.

    ``deviation`` is the sum over dimensions of (n * x - S)^2, S the dimension's sum;
    ``identity_error`` the greatest absolute entry of the covariance of ``whitened`` less
    the identity, taken in a pass of its own.
    """
    spark = df.sparkSession
    ship_package(spark)
    entries = F.col("v")
    src = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    src = src.where(entries.isNotNull() & ~F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    schema = T.StructType([T.StructField("id", id_type(src, "id")), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
                           T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    common = src.groupBy(F.size("v").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first().m
    dims = common.d if common else 0
    src = src.where(F.size("v") == dims)

    def sums(b: pa.RecordBatch) -> np.ndarray:
        x = matrix(b.column(0), scale, offset)
        return np.concatenate([[len(x)], x.sum(axis=0)])

    total = totals(src.select("v"), sums, np.add) if dims else None
    values, w = np.zeros(0), np.zeros((dims, 0))
    if total is not None:
        n, s = int(total[0]), total[1:]

        def deviations(b: pa.RecordBatch) -> np.ndarray:  # exact integers until they are divided
            return (n * matrix(b.column(b.num_columns - 1), scale, offset) - s) / n

        def products(b: pa.RecordBatch) -> np.ndarray:
            y = deviations(b)
            return (y.T @ y).ravel()

        covariance = totals(src.select("v"), products, np.add).reshape(dims, dims) / n
        trace = float(np.trace(covariance))
        values, w = leading_components((covariance + covariance.T) / 2, min(count, dims))
        real = values > dims * EPS * max(values.max(initial=0), 0)
        values, w = values[real], w[:, real]
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    white = spark.sparkContext.broadcast(w / np.sqrt(values))
    checked = totals(src.select("v"), lambda b: moments(deviations(b) @ white.value), merged_moments)
    error = float(np.abs(checked[1 + k:].reshape(k, k) / n - np.eye(k)).max())
    share = values / trace

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                m = part.num_rows
                numerators = n * matrix(part.column(1), scale, offset) - s
                top = float(np.abs(numerators).max(initial=0))
                if top * top * dims < 2 ** 62:
                    deviation = (numerators * numerators).sum(axis=1).tolist()
                else:
                    exact = [sum(v * v for v in r) for r in numerators.tolist()]
                    deviation = [v if v < 1 << 63 else None for v in exact]
                component = np.tile(np.arange(1, k + 1, dtype=np.int32), m)
                again = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(again), pa.array(component), pa.array(np.full(m * k, n)), pa.array(deviation, pa.int64()).take(again),
                     pa.array((numerators / n @ white.value).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))], schema.names)

    return src.select("id", "v").mapInArrow(rows, schema).withColumnRenamed("id", id_col)
