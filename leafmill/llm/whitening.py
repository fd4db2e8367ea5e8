"""Whitening of embeddings: distributed centred covariance, leading eigenpairs on the driver, broadcast projection.

Entries are fixed to whole numbers, ``x = floor(SCALE * c) + SHIFT``, so that counts and sums are exact. A first
scan adds up ``n`` and the sums ``S``; a second one adds up products of rows that are centred at ``S / n`` first
(whole part and fraction apart, so that the shift loses no digits). What meets is one row of ``d`` numbers per
task and dimension, added up by position; the driver sees ``d * d`` numbers, whatever the number of vectors.

The covariance is reduced to tridiagonal form by Householder reflections. Sturm counts (how many eigenvalues
lie below a number) bisect to the leading eigenvalues. Inverse iteration finds their vectors; neighbours closer
than ``CLUSTER`` times the norm are kept orthogonal to each other while they converge. The components go to the
tasks with the projection (``d`` times ``components`` numbers).
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from leafmill.llm.common import read_table, staged

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: The driver holds squares of this side.
MOST_DIMENSIONS = 4_096
#: Entries from here on have no whole number in 64 bits.
MOST_ENTRY = float(2**56)
#: Eigenvalues below this share of the first are rounding, not components.
RANK = 1e-12
CLUSTER = 1e-3
EPS = float(np.finfo(float).eps)


def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal, off-diagonal and reflections (first row, unit vector) of the tridiagonal form of a symmetric matrix."""
    a = np.array(a, dtype=float)
    d = len(a)
    reflections = []
    for k in range(d - 2):
        column = a[k + 1 :, k]
        size = np.linalg.norm(column)
        if size == 0 or not np.any(column[1:]):
            continue
        v = column.copy()
        v[0] += size if v[0] >= 0 else -size
        v /= np.linalg.norm(v)
        part = a[k + 1 :, k + 1 :]
        w = part @ v
        w -= (v @ w) * v
        part -= 2.0 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k] = a[k, k + 1] = -size if column[0] >= 0 else size
        a[k + 2 :, k] = a[k, k + 2 :] = 0.0
        reflections.append((k + 1, v))
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def sturm_counts(diagonal: np.ndarray, squares: np.ndarray, at: np.ndarray, least: float) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each number of ``at``."""
    q = diagonal[0] - at
    below = (q < 0).astype(int)
    for i in range(1, len(diagonal)):
        q = np.where(np.abs(q) < least, np.where(q < 0, -least, least), q)
        q = diagonal[i] - at - squares[i - 1] / q
        below += q < 0
    return below


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling: each interval is halved until no number is left between its ends."""
    d = len(diagonal)
    reach = np.zeros(d)
    reach[:-1] += np.abs(off)
    reach[1:] += np.abs(off)
    norm = max(float((np.abs(diagonal) + reach).max()), np.finfo(float).tiny)
    squares, least = off * off, max(norm * EPS * EPS, np.finfo(float).tiny)
    low, high = np.full(k, -norm * (1 + 4 * EPS)), np.full(k, norm * (1 + 4 * EPS))
    wanted = d - np.arange(1, k + 1)  # eigenvalues below the one looked for
    while True:
        middle = (low + high) / 2
        if not ((low < middle) & (middle < high) & (high - low > 2 * EPS * norm * EPS)).any():
            return high
        above = sturm_counts(diagonal, squares, middle, least) <= wanted
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def solved_tridiagonal(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """``(T - shift) x = b`` by elimination with row exchanges; pivots smaller than ``least`` are lifted to it."""
    d = len(diagonal)
    pivot, up, far = diagonal - shift, np.append(off, 0.0), np.zeros(d)
    under, x = np.append(off, 0.0), b.copy()
    for i in range(d - 1):
        if abs(under[i]) > abs(pivot[i]):
            # Exchange rows i and i + 1.
            factor = pivot[i] / under[i]
            pivot[i], old = under[i], up[i]
            up[i], far[i] = pivot[i + 1], up[i + 1]
            pivot[i + 1], up[i + 1] = old - factor * up[i], -factor * far[i]
            x[i], x[i + 1] = x[i + 1], x[i] - factor * x[i + 1]
        else:
            if abs(pivot[i]) < least:
                pivot[i] = least
            factor = under[i] / pivot[i]
            pivot[i + 1] -= factor * up[i]
            x[i + 1] -= factor * x[i]
    if abs(pivot[-1]) < least:
        pivot[-1] = least
    for i in range(d - 1, -1, -1):
        right = x[i]
        if i + 1 < d:
            right -= up[i] * x[i + 1]
        if i + 2 < d:
            right -= far[i] * x[i + 2]
        x[i] = right / pivot[i]
    return x


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Unit eigenvectors, one a column, for falling eigenvalues."""
    d = len(diagonal)
    norm = max(np.abs(values).max(), np.abs(diagonal).max(), np.finfo(float).tiny)
    found = np.zeros((d, len(values)))
    rng, first = np.random.Generator(np.random.PCG64(11)), 0
    shift = np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        # Equal shifts would give equal vectors.
        shift = min(float(value), shift - 10 * EPS * norm) if k > first else float(value)
        x = rng.standard_normal(d)
        for _ in range(rounds):
            x = solved_tridiagonal(diagonal, off, shift, x / np.linalg.norm(x), EPS * norm)
            for _ in range(2):
                for j in range(first, k):
                    x -= (found[:, j] @ x) * found[:, j]
            x /= np.linalg.norm(x)
        found[:, k] = x
    return found


def leading_eigenpairs(covariance: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors, one a column; those that are only rounding are left out."""
    d = len(covariance)
    if not d or not k or not np.any(covariance):
        return np.zeros(0), np.zeros((d, 0))
    diagonal, off, reflections = householder(covariance)
    values = leading_eigenvalues(diagonal, off, min(k, d))
    values = values[values > RANK * values[0]]
    vectors = tridiagonal_vectors(diagonal, off, values)
    for start, v in reversed(reflections):
        part = vectors[start:]
        part -= 2.0 * np.outer(v, v @ part)
    return values, vectors / np.linalg.norm(vectors, axis=0)


def usable(vector: Column) -> Column:
    """Whether a vector has only entries that are there, finite and have a whole number in 64 bits."""
    good = F.forall(vector, lambda c: F.coalesce(F.abs(F.nanvl(c, F.lit(float("inf")))) < F.lit(MOST_ENTRY), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(good, F.lit(False))


def whole(column: pa.Array, d: int) -> np.ndarray:
    """The whole numbers of a batch of vectors of ``d`` entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(values * SCALE).astype(np.int64) + SHIFT


def exact_sums(x: np.ndarray) -> list[int]:
    if not len(x):
        return [0] * x.shape[1]
    if float(np.abs(x).max()) * len(x) < 2.0**62:
        return [int(s) for s in x.sum(axis=0)]
    return [int(s) for s in x.astype(object).sum(axis=0)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - S / n`` as doubles: the whole part is taken off exactly."""
    middle = np.array([s // n for s in sums], dtype=np.int64)
    fraction = np.array([(s % n) / n for s in sums])
    return (x - middle) - fraction


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of ``(n * x - S) ** 2``, exact; None beyond 64 bits."""
    size = float(np.abs(x - np.array([s // n for s in sums], dtype=np.int64)).max(initial=0.0)) + 1.0
    if (size * n) ** 2 * x.shape[1] < 2.0**62:
        # n * x - S, without a product that is larger than the difference.
        apart = n * (x - np.array([s // n for s in sums], dtype=np.int64)) - np.array([s % n for s in sums], dtype=np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = n * x.astype(object) - np.array(sums, dtype=object)
    return [int(v) if v < 2**63 else None for v in (apart * apart).sum(axis=1)]


@dataclass
class Whitening:
    """What was fitted: number of vectors, exact sums, trace of the covariance, eigenvalues and components (columns)."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    components: np.ndarray

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]


def _parts(frame: DataFrame, per_task, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from per_task(batches)

    return frame.mapInArrow(run, schema)


def scatter(rows: DataFrame, d: int, values_of) -> np.ndarray:
    """Sum of products of the rows that ``values_of`` makes of a batch: one row a task and dimension, added by position."""

    def products(batches):
        total = np.zeros((d, d))
        for batch in batches:
            y = values_of(batch)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array([total[i, i:] for i in range(d)], pa.list_(pa.float64()))], names=["i", "products"]
        )

    parts = _parts(rows, products, "i int, products array<double>")
    summed = parts.select("i", F.posexplode("products").alias("apart", "v")).groupBy("i", "apart").agg(F.sum("v").alias("v"))
    out = np.zeros((d, d))
    for i, apart, v in summed.collect():
        out[i, i + apart] = out[i + apart, i] = v
    return out


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Fits on all rows; ``rows`` has the column v, vectors of usable entries and one length, as doubles."""
    first = rows.select("v").first()
    if first is None:
        return Whitening(0, [], 0.0, np.zeros(0), np.zeros((0, 0)))
    d = len(first[0])
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} entries; at most {MOST_DIMENSIONS}")

    def added(batches):
        n, sums = 0, [0] * d
        for batch in batches:
            x = whole(batch.column("v"), d)
            n += len(x)
            sums = [a + b for a, b in zip(sums, exact_sums(x))]
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], names=["n", "sums"])

    parts = _parts(rows.select("v"), added, "n long, sums array<string>")
    exact = parts.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    totals = sorted((at, int(s), n) for at, s, n in exact.collect())
    n, sums = totals[0][2], [s for _, s, _ in totals]
    covariance = scatter(rows.select("v"), d, lambda batch: centred(whole(batch.column("v"), d), n, sums)) / n
    values, vectors = leading_eigenpairs(covariance, components)
    return Whitening(n, sums, float(np.trace(covariance)), values, vectors)


def usable_rows(df: DataFrame, vector_col: str) -> DataFrame:
    """The struct ``own`` with all columns of ``df``, and ``v``: its usable vectors, of the greatest length among them."""
    rows = df.select(F.struct("*").alias("own"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(usable(F.col("v")))
    d = rows.agg(F.max(F.size("v"))).first()[0]
    return rows.where(F.size("v") == F.lit(d or 0))


def whitened(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening, float]:
    """All columns of the rows with a usable vector in a struct ``own``, their ``deviation`` and ``whitened`` array; the fit; its error.

    Left out are rows whose vector is null, empty, shorter than the longest usable one (the entries that it
    lacks count as null), or holds a null, a NaN, an infinity or an entry of 2**56 and more. Repeated rows count as
    often as they are there. Components whose eigenvalue is below 1e-12 of the first one do not exist in double
    precision: constant vectors, or a single one, have an empty array, and an empty table gives an empty result.
    ``deviation`` is null where it does not fit 64 bits. The error is the largest entry of the covariance of
    ``whitened``, over the rows returned, less the identity; 0 without components. A list of more than
    ``MOST_DIMENSIONS`` entries is an error. The names of other columns do not matter.
    """
    rows = usable_rows(df, vector_col)
    model = fitted(rows, components)
    d, k = len(model.sums), len(model.values)
    projection = model.components / np.sqrt(model.values) if k else model.components
    n, sums = model.n, model.sums

    def projected(batches):
        for batch in batches:
            x = whole(batch.column("v"), d)
            w = centred(x, n, sums) @ projection
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * k, pa.int32())
            made = pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(deviations(x, n, sums), pa.int64()), made], names=["own", "deviation", "whitened"])

    schema = f"own {rows.schema['own'].dataType.simpleString()}, deviation long, whitened array<double>"
    if not n:
        return df.sparkSession.createDataFrame([], schema), model, 0.0
    out = staged(_parts(rows, projected, schema), "whitened")
    if not k:
        return out, model, 0.0
    sums_of = out.select(F.posexplode("whitened").alias("at", "w")).groupBy("at").agg(F.avg("w").alias("mean"))
    means = np.array([mean for _, mean in sorted(tuple(r) for r in sums_of.collect())])
    error = scatter(out.select(F.col("whitened").alias("v")), k, lambda batch: _doubles(batch.column("v"), k) - means) / n - np.eye(k)
    return out, model, float(np.abs(error).max())


def _doubles(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def op11_sturm_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model, error = whitened(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    explained = F.array(*[F.lit(share) for share in model.explained]).cast("array<double>")
    return rows.select(F.col("own.vec_id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
