"""Embedding whitening by incremental eigendecomposition.

 1. Each task keeps the eigendecomposition of its vectors' scatter matrix (with their count and mean) and applies every vector
    as a centred rank-one update: the new eigenvalues are the roots of the secular equation, the new eigenvectors follow
    from the updated weights of its poles; what has no weight, or shares its pole with another, is deflated.
 2. Spectra combine in a tree: one enters another as one rank-one update for each of its eigenpairs and one for the
    difference of the means. A spectrum is of fixed size (the square of the dimension).
 3. One pass projects the centred vectors on the combined basis and sums the products (Rayleigh-Ritz): the small matrix
    has the final eigenvalues, and turns the basis into eigenvectors to double precision.
 4. One pass whitens and sums the covariance of what it made, one more returns it.

Vectors are turned into integers, floor(scale * c) + shift; counts and sums are whole numbers of any length, so centring is
exact: n * x - S is a whole number, divided by n once.

Tasks hold one block of rows and one spectrum. Only sums of fixed size (dimension squared) reach the driver, whatever
the number of rows or tasks; no step ranks, collects or groups rows.

Defined results: vectors that are null, or hold null or non-finite components (also after scaling), are dropped; an empty vector
is one, and shorter vectors count as filled with zeros; repeated rows count, and are returned, as often as they stand there;
components whose variance is zero (to double precision) have no whitened form and are left out, so equal vectors, or one alone,
give no component; equal eigenvalues have any orthonormal eigenvectors of theirs; an eigenvector's largest entry is positive; an
empty table gives no rows; columns named like a result are replaced. `deviation` is null where it has over 38 digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegraph.llm.common import materialise, others, passing, quoted, table
from casegraph.llm.topk import finite, matrix

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
ROWS = 4096  # rows of a block
FAN = 8
EPS = float(np.finfo(float).eps)


def secular(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z_j**2 / (d_j - x) for ascending distinct poles d and weights z that aren't zero, and the differences d_j - root_i.

    Each root lies between its pole and the next (the last below d + sum z**2), is found as a distance from the nearer of them by
    rational interpolation with both poles, and is bracketed: steps out of the bracket are halved.
    """
    m, w = len(d), z * z
    total = w.sum()
    if m == 1:
        return d + w, np.array([[-w[0]]])
    upper = np.append(d[1:], d[-1] + total)
    gap = upper - d
    rows = np.arange(m)
    f = 1 + (w / (d - (d + gap / 2)[:, None])).sum(1)
    right = f < 0
    right[-1] = False
    origin = np.where(right, upper, d)
    shifted = d - origin[:, None]
    lo = np.where(right, -gap / 2, np.where(f < 0, gap / 2, 0.0))
    hi = np.where(right | (f < 0), np.where(right, 0.0, gap), gap / 2)
    x = (lo + hi) / 2
    below = rows <= rows[:, None]
    for _ in range(60):
        g = shifted - x[:, None]
        t = w / g
        f = 1 + t.sum(1)
        done = np.abs(f) <= 4 * EPS * m * (1 + np.abs(t).sum(1))
        if done.all():
            break
        lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
        s = t / g
        psi = np.where(below, s, 0.0).sum(1)
        phi = s.sum(1) - psi
        left = g[rows, rows]
        nxt = np.append(g[rows[:-1], rows[1:]], 1.0)
        with np.errstate(all="ignore"):
            c = f - left * psi - nxt * phi
            a = (left + nxt) * f - left * nxt * (psi + phi)
            b = left * nxt * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = left[-1] + left[-1] ** 2 * psi[-1] / (f[-1] - left[-1] * psi[-1])
            tried = x + step
        x = np.where(done | (hi - lo <= 2 * EPS * np.abs(x)), x, np.where((tried > lo) & (tried < hi), tried, (lo + hi) / 2))
    return origin + x, shifted - x[:, None]


def update(d: np.ndarray, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eigendecomposition of q diag(d) q' + v v' (d ascending, q orthogonal)."""
    z = v @ q
    norm = float(np.sqrt(z @ z))
    tol = 8 * EPS * max(float(np.abs(d).max(initial=0)), norm * norm)
    live = norm * np.abs(z) > tol
    at = np.flatnonzero(live)
    if len(at) > 1 and (np.diff(d[at]) <= tol).any():  # rotations put the weight of near-equal poles on the last of them
        q, kept, last = q.copy(), [], at[0]
        for k in at[1:]:
            if d[k] - d[last] <= tol:
                r = float(np.hypot(z[last], z[k]))
                c, s = z[k] / r, z[last] / r
                q[:, last], q[:, k] = c * q[:, last] - s * q[:, k], s * q[:, last] + c * q[:, k]
                z[last], z[k] = 0.0, r
            else:
                kept.append(last)
            last = k
        at = np.array([*kept, last])
    if not len(at):
        return d, q
    poles, weight = d[at], z[at]
    roots, diff = secular(poles, weight)
    # Weights of which these roots are exact (ratios in pairs): they make the eigenvectors orthogonal.
    apart = poles[:, None] - poles
    np.fill_diagonal(apart, 1.0)
    ratio = -diff / apart
    exact = np.sqrt(np.maximum(np.abs(ratio).prod(0), 0)) * np.sign(weight)
    u = exact[:, None] / diff.T
    u /= np.sqrt((u * u).sum(0))
    d, out = d.copy(), q.copy()
    d[at], out[:, at] = roots, q[:, at] @ u
    order = np.argsort(d, kind="stable")
    return d[order], out[:, order]


class Spectrum:
    """Count, whole sums, mean and eigendecomposition of the scatter matrix of some vectors."""

    def __init__(self, width: int, n: int = 0, sums: list[int] | None = None, mean: np.ndarray | None = None, values: np.ndarray | None = None, basis: np.ndarray | None = None):
        self.n, self.sums = n, sums or [0] * width
        self.mean = np.zeros(width) if mean is None else mean
        self.values = np.zeros(width) if values is None else values
        self.basis = np.eye(width) if basis is None else basis

    def add(self, x: np.ndarray) -> None:
        """One vector: a rank-one update by its distance from the mean."""
        away = x - self.mean
        self.values, self.basis = update(self.values, self.basis, away * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean = self.mean + away / self.n

    def combine(self, other: Spectrum) -> None:
        """Another spectrum: an update for each of its eigenpairs, and one for the difference of the means."""
        n, away = self.n + other.n, other.mean - self.mean
        for e, v in zip(other.values, other.basis.T, strict=True):
            if e > 0:
                self.values, self.basis = update(self.values, self.basis, np.sqrt(e) * v)
        if self.n and other.n:
            self.values, self.basis = update(self.values, self.basis, away * np.sqrt(self.n / n * other.n))
        self.mean = self.mean + away * (other.n / n) if n else self.mean
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        self.n = n

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "sums": [str(s) for s in self.sums], "mean": self.mean.tolist(), "spectrum": self.values.tolist(), "basis": self.basis.tobytes()}

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        width = len(row["mean"])
        return cls(width, row["n"], [int(s) for s in row["sums"]], np.array(row["mean"]), np.array(row["spectrum"]), np.frombuffer(row["basis"]).reshape(width, width).copy())


STATE = "part long, n long, sums array<string>, mean array<double>, spectrum array<double>, basis binary"


def whole(x: np.ndarray, shift: int) -> np.ndarray:
    """Whole doubles plus shift: as 64-bit integers if they fit them, else as whole numbers of any length."""
    if np.abs(x).max(initial=0) < 1 << 62:
        return x.astype(np.int64) + shift
    return np.array([[int(c) + shift for c in v] for v in x], object).reshape(x.shape)


def _blocks(column: pa.Array, scale: int, width: int) -> Iterator[np.ndarray]:
    for a in range(0, len(column), ROWS):
        yield matrix(column.slice(a, ROWS), scale, width)


def decompose(rows: DataFrame, width: int, scale: int = SCALE, shift: int = SHIFT, vector_col: str = "embedding") -> Spectrum:
    """The spectrum of all vectors (each finite, of `width` components at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, part = Spectrum(width), TaskContext.get().partitionId()
        for batch in batches:
            for x in _blocks(batch.column(0), scale, width):
                got = whole(x, shift)
                exact = got.sum(0) if got.dtype == object or np.abs(got).max(initial=0) < (1 << 62) // ROWS else got.astype(object).sum(0)
                s.sums = [a + int(b) for a, b in zip(s.sums, exact, strict=True)]
                for v in x:  # the shift moves the mean only
                    s.add(v)
        if s.n:
            yield pa.RecordBatch.from_pylist([s.row(part)], STATE_ARROW)

    def merged(key: tuple, group: pa.Table) -> pa.Table:
        parts = sorted(group.to_pylist(), key=lambda r: r["part"])
        s = Spectrum.of(parts[0])
        for r in parts[1:]:
            s.combine(Spectrum.of(r))
        return pa.Table.from_pylist([s.row(key[0].as_py())], STATE_ARROW)

    spectra = materialise(rows.select(vector_col).mapInArrow(run, STATE))
    last = spectra.agg(F.max("part")).first()[0]
    n = 0 if last is None else last + 1
    while n > 1:
        n = -(-n // FAN)
        spectra = spectra.groupBy(F.floor(F.col("part") / FAN).alias("at")).applyInArrow(merged, STATE)
    got = spectra.first()  # one row of fixed size
    return Spectrum.of(got.asDict()) if got else Spectrum(width)


STATE_ARROW = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("mean", pa.list_(pa.float64())), ("spectrum", pa.list_(pa.float64())), ("basis", pa.binary())])


def centred(x: np.ndarray, n: int, sums: np.ndarray, shift: int) -> np.ndarray:
    """n * x - S exactly: 64-bit integers where they fit, else whole numbers of any length."""
    got = whole(x, shift)
    most = int(np.abs(got).max(initial=0)) * n + int(max((abs(s) for s in sums), default=0))
    return got * n - sums.astype(np.int64) if got.dtype != object and most < 1 << 62 else got.astype(object) * n - sums


def _summed(rows: DataFrame, vector_col: str, scale: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over all rows of what `of` makes of a block of scaled vectors: a flat array of fixed size, added up in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in _blocks(batch.column(0), scale, width):
                got = of(x)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "v"])

    found = rows.select(vector_col).mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    return np.array([r["v"] for r in sorted(found)])


def ritz(rows: DataFrame, s: Spectrum, scale: int, shift: int, vector_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of the covariance, from its projection on the basis of s."""
    width, n = len(s.mean), s.n
    sums, basis = np.array(s.sums, object), np.linalg.qr(s.basis)[0]

    def products(x: np.ndarray) -> np.ndarray:
        y = (centred(x, n, sums, shift) / n).astype(float) @ basis
        return (y.T @ y).ravel()

    small = _summed(rows, vector_col, scale, width, products).reshape(width, width) / n
    values, turn = np.linalg.eigh((small + small.T) / 2)
    vectors = basis @ turn[:, ::-1]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), np.arange(width)])
    return np.maximum(values[::-1], 0.0), vectors


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT, vector_col: str = "embedding") -> DataFrame:
    """The columns of the rows whose vector takes part, plus n, deviation (decimal), whitened and explained (arrays, an entry for each
    component) and identity_error."""
    made = ("n", "deviation", "whitened", "explained", "identity_error")
    rows = vectors.where(finite(F.col(f"`{vector_col}`"), scale))
    kept = [c for c in others(vectors, *made) if c != vector_col]
    numbers = T.ArrayType(T.DoubleType())
    kinds = (T.LongType(), T.DecimalType(38, 0), numbers, numbers, T.DoubleType())
    schema = T.StructType([vectors.schema[c] for c in kept] + [T.StructField(c, t) for c, t in zip(made, kinds, strict=True)])
    width = rows.agg(F.max(F.size(vector_col))).first()[0] or 0
    with passing():
        s = decompose(rows, width, scale, shift, vector_col) if width else Spectrum(0)
    n, sums = s.n, np.array(s.sums, object)
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    values, basis = ritz(rows, s, scale, shift, vector_col)
    trace = float(values.sum())
    k = int((values[:components] > width * EPS * trace).sum())
    project, explained = basis[:, :k] / np.sqrt(values[:k]), values[:k] / trace if trace else values[:0]

    def whitened(z: np.ndarray) -> np.ndarray:
        return (z / n).astype(float) @ project

    def covariance(x: np.ndarray) -> np.ndarray:
        y = whitened(centred(x, n, sums, shift))
        return np.concatenate([y.sum(0), (y.T @ y).ravel()])

    got = _summed(rows, vector_col, scale, width, covariance) / n if k else np.zeros(0)
    mean, second = got[:k], got[k:].reshape(k, k)
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0

    def deviations(z: np.ndarray) -> pa.Array:
        if z.dtype != object and int(np.abs(z).max(initial=0)) ** 2 * width < 1 << 63:
            return pa.array((z * z).sum(1)).cast(pa.decimal128(38, 0))
        exact = [sum(int(e) ** 2 for e in v) for v in z]
        return pa.array([Decimal(e) if e < 10**38 else None for e in exact], pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                part = batch.slice(a, ROWS)
                z = centred(matrix(part.column(vector_col), scale, width), n, sums, shift)
                m = len(part)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * k, pa.int32()), pa.array(v)) for v in (whitened(z).ravel(), np.tile(explained, m))]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(np.full(m, n)), deviations(z), *lists, pa.array(np.full(m, error))], names=schema.names)

    return rows.select(*quoted(kept), F.col(vector_col)).mapInArrow(run, schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "entry")
    out = out.select("vec_id", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "identity_error", each)
    return out.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", F.col("entry.whitened").alias("whitened"), F.col("entry.explained").alias("explained"), "identity_error")
