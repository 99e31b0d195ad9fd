"""Whitening of embeddings by spectrum slicing: leading components isolated by inertia counts, certified by them too.

The covariance of the distinct vectors is summed on Spark as whole numbers about the rounded mean, so
it is exact and centred. Its eigenvalues are found one by one on the driver, where only the d x d
matrix is: the LDL^T factors of V - sI have as many positive pivots as V has eigenvalues above s
(Sylvester), so bisection of s isolates the j-th one; Rayleigh quotient iteration from there converges
cubically, and counts just below and just above the value found certify that it is number j. Equal
eigenvalues, which no shift can part, share an interval; their vectors are kept orthogonal.

Vectors shorter than the longest count as padded with zeros. Defined cases: a vector that is null or
holds a null or non-finite entry, or one too large for its whole number, takes no part; rows without
an id and repeated rows are rows like any other, repeated vectors count once in the fit; components
of no variance do not exist, so fewer than ``wanted`` come out when the vectors span fewer dimensions;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import batches, stored
from tablewright.llm.vectors import padded

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
# Bound of the whole numbers, so that differences of two fit a long.
LARGEST = 2.0**60
# Share of the largest eigenvalue below which a component has no variance, and two count as equal.
NOTHING = 1e-12
EPSILON = float(np.finfo(float).eps)


def whole_vectors(df: DataFrame, vector: str = "embedding") -> tuple[Column, Column]:
    """Whether a row takes part, and its entries as whole numbers."""
    v = F.col(vector).cast("array<double>")
    fits = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / SCALE))
    return F.col(vector).isNotNull() & fits, F.transform(v, lambda c: F.floor(c * float(SCALE)) + F.lit(SHIFT).cast("bigint"))


# --- eigenvalues of a symmetric matrix by slicing its spectrum


def positive_pivots(matrix: np.ndarray) -> int:
    """Number of positive eigenvalues: those of the pivots of one or two rows in an LDL^T factorisation (Bunch and Kaufman)."""
    a = matrix.copy()
    n, k, positive = len(a), 0, 0
    alpha = (1 + 17**0.5) / 8
    while k < n:
        rest = a[k:, k:]
        below = np.abs(rest[1:, 0])
        r = 1 + int(below.argmax()) if len(below) else 0
        most, pivot = (below[r - 1] if len(below) else 0.0), 0
        if abs(rest[0, 0]) < alpha * most:
            others = np.abs(rest[:, r])
            others[r] = 0.0
            largest = others.max()
            if abs(rest[0, 0]) * largest < alpha * most**2:
                pivot = r
                if abs(rest[r, r]) < alpha * largest:  # two rows: one of their eigenvalues is above zero, one below
                    _swap(rest, 1, r)
                    positive += 1
                    columns = rest[2:, :2].copy()
                    rest[2:, 2:] -= columns @ np.linalg.solve(rest[:2, :2], columns.T)
                    k += 2
                    continue
        _swap(rest, 0, pivot)
        if rest[0, 0] != 0:
            positive += rest[0, 0] > 0
            column = rest[1:, 0].copy()
            rest[1:, 1:] -= np.outer(column, column / rest[0, 0])
        k += 1
    return int(positive)


def _swap(matrix: np.ndarray, i: int, j: int) -> None:
    if i != j:
        matrix[[i, j]] = matrix[[j, i]]
        matrix[:, [i, j]] = matrix[:, [j, i]]


class Slices:
    """Counts of eigenvalues above a shift, each factorisation done once."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.known = matrix, {}

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = positive_pivots(self.matrix - shift * np.eye(len(self.matrix)))
        return self.known[shift]

    def bracket(self, j: int) -> tuple[float, float]:
        """The closest shifts known with at least ``j`` eigenvalues above and with fewer."""
        low = max(s for s, n in self.known.items() if n >= j)
        high = min(s for s, n in self.known.items() if n < j)
        return low, high


@dataclass(frozen=True)
class Component:
    value: float
    vector: np.ndarray
    # Counts above the value plus and minus the tolerance.
    above: int
    from_here: int


def leading_components(matrix: np.ndarray, wanted: int = COMPONENTS) -> list[Component]:
    """The largest eigenvalues and their unit vectors, in falling order, without those of no variance."""
    d = len(matrix)
    if not d or not np.abs(matrix).max() > 0:
        return []
    radius = np.abs(matrix).sum(axis=1).max()
    # Powers of two change no digit; the largest eigenvalue is then near one.
    unit = 2.0 ** np.ceil(np.log2(radius))
    v = matrix / unit
    slices = Slices(v)
    slices.known = {2.0: 0, -1.0: d}
    found: list[Component] = []
    for j in range(1, min(wanted, d) + 1):
        least = max(NOTHING, 64 * d * EPSILON) * (found[0].value / unit if found else 1.0)
        if slices.above(least) < j:
            break
        found.append(_component(v, slices, j, found, unit))
    return found


def _component(v: np.ndarray, slices: Slices, j: int, found: list[Component], unit: float) -> Component:
    d = len(v)
    basis = np.array([c.vector for c in found]).reshape(-1, d)
    low, high = slices.bracket(j)
    tolerance = 64 * d * EPSILON
    while True:
        # Narrow until number j is alone, or no shift can part it from its neighbours.
        while not (slices.above(low) == j and slices.above(high) == j - 1) and high - low > tolerance * 4:
            slices.above((low + high) / 2)
            low, high = slices.bracket(j)
        value, vector = _rayleigh(v, (low + high) / 2, basis, j)
        if low - tolerance <= value <= high + tolerance:
            above, here = slices.above(value + tolerance), slices.above(value - tolerance)
            if above < j <= here:
                return Component(value * unit, vector, above, here)
        if high - low <= tolerance * 4:
            raise ArithmeticError(f"component {j} does not converge in {low * unit}..{high * unit}")
        # The iteration left for a neighbour: start nearer.
        for part in (0.25, 0.5, 0.75):
            slices.above(low + part * (high - low))
        low, high = slices.bracket(j)


def _rayleigh(v: np.ndarray, shift: float, basis: np.ndarray, seed: int) -> tuple[float, np.ndarray]:
    """An eigenvalue near ``shift`` and its vector, orthogonal to ``basis``."""
    d = len(v)

    def cleaned(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - basis.T @ (basis @ x)
        return x / np.linalg.norm(x)

    def solved(s: float, x: np.ndarray) -> np.ndarray:
        for nudge in (0.0, 4 * EPSILON, 64 * EPSILON):
            try:
                y = np.linalg.solve(v - (s + nudge) * np.eye(d), x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all() and np.linalg.norm(y) > 0:
                return y
        return x

    x = cleaned(np.random.RandomState(seed).randn(d))
    # Two steps at the middle of the slice settle on its eigenvalue, then the shift follows the quotient.
    for _ in range(2):
        x = cleaned(solved(shift, x))
    value, best = float(x @ v @ x), np.inf
    for _ in range(12):
        y = cleaned(solved(value, x))
        now = float(y @ v @ y)
        residual = float(np.linalg.norm(v @ y - now * y))
        if residual >= best:
            break
        x, value, best = y, now, residual
    return value, x


# --- sums on Spark


@dataclass(frozen=True)
class Fit:
    """Distinct vectors, their sums per dimension, the components and all variance."""

    n: int
    sums: list[int]
    components: list[Component]
    trace: float

    def projection(self) -> np.ndarray:
        """Columns that turn a centred vector into its whitened components."""
        d = len(self.sums)
        return np.array([c.vector / c.value**0.5 for c in self.components]).reshape(-1, d).T

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n``, the whole part of the mean taken off first."""
        middle = np.array([round(s / self.n) for s in self.sums], np.int64)
        rest = np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.sums, middle, strict=True)])
        return (x - middle) - rest


def gram(vectors: DataFrame, width: int, values: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``values`` and of their products over all ``vectors`` (x).

    A task sums its rows and sends one row per line of its matrix; the lines meet by number and are
    added as they come, so nothing but one matrix per task and the last one is held anywhere.
    """

    def partial(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in stream:
            z = values(padded(batch.column(0), np.int64))
            z = np.hstack([z, np.ones((len(z), 1))])
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield from _lines(dict(enumerate(total)))

    def added(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in stream:
            for i, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[i] = totals.get(i, 0.0) + np.frombuffer(line)
        yield from _lines(totals)

    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = vectors.select("x").mapInArrow(partial, "i int, line binary").repartition(min(parts, width + 1), "i").mapInArrow(added, "i int, line binary")
    total = np.zeros((width + 1, width + 1))
    for row in lines.collect():  # one row per dimension
        total[row["i"]] = np.frombuffer(row["line"])
    return total[-1, :-1], total[:-1, :-1]


def _lines(totals: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    return batches({"i": (list(totals), pa.int32()), "line": ([line.tobytes() for line in totals.values()], pa.binary())}, 256)


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """Each vector (x) once, shorter ones padded to the longest."""
    distinct = stored(vectors.distinct(), "vectors")
    lengths = distinct.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if lengths["least"] == lengths["most"]:
        return distinct
    zeros = F.array_repeat(F.lit(SHIFT).cast("bigint"), F.lit(lengths["most"]) - F.size("x"))
    return stored(distinct.select(F.concat("x", zeros).alias("x")).distinct(), "vectors")


def fit_whitening(distinct: DataFrame, wanted: int = COMPONENTS) -> Fit:
    """Fit on distinct whole-number vectors (x) of one length."""
    sizes = distinct.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = sizes["n"], sizes["d"] or 0
    if not n or not d:
        return Fit(n, [], [], 0.0)
    positions = F.posexplode("x").alias("i", "c")
    by_dimension = distinct.select(positions).groupBy("i").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).collect()  # one row per dimension
    sums = [int(row["s"]) for row in sorted(by_dimension, key=lambda row: row["i"])]
    middle = np.array([round(s / n) for s in sums], np.int64)
    s, g = gram(distinct, d, lambda x: (x - middle).astype(np.float64))
    offset = [int(t) - n * int(m) for t, m in zip(sums, middle, strict=True)]
    # n^2 V = n G - s s^T in whole numbers, exact as long as G is; then one rounding per entry.
    exact = [[(n * int(g[i, j]) - offset[i] * offset[j]) / (n * n) for j in range(d)] for i in range(d)]
    v = np.array(exact)
    v = (v + v.T) / 2
    return Fit(n, sums, leading_components(v, wanted), float(np.trace(v)))


def identity_error(distinct: DataFrame, fit: Fit) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, from the vectors themselves."""
    projection = fit.projection()
    s, g = gram(distinct, len(fit.components), lambda x: fit.centred(x) @ projection)
    mean = s / fit.n
    return float(np.abs(g / fit.n - np.outer(mean, mean) - np.eye(len(mean))).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n x - S)^2, exact."""
    middle = [round(s / n) for s in sums]
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    near = x - np.array(middle, np.int64)
    bound = float((n * np.abs(near).astype(np.float64) + np.abs(np.array(rest, np.float64)) + 1).max(initial=0.0)) ** 2 * max(1, len(sums))
    if bound < 2.0**62:
        return ((n * near - np.array(rest, np.int64)) ** 2).sum(axis=1).tolist()
    return [sum((n * int(c) - r) ** 2 for c, r in zip(row, rest, strict=True)) for row in near.tolist()]


def whitened(df: DataFrame, fit: Fit, vector: str = "x", carry: str = "key") -> DataFrame:
    """(carry, whitened array, deviation decimal) of every row of ``df``."""
    projection, d, kind = fit.projection(), len(fit.sums), df.schema[carry].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            x = padded(batch.column(1), np.int64, d, SHIFT)
            y = fit.centred(x) @ projection
            lists = pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), y.shape[1]).cast(pa.list_(pa.float64()))
            exact = pa.array([str(t) for t in deviations(x, fit.n, fit.sums)])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, exact], [carry, "whitened", "deviation"])

    found = df.select(carry, vector).mapInArrow(run, f"{carry} {kind}, whitened array<double>, deviation string")
    return found.withColumn("deviation", F.expr("try_cast(deviation as decimal(38,0))"))


def embedding_whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component; ``deviation`` is null where it fits no long."""
    taking_part, x = whole_vectors(df, vector)
    rows = df.where(taking_part).select(F.col(key).cast("bigint").alias("key"), x.alias("x"))
    distinct = distinct_vectors(rows.select("x"))
    fit = fit_whitening(distinct, wanted)
    if not fit.components:
        schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], schema)
    error = identity_error(distinct, fit)
    explained = F.array(*[F.lit(c.value / fit.trace) for c in fit.components])
    found = whitened(rows, fit).select("key", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return found.select(
        F.col("key").alias("vec_id"),
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(fit.n).cast("bigint").alias("n"),
        F.expr("try_cast(deviation as bigint)").alias("deviation"),
        "whitened",
        F.element_at(explained, F.col("i") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
