"""Embedding whitening: principal components by contour integration (FEAST), checked by inertia counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.llm.registry import query
from corpusloom.llm.vectors import floors, matrix, summed, usable
from corpusloom.session import materialize


@dataclass(frozen=True)
class Rules:
    """Entries become floor(``scale`` * entry) + ``shift``. ``nodes`` points on the upper half of each contour."""

    components: int = 16
    scale: int = 64
    shift: int = 1_000_000
    nodes: int = 8
    #: Eigenvalues that one interval should hold at most.
    held: int = 8
    #: Eigenvalues below this share of the largest count as zero: double precision can't tell them from it.
    zero: float = 1e-11
    tolerance: float = 1e-14
    rounds: int = 40


# --- eigenvalues by contours -----------------------------------------------------------------------------------------


def count_below(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie below ``shift``: the negative pivots of a factorisation of v - shift.

    Sylvester's law: L D L' has the inertia of D. Pivots are chosen over the whole rest (Bunch and Parlett), of size
    1 or 2; one of size 2 has one negative eigenvalue when its determinant is negative.
    """
    a = v - shift * np.eye(len(v))
    negative = 0
    while len(a):
        flat = np.abs(a)
        i, j = divmod(int(flat.argmax()), len(a))
        k = int(np.diagonal(flat).argmax())
        if flat[i, j] == 0:
            break
        # The constant bounds the growth of the entries for both sizes alike.
        picked = [k] if flat[k, k] >= 0.6404 * flat[i, j] else [i, j]
        rest = np.setdiff1d(np.arange(len(a)), picked)
        d, b = a[np.ix_(picked, picked)], a[np.ix_(rest, picked)]
        negative += int((np.linalg.eigvalsh(d) < 0).sum())
        a = a[np.ix_(rest, rest)] - b @ np.linalg.solve(d, b.T)
        a = (a + a.T) / 2
    return negative


def intervals(v: np.ndarray, rules: Rules) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside), disjoint, that together hold the largest eigenvalues asked for.

    Found by bisection on inertia counts alone. A border keeps a distance from eigenvalues where there is room. Equal
    eigenvalues, which no border can part, stay in one interval however many they are.
    """
    size, top = len(v), float(np.linalg.norm(v)) * 1.01
    known: dict[float, int] = {}

    def above(s: float) -> int:
        if s not in known:
            known[s] = size - count_below(v, s)
        return known[s]

    if not top:
        return []
    floor = rules.zero * top
    finest = 1e-13 * top

    def clear(s: float, low: float, high: float) -> float:
        """A place near ``s`` whose surroundings hold no eigenvalue, if there is one between ``low`` and ``high``."""
        for share in (1e-3, 1e-5):
            margin = share * (high - low)
            for move in (0, 1, -1, 2, -2, 3, -3):
                t = s + 3 * move * margin
                if low < t - margin and t + margin < high and above(t - margin) == above(t + margin):
                    return t
        return s

    wanted = min(rules.components, above(floor))
    if not wanted:
        return []
    low, high = floor, top
    # The lowest border needed: at least ``wanted`` eigenvalues above it, no more than needed where they can be parted.
    while above(low) > wanted and high - low > finest:
        middle = clear(_between(low, high), low, high)
        low, high = (middle, high) if above(middle) >= wanted else (low, middle)
    out, open_ = [], [(low, top)]
    while open_:
        a, b = open_.pop()
        inside = above(a) - above(b)
        # A circle far wider than its lower end's distance from zero could not tell small eigenvalues from zeros.
        if not inside or b - a <= finest or (inside <= rules.held and b <= 8 * a):
            if inside:
                out.append((a, b, inside))
            continue
        middle = clear(_between(a, b), a, b)
        open_ += [(a, middle), (middle, b)]
    return sorted(out)


def _between(low: float, high: float) -> float:
    return (low + high) / 2 if high <= 8 * low else float(np.sqrt(low * high))


def contour_pairs(v: np.ndarray, low: float, high: float, count: int, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) between ``low`` and ``high``, of which there are ``count``.

    The integral of (z - v)^-1 over a circle through both ends projects onto the eigenvectors inside. Gauss-Legendre
    points on its upper half stand for the whole, since v is real; each takes one complex solve. Rayleigh-Ritz
    in the projected space gives approximate pairs, which are projected again until their residuals are at rounding level.
    """
    size, scale = len(v), float(np.linalg.norm(v))
    rng = np.random.default_rng(size)
    points, weights = np.polynomial.legendre.leggauss(rules.nodes)
    turn = np.exp(0.5j * np.pi * (points + 1))
    centre, radius = (low + high) / 2, (high - low) / 2
    inverse = [np.linalg.inv((centre + radius * t) * np.eye(size) - v) for t in turn]
    x = rng.standard_normal((size, min(size, count + max(4, count // 2))))
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    for _ in range(rules.rounds):
        y = sum(0.5 * w * (radius * t * (g @ x)).real for w, t, g in zip(weights, turn, inverse))
        q, _ = np.linalg.qr(y)
        values, turned = np.linalg.eigh(q.T @ v @ q)
        x = q @ turned
        # The pairs nearest to the interval; exactly at a border rounding decides, so they are taken by their count.
        outside = np.maximum(np.maximum(low - values, values - high), 0)
        inside = np.sort(np.lexsort((np.abs(values - centre), outside))[:count])
        residual = float(np.linalg.norm(v @ x[:, inside] - x[:, inside] * values[inside], axis=0).max()) / scale
        if best is None or residual < best[0] / 2:
            best = residual, values[inside], x[:, inside]
        elif best[0] < 1e-12:
            break
        if best[0] < rules.tolerance:
            break
    if best is None or best[0] > 1e-10:
        raise ArithmeticError(f"no convergence between {low} and {high}")
    return best[1], best[2]


def components(spark, v: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a covariance, largest first, at most ``rules.components``.

    Each interval is a task. The matrix is sent to all of them: its size is that of the vectors, whatever their number.
    The counts from the factorisations say how many pairs each interval has to give, so none is missed.
    """
    size, parts = len(v), intervals(v, rules)
    if not parts:
        return np.zeros(0), np.zeros((size, 0))
    shared = spark.sparkContext.broadcast(v)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, count in zip(*(c.to_pylist() for c in batch.columns)):
                values, vectors = contour_pairs(shared.value, low, high, count, rules)
                yield pa.RecordBatch.from_pydict({"value": values.tolist(), "vector": vectors.T.tolist()}, schema=_PAIR)

    asked = spark.createDataFrame(parts, "low double, high double, count int").repartition(len(parts))
    found = asked.mapInArrow(solve, "value double, vector array<double>").collect()
    if len(found) != sum(count for _, _, count in parts):
        raise ArithmeticError("eigenvalues missed")
    # One Rayleigh-Ritz step over all intervals makes vectors of different intervals orthogonal to the last bit.
    q, _ = np.linalg.qr(np.array([r.vector for r in found]).T)
    values, turned = np.linalg.eigh(q.T @ v @ q)
    order = np.argsort(values)[::-1][: rules.components]
    vectors = (q @ turned)[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return values[order], vectors * sign


_PAIR = pa.schema([("value", pa.float64()), ("vector", pa.list_(pa.float64()))])


# --- passes over the vectors -----------------------------------------------------------------------------------------


class Centre:
    """n and the exact sums S; gives x - S/n without loss: n x - S is a whole number before it is divided."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def gaps(self, x: np.ndarray) -> np.ndarray:
        """n x - S, as long or, where that may not fit, as Python's whole numbers."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max(map(abs, self.sums))
        kind = np.int64 if most < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, dtype=kind)

    def moved(self, x: np.ndarray) -> np.ndarray:
        return (self.gaps(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)^2 of every row; null where it exceeds a long."""
        gaps = self.gaps(x)
        if gaps.dtype == object or np.abs(gaps).max(initial=0) >= 1 << 51:
            totals = (gaps.astype(object) ** 2).sum(axis=1).tolist()
        else:
            # Halves of 26 bits: their products can be added up as longs, and are put together as whole numbers.
            high, low = gaps >> 26, gaps & ((1 << 26) - 1)
            parts = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
            totals = [(a << 52) + (b << 27) + c for a, b, c in zip(*(p.tolist() for p in parts))]
        return [t if t < 1 << 63 else None for t in totals]


def centre(fit: DataFrame, width: int) -> Centre:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * (width + 1)
        for batch in batches:
            x = matrix(batch.column("x"), width)
            wide = len(x) and max(abs(int(x.max())), abs(int(x.min()))) * len(x) >= 1 << 62
            new = [*(x.astype(object) if wide else x).sum(axis=0).tolist(), len(x)]
            sums = [a + b for a, b in zip(sums, new)]
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int64()), pa.array(map(str, sums), pa.string())], names=["slot", "value"])

    parts = fit.mapInArrow(add, "slot long, value string").withColumn("value", F.col("value").cast("decimal(38,0)"))
    sums = summed(parts)
    found = [int(sums.get(i) or 0) for i in range(width + 1)]
    return Centre(found[width], found[:width])


def covariance(fit: DataFrame, width: int, turned, size: int) -> np.ndarray:
    """The covariance, divisor n, of ``turned`` (matrix of x to a matrix with ``size`` columns of mean zero) over the fit list."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            y = turned(matrix(batch.column("x"), width))
            sums, total, n = sums + y.T @ y, total + y.sum(axis=0), n + len(y)
        flat = np.concatenate([sums.ravel(), total, [n]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["slot", "value"])

    found = summed(fit.mapInArrow(add, "slot long, value double"))
    flat = np.array([found.get(i, 0.0) for i in range(size * size + size + 1)])
    n, mean = flat[-1], flat[size * size : -1] / flat[-1]
    # The columns are centred already; what rounding left of their means goes too.
    both = flat[: size * size].reshape(size, size) / n - np.outer(mean, mean)
    return (both + both.T) / 2


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", rules: Rules = Rules()) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per usable vector and component.

    Which vectors are usable is said in ``vectors.usable``; the others have no row. The fit list holds every different
    vector of whole numbers once. Components are numbered from 1 by falling eigenvalue; their largest entry is
    positive. Eigenvalues of zero can't be whitened and have no component, so equal vectors alone, or none, give no
    rows. Repeated rows and ids keep their own rows. ``deviation`` is null where it exceeds a long. Entries beyond 2^62 over
    the scale are held there. Other columns are not read.
    """
    spark = df.sparkSession
    kind = df.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kept, width = usable(df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")), "vector")
    nothing = spark.createDataFrame([], schema)
    if not width:
        return nothing
    moved = F.transform(floors("vector", rules.scale, 1 << 62), lambda x: x + F.lit(rules.shift))
    rows = kept.select("vec_id", moved.alias("x"))
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    middle = centre(fit, width)
    v = covariance(fit, width, middle.moved, width)
    values, vectors = components(spark, v, rules)
    if not len(values):
        return nothing
    turn = vectors / np.sqrt(values)
    size = len(values)
    error = float(np.abs(covariance(fit, width, lambda x: middle.moved(x) @ turn, size) - np.eye(size)).max())
    explained = values / np.trace(v)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width)
            row = np.repeat(np.arange(len(x)), size)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(row)),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(row), middle.n)),
                    pa.array(middle.deviations(x), pa.int64()).take(pa.array(row)),
                    pa.array((middle.moved(x) @ turn).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(row), error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)


@query("op11_whitening")
def op11_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
