"""Whitening of embeddings by spectrum slicing.

Entries become whole numbers, so sums and centred products over all different vectors are exact; Spark
adds them up, and the driver sees d (d + 1) / 2 numbers for vectors of length d. Of their covariance V,
the LDL^T factors of V - s I have as many positive pivots as V has eigenvalues above s. Such counts cut
the line into slices until each leading eigenvalue has one of its own; Rayleigh quotient iteration
from there converges cubically, and counts on both sides of what it gives certify its number.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from txnclean.llm.shared import table, written

COMPONENTS = 16
#: Whole numbers of an entry c: floor(SCALE c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Scaled entries are held within this bound (exact as double and long).
MOST = 2 ** 52
#: Rows worked on at once take about so many bytes.
CHUNK_BYTES = 4 << 20


# --- eigenvalues by slicing -------------------------------------------------------------------------

def positive_pivots(a: np.ndarray) -> int:
    """Positive eigenvalues of a symmetric matrix, by LDL^T with pivots of one or two rows."""
    a = a.copy()
    n, k, count = len(a), 0, 0
    alpha = (1 + math.sqrt(17)) / 8           # bounds the growth of entries

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        size = 1
        if k + 1 < n:
            below = np.abs(a[k + 1:, k])
            r = k + 1 + int(below.argmax())
            most, own = below.max(), abs(a[k, k])
            if own < alpha * most:
                side = np.abs(a[k:, r])
                side[r - k] = 0
                if own * side.max() < alpha * most * most:
                    if abs(a[r, r]) >= alpha * side.max():
                        swap(k, r)
                    else:
                        swap(k + 1, r)
                        size = 2
        if size == 1:
            d = a[k, k]
            count += d > 0
            if d != 0:
                column = a[k + 1:, k] / d
                a[k + 1:, k + 1:] -= np.outer(column, a[k, k + 1:])
        else:
            count += 1                        # such a pivot has one eigenvalue of each sign
            column = np.linalg.solve(a[k:k + 2, k:k + 2], a[k:k + 2, k + 2:])
            a[k + 2:, k + 2:] -= a[k + 2:, k:k + 2] @ column
        k += size
    return int(count)


@dataclass
class Slice:
    """Eigenvalues number ``first`` to ``last``, and no others, lie between lo and hi."""

    lo: float
    hi: float
    first: int
    last: int


def slices_of(v: np.ndarray, k: int, above: Callable[[float], int]) -> list[Slice]:
    """Slices of the k largest eigenvalues, each of one eigenvalue or too narrow to be cut."""
    size = float(np.abs(v).sum(1).max())
    narrow = 8 * len(v) * np.finfo(float).eps * size
    out: list[Slice] = []
    todo = [Slice(-size - narrow, size + narrow, 1, len(v))]
    while todo:
        s = todo.pop()
        if s.first > k:
            continue
        if s.first == s.last or s.hi - s.lo <= narrow:
            out.append(s)
            continue
        mid = (s.lo + s.hi) / 2
        n = min(max(above(mid), s.first - 1), s.last)
        todo += [Slice(s.lo, mid, n + 1, s.last)] * (n < s.last) + [Slice(mid, s.hi, s.first, n)] * (n >= s.first)
    return sorted(out, key=lambda s: s.first)


def leading_eigen(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Equal eigenvalues have any orthonormal vectors of their space. Raises if counts deny a number.
    """
    n = len(v)
    k = min(k, n)
    eye, eps = np.eye(n), np.finfo(float).eps
    size = float(np.abs(v).sum(1).max()) if n else 0.0
    if size == 0:
        return np.zeros(k), eye[:, :k]

    def above(s: float) -> int:
        return positive_pivots(v - s * eye)

    def solved(shift: float, x: np.ndarray) -> np.ndarray:
        try:
            return np.linalg.solve(v - shift * eye, x)
        except np.linalg.LinAlgError:
            return np.linalg.solve(v - (shift + 4 * eps * size) * eye, x)

    values, vectors = np.zeros(0), np.zeros((n, 0))
    near = 8 * n * eps * size                 # what rounding may move an eigenvalue
    rng = np.random.default_rng(1)
    for s in slices_of(v, k, above):
        own_values, own_vectors = [], []
        for _ in range(s.first, min(s.last, k) + 1):
            lo, hi, x, best = s.lo, s.hi, rng.standard_normal(n), None
            known = np.column_stack([vectors, *own_vectors])
            shift = (lo + hi) / 2
            for _ in range(60):
                x = x - known @ (known.T @ x)
                x = solved(shift, x / np.linalg.norm(x))
                x = x - known @ (known.T @ x)
                x /= np.linalg.norm(x)
                vx = v @ x
                rho = float(x @ vx)
                off = float(np.linalg.norm(vx - rho * x))
                inside = lo - near <= rho <= hi + near
                if inside and (best is None or off < best[0]):
                    best = (off, rho, x)
                elif best is not None and best[0] <= near:
                    break                     # no longer better: as near as doubles come
                if inside:
                    shift = rho               # cubic from here on
                else:                         # still drawn to another one: a narrower slice
                    best = None
                    if s.first == s.last and hi - lo > 4 * eps * size:
                        mid = (lo + hi) / 2
                        lo, hi = (mid, hi) if above(mid) >= s.first else (lo, mid)
                    shift = (lo + hi) / 2
            if best is None:
                raise ArithmeticError(f"eigenvalue {s.first} was not reached in its slice")
            own_values.append(best[1])
            own_vectors.append(best[2])
        order = np.argsort(own_values)[::-1]
        values = np.append(values, np.array(own_values)[order])
        vectors = np.column_stack([vectors, *[own_vectors[i] for i in order]])
    margin = 16 * n * eps * size
    for i, e in enumerate(values, 1):         # number i: at most i - 1 above, at least i not below
        if above(e + margin) > i - 1 or above(e - margin) < i:
            raise ArithmeticError(f"counts do not certify eigenvalue {i}")
    return values, vectors


# --- exact sums over the fit list -------------------------------------------------------------------

def _chunks(n: int, width: int) -> Iterator[tuple[int, int]]:
    rows = max(1, min(1024, CHUNK_BYTES // (8 * max(1, width))))
    for lo in range(0, n, rows):
        yield lo, min(n, lo + rows)


def whole_numbers(col: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): the rows whose vectors have d entries, all finite, and these as whole numbers."""
    off = np.asarray(col.offsets).astype(np.int64)
    entries = col.values.to_numpy(zero_copy_only=False) if len(col.values) else np.zeros(0)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    fit = np.flatnonzero(~np.asarray(col.is_null()) & (np.diff(off) == d) & (bad[off[1:]] == bad[off[:-1]]))
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * entries[off[fit][:, None] + np.arange(d)])
    return fit, np.clip(x, -MOST, MOST).astype(np.int64) + SHIFT


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<i8").reshape(-1, d)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y^T y of whole numbers, exact, as Python's (of any size)."""
    most = int(np.abs(y).max()) if y.size else 0
    total = np.zeros((y.shape[1], y.shape[1]), object)
    if most * most >= 2 ** 53:
        big = y.astype(object)
        return total + big.T @ big
    step = max(1, 2 ** 53 // max(1, most * most))
    for lo in range(0, len(y), step):          # sums below 2^53 are exact as doubles
        f = y[lo:lo + step].astype(np.float64)
        total = total + (f.T @ f).astype(np.int64).astype(object)
    return total


def _summed(fit: DataFrame, d: int, work: Callable[[np.ndarray], list[np.ndarray]], kind: str) -> dict[tuple[int, int], object]:
    """Sums of arrays that ``work`` makes of rows of x, by (number of the array, place); d rows or d^2 / 2 rows a task are added up by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = None
        for b in batches:
            for lo, hi in _chunks(b.num_rows, d):
                got = work(_matrix(b.column(0).slice(lo, hi - lo), d))
                totals = got if totals is None else [t + g for t, g in zip(totals, got)]
        for i, t in enumerate(totals or []):
            flat = [Decimal(int(v)) for v in t.ravel()] if kind == "decimal(38,0)" else t.ravel().tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(flat), i, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)),
                 pa.array(flat, pa.decimal128(38, 0) if kind == "decimal(38,0)" else pa.float64())], names=["part", "place", "v"])

    rows = fit.select("x").mapInArrow(run, f"part int, place int, v {kind}").groupBy("part", "place").agg(F.sum("v").alias("v")).collect()
    return {(r["part"], r["place"]): r["v"] for r in rows}


@dataclass
class Whitening:
    """n: rows of the fit list; centre, rest: its sums are n * centre + rest; values, vectors: of its covariance."""

    n: int
    centre: np.ndarray
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def d(self) -> int:
        return len(self.centre)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        off = np.array([r / self.n for r in self.rest])
        return ((x - self.centre) - off) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2, exact; None where it is no long."""
        y = x - self.centre
        most = self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.rest), default=0)
        if self.d * most * most < 2 ** 63:
            return ((self.n * y - np.array(self.rest, np.int64)) ** 2).sum(1).tolist()
        exact = ((self.n * y.astype(object) - np.array(self.rest, object)) ** 2).sum(1)
        return [v if v < 2 ** 63 else None for v in map(int, exact)]


def _vectors(emb: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return emb.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))


def fit_whitening(emb: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all different vectors; None if there is no vector of finite entries.

    Vectors have the length that most have (of equally frequent ones the greater); others are left out,
    as are null vectors and those with null or non-finite entries. Components without variance are left out.
    """
    src = _vectors(emb, id_col, vector_col)
    usual = (src.where(F.size("vector") > 0).groupBy(F.size("vector").alias("d")).count()
             .orderBy(F.desc("count"), F.desc("d")).limit(1).collect())
    if not usual:
        return None
    d = int(usual[0]["d"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in _chunks(b.num_rows, d):
                _, x = whole_numbers(b.column(0).slice(lo, hi - lo), d)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], names=["x"])

    # copies meet in the map tasks first: a vector that a third of the rows hold is moved once a task
    fit = written(src.select("vector").mapInArrow(rows, "x binary").distinct(), "fit")
    n = fit.count()
    if not n:
        return None
    sums = _summed(fit, d, lambda x: [x.astype(object).sum(0)], "decimal(38,0)")
    total = [int(sums[0, i]) for i in range(d)]
    centre = np.array([(2 * s + n) // (2 * n) for s in total], np.int64)      # the nearest whole number to each mean
    rest = [s - n * int(c) for s, c in zip(total, centre)]
    upper = np.triu_indices(d)
    products = _summed(fit, d, lambda x: [exact_products(x - centre)[upper]], "decimal(38,0)")
    v = np.zeros((d, d))
    for place, (i, j) in enumerate(zip(*upper)):      # exact up to this one division
        v[i, j] = v[j, i] = (n * int(products[0, place]) - rest[i] * rest[j]) / (n * n)
    values, vectors = leading_eigen(v, components)
    some = values > len(v) * np.finfo(float).eps * max(values.max(initial=0), 0)
    model = Whitening(n, centre, rest, values[some], vectors[:, some], float(np.trace(v)))
    k = len(model.values)
    if k:
        def moments(x: np.ndarray) -> list[np.ndarray]:
            w = model.whitened(x)
            return [w.sum(0), w.T @ w]

        got = _summed(fit, d, moments, "double")
        mean = np.array([got[0, i] for i in range(k)]) / n
        square = np.array([got[1, i] for i in range(k * k)]).reshape(k, k) / n
        model.identity_error = float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max())
    return model


def whiten(emb: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector of the model's length and finite
    entries and each component.

    A null id stays null; repeated rows give repeated results; other columns are ignored. A vector with a
    null or non-finite entry, another length or none has no rows; neither has any without a model.
    Entries beyond 2^52 / 64 count as that; a deviation that is no long is null.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    src = _vectors(emb, id_col, vector_col)
    if model is None:
        return emb.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        explained = model.values / model.trace if k else model.values
        for b in batches:
            for lo, hi in _chunks(b.num_rows, max(model.d, 8 * k)):
                rows, x = whole_numbers(b.column(1).slice(lo, hi - lo), model.d)
                m = len(rows)
                each = pa.array(np.repeat(rows, k))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, model.n, np.int64)), pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                     pa.array(model.whitened(x).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, model.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return src.mapInArrow(run, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return whiten(emb, fit_whitening(emb))
