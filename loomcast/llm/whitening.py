"""Whitening of embeddings: leading eigenpairs of their covariance by spectrum slicing.

The covariance is exact: entries are whole numbers, tasks sum products of them around a whole centre, and what the
centre is off by is taken away with whole numbers too.  It has as many rows as a vector has entries, whatever the number
of vectors, and is all that reaches the driver.  There, the signs of the pivots of an LDL' factorisation of the shifted
covariance (Sylvester's law of inertia) count the eigenvalues above the shift: bisection isolates each leading one, a
Rayleigh quotient iteration inside its interval converges cubically, and two counts, just above and just below the value
found, certify its number."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: entries become whole numbers: floor(SCALE * c) + SHIFT
SCALE, SHIFT = 1024, 100_000
#: entries larger than this in magnitude make a vector unfit: products of some hundred rows must stay exact in 64 bits
LARGEST = 1 << 16
#: components of less than this share of the variance are rounding, not directions
NOTHING = 1e-13


def inertia(a: np.ndarray) -> tuple[int, int, int]:
    """How many eigenvalues of a symmetric matrix are positive, zero and negative.

    LDL' with the pivoting of Bunch and Kaufman: D has blocks of one or two rows, whose signs are those of ``a``."""
    a = np.array(a, dtype=np.float64)
    up = zero = down = 0
    alpha = (1 + np.sqrt(17)) / 8
    tiny = np.finfo(float).tiny
    while len(a):
        n = len(a)
        below = np.abs(a[1:, 0])
        size, r = (below.max(), int(below.argmax()) + 1) if n > 1 else (0.0, 0)
        two, at = False, 0
        if max(abs(a[0, 0]), size) <= tiny:
            zero, a = zero + 1, a[1:, 1:]
            continue
        if abs(a[0, 0]) < alpha * size:
            column = np.abs(a[:, r])
            column[r] = 0.0
            other = column.max()
            if abs(a[0, 0]) * other >= alpha * size * size:
                at = 0
            elif abs(a[r, r]) >= alpha * other:
                at = r
            else:
                two = True
        order = [0, r] + [i for i in range(1, n) if i != r] if two else [at] + [i for i in range(n) if i != at]
        a = a[np.ix_(order, order)]
        k = 2 if two else 1
        d, c, rest = a[:k, :k], a[k:, :k], a[k:, k:]
        if two:
            up, down = up + 1, down + 1  # such a block has a negative determinant
            a = rest - c @ np.linalg.solve(d, c.T)
        else:
            up, down = (up + 1, down) if d[0, 0] > 0 else (up, down + 1)
            a = rest - np.outer(c[:, 0], c[:, 0] / d[0, 0])
        a = (a + a.T) / 2
    return up, zero, down


def above(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of ``a`` greater than ``shift``."""
    return inertia(a - shift * np.eye(len(a)))[0]


def leading_pairs(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` largest eigenvalues of a positive semi-definite matrix, falling, and unit eigenvectors as rows.

    Eigenvalues of less than ``NOTHING`` of the trace are left out.  Equal ones (closer than rounding tells apart) get
    orthogonal vectors of their common space.  Fails rather than returning a value whose number isn't certified."""
    n, trace = len(a), float(np.trace(a))
    values, vectors = [], []
    if not trace > 0:
        return np.zeros(0), np.zeros((0, n))
    radius = np.abs(a).sum(axis=1) - np.abs(np.diag(a))
    top = min(trace, float((np.diag(a) + radius).max())) * (1 + 1e-12)
    slack = 64 * n * np.finfo(float).eps * top
    floor = max(NOTHING * trace, slack)
    counts: dict[float, int] = {top + slack: 0}

    def count(s: float) -> int:
        if s not in counts:
            counts[s] = above(a, s)
        return counts[s]

    rnd = np.random.default_rng(n)
    for k in range(1, most + 1):
        if k > n or count(floor) < k:
            break
        while True:
            # the closest shifts so far with fewer than k eigenvalues above, and with k or more
            hi = min(s for s, c in counts.items() if c < k)
            lo = max(s for s, c in counts.items() if c >= k)
            alone = counts[lo] == k and counts[hi] == k - 1
            if alone or hi - lo <= slack:
                pair = _quotients(a, lo, hi, np.array(vectors).reshape(-1, n), slack, rnd)
                if pair is not None:
                    break
                if hi - lo <= slack:
                    raise ArithmeticError(f"no eigenvector found for eigenvalue {k}")
            count((lo + hi) / 2)
        value, vector = pair
        if not (above(a, value + slack) < k <= above(a, value - slack)):
            raise ArithmeticError(f"eigenvalue {k} isn't certified by its counts")
        values.append(value), vectors.append(vector)
    return np.array(values), np.array(vectors).reshape(-1, n)


def _quotients(a, lo, hi, known, slack, rnd):
    """Rayleigh quotient iteration for an eigenvalue in [lo, hi], away from the vectors known; None if it leaves."""
    n = len(a)

    def unit(x):
        for _ in range(2):
            x = x - known.T @ (known @ x)
            x = x / np.linalg.norm(x)
        return x

    def solve(shift, x):
        try:
            return np.linalg.solve(a - shift * np.eye(n), x)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            return np.linalg.solve(a - (shift + slack / 64) * np.eye(n), x)

    x = unit(rnd.standard_normal(n))
    for _ in range(3):  # towards the vectors of this interval
        x = unit(solve((lo + hi) / 2, x))
    last = np.inf
    for _ in range(30):
        value = float(x @ a @ x)
        if not lo - slack <= value <= hi + slack:
            return None
        error = float(np.linalg.norm(a @ x - value * x))
        if error >= last or error == 0.0:  # as small as rounding lets it be
            return (value, x) if error <= 8 * slack else None
        last, kept = error, x
        x = unit(solve(value, x))
    return (float(kept @ a @ kept), kept) if last <= 8 * slack else None


@dataclass
class Whitening:
    """The model: vectors of the fit list, their sums, the covariance and its leading pairs (vectors as rows)."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float | None = None

    @property
    def explained(self) -> np.ndarray:
        return self.values / np.trace(self.covariance)


def _usable(vec: Column, dim: int | None = None) -> Column:
    bad = F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST))
    fit = vec.isNotNull() & ~bad & (F.size(vec) > 0)
    return fit if dim is None else fit & (F.size(vec) == dim)


def _vectors(df: DataFrame, vec_col: str, dim: int | None = None, keep: str | None = None) -> DataFrame:
    """The usable vectors as doubles, beside ``keep`` if named."""
    cols = ([F.col(keep).alias("_id")] if keep else []) + [F.col(vec_col).cast("array<double>").alias("_v")]
    return df.select(*cols).where(_usable(F.col("_v"), dim))


def _whole(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    flat = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, dim) + SHIFT


def _added(parts: DataFrame) -> dict[int, list]:
    """Rows (i, array) added up per i: at most as many rows as a vector has entries reach the driver."""
    cells = parts.select("i", F.posexplode("s").alias("j", "s"))
    sums = cells.groupBy("i", "j").agg(F.sum("s").alias("s")).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "s"))).alias("s"))
    return {r["i"]: [x["s"] for x in r["s"]] for r in sums.collect()}


def fit(df: DataFrame, vec_col: str = "embedding", components: int = 8) -> Whitening:
    """Fit to all usable vectors of ``df``: two passes for sums and products, one to measure the result.

    A vector that is null or empty, holds null or non-finite entries, or entries beyond 2^16 (whose
    products would pass 64 bits) is left out, and so is one
    whose length isn't the commonest (ties: the longer one).  No vector, or none that differs: no components."""
    lengths = _vectors(df, vec_col).groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    best = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)), 0.0)
    dim, n = best["d"], best["n"]
    rows = _vectors(df, vec_col, dim)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim, dtype=np.int64)
        for b in batches:
            total += _whole(b, dim).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total], pa.list_(pa.int64()))], ["i", "s"])

    sums = [int(x) for x in _added(rows.mapInArrow(add, "i int, s array<bigint>"))[0]]
    centre = np.array([round(s / n) for s in sums], dtype=np.int64)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros((dim, dim), dtype=np.int64), np.zeros((dim, dim), dtype=np.int64)
        for b in batches:
            x = _whole(b, dim) - centre
            for at in range(0, len(x), 256):
                part = x[at : at + 256]
                if int(np.abs(part).max(initial=0)) < 1 << 22:  # sums of 256 products are exact in doubles
                    p = part.astype(np.float64)
                    p = (p.T @ p).astype(np.int64)
                else:
                    p = part.T @ part
                high += p >> 32
                low += p & 0xFFFFFFFF
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(2 * dim), pa.int32()), pa.array([*high, *low], pa.list_(pa.int64()))], ["i", "s"])

    parts = _added(rows.mapInArrow(multiply, "i int, s array<bigint>"))
    products = [[(h << 32) + l for h, l in zip(parts[i], parts[dim + i])] for i in range(dim)]
    off = [s - n * int(c) for s, c in zip(sums, centre)]
    cov = np.array([[(n * products[i][j] - off[i] * off[j]) / (n * n) for j in range(dim)] for i in range(dim)])
    model = Whitening(n, sums, cov, *leading_pairs(cov, components))
    model.identity_error = _identity_error(rows, model)
    return model


def _project(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened values of whole vectors, one column per component."""
    centre = np.array([s // model.n for s in model.sums], dtype=np.int64)
    rest = np.array([s % model.n for s in model.sums]) / model.n
    return ((x - centre) - rest) @ (model.vectors / np.sqrt(model.values)[:, None]).T


def _identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened vectors' own covariance minus the identity, measured on all of them.

    Tasks give their count, means and products around their own means, which add up without cancellation."""
    k, dim = len(model.values), len(model.sums)
    if not k:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, mean, inner = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                z = _project(_whole(b, dim), model)
                own = z.mean(axis=0)
                c = z - own
                step = own - mean
                inner += c.T @ c + np.outer(step, step) * (count * len(z) / (count + len(z)))
                mean += step * (len(z) / (count + len(z)))
                count += len(z)
        every = [count * mean, *inner, *(count * np.outer(mean, mean))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(every)), pa.int32()), pa.array([list(x) for x in every], pa.list_(pa.float64()))], ["i", "s"])

    got = _added(rows.mapInArrow(moments, "i int, s array<double>"))
    m = np.array([got[i] for i in range(1 + 2 * k)])
    mean = m[0] / model.n
    cov = (m[1 : 1 + k] + m[1 + k :]) / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


def whiten(df: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: ``id_col``, ``component`` (from 1, by falling eigenvalue), ``n, deviation,
    whitened, explained, identity_error``.

    ``deviation`` is the exact sum over dimensions of (n*x-S)^2, as a decimal.  Vectors that ``fit`` would leave out, or
    of another length than the model's, have no row; ids may be null or repeated (each row is whitened); an empty table
    gives no row; other columns aren't read, whatever their names."""
    dim, k, n = len(model.sums), len(model.values), model.n
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = _vectors(df, vec_col, dim, keep=id_col)
    kind = rows.schema["_id"].dataType.simpleString()
    centre = [round(s / n) for s in model.sums]
    off = [s - n * c for s, c in zip(model.sums, centre)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        mid = np.array(centre, dtype=np.int64)
        parts = [np.array([f(o) for o in off], dtype=np.int64) for f in (lambda o: o >> 24, lambda o: o & 0xFFFFFF)]
        for b in batches:
            x = _whole(b, dim)
            d, z = x - mid, _project(x, model)
            at = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array((d * d).sum(axis=1)[at]),
                 pa.array((d @ parts[0])[at]), pa.array((d @ parts[1])[at]), pa.array(z.ravel()), pa.array(np.tile(model.explained, len(x)))],
                ["_id", "component", "_q", "_hi", "_lo", "whitened", "explained"],
            )

    schema = f"_id {kind}, component int, _q bigint, _hi bigint, _lo bigint, whitened double, explained double"
    out = rows.mapInArrow(run, schema) if k else rows.sparkSession.createDataFrame([], schema)
    # sum((n*d - off)^2) = n^2 sum(d^2) - 2 n sum(d*off) + sum(off^2)
    big = "CAST({} AS DECIMAL(38, 0))"
    crossed = f"({big.format(1 << 24)} * _hi + _lo)"
    exact = f"{big.format(n)} * ({big.format(n)} * _q - 2 * {crossed}) + {big.format(sum(o * o for o in off))}"
    return out.select(
        F.col("_id").alias(id_col), "component", F.lit(n).cast("long").alias("n"), F.expr(exact).cast("decimal(38,0)").alias("deviation"),
        "whitened", "explained", F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
