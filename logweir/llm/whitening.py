"""Whitening of embeddings by refined eigenvectors of their covariance.

Vectors become whole numbers, so sums and products over all rows are exact whatever the order of
tasks. Eigenvectors of the covariance are taken in single precision and corrected by the iteration
of Ogita and Aishima: one step costs a few matrix products in extended precision and squares the
error. Vectors whose eigenvalues lie too close for a step to tell apart form a cluster; a small
eigenproblem inside its subspace turns them, and the next steps go on from there.
"""

import math
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What an entry is multiplied by, and what is added to its floor.
FACTOR, OFFSET = 1024, 100_000

COMPONENTS = 8
LIMIT = float(1 << 30)  # entries are limited to this size, so that products stay exact
CHUNK_VALUES = 1 << 19  # entries of a task's rows held as numbers at a time
ROUNDS = 30
# An eigenvalue below this share of the trace is rounding, not variance.
NOTHING = 1e-13


# Eigenvectors -------------------------------------------------------------------------------


def _corrected(a: np.ndarray, x: np.ndarray):
    """One step: (eigenvalues, corrected vectors, size of the correction, smallest gap it could tell)."""
    rest = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2  # else rounding, divided by a small gap, would tilt vectors towards one another
    values = np.diag(s) / (1 - np.diag(rest))

    def norm(m):
        return np.sqrt((m * m).sum())

    gap = 2 * (norm(s - np.diag(values)) + norm(a) * norm(rest))
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > gap
    change = np.where(far, (s + values[None, :] * rest) / np.where(far, apart, 1), rest / 2)
    return values, x + x @ change, np.abs(change).max(), gap


def _clusters(values: np.ndarray, gap) -> list[np.ndarray]:
    """Positions of eigenvalues that follow one another within ``gap``, two or more at a time."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def eigenvectors(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, good to double precision.

    Of exactly equal eigenvalues any orthonormal basis may come. The sign makes the entry of
    largest size positive.
    """
    a = covariance.astype(np.longdouble)
    scale = np.abs(a).max() if a.size else 0
    if not scale:
        return np.zeros(len(a)), np.eye(len(a))
    a = (a + a.T) / (2 * scale)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    done = np.finfo(np.float64).eps / 16
    before = np.inf
    for _ in range(ROUNDS):
        values, x, change, gap = _corrected(a, x)
        solved = False
        # What the step could not tell apart is solved inside its own subspace, scaled to size.
        for cluster in _clusters(values, gap):
            own = x[:, cluster]
            middle = values[cluster].mean()
            inside = own.T @ (a @ own) - middle * (own.T @ own)
            size = np.abs(inside).max()
            if size > np.finfo(np.longdouble).eps * 64:
                x[:, cluster] = own @ np.linalg.eigh((inside / size).astype(np.float64))[1]
                solved = True
        # Corrections end at rounding divided by the least gap; from there they get no smaller.
        if not solved and (change <= done or change > before / 2):
            break
        before = np.inf if solved else change
    values = _corrected(a, x)[0]
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x = x / np.sqrt((x * x).sum(0))
    top = x[np.abs(x).argmax(0), np.arange(len(a))]
    return (values[order] * scale).astype(np.float64), (x * np.sign(top)).astype(np.float64)


# Sums over all rows -------------------------------------------------------------------------


@dataclass
class Whitening:
    """What all rows gave: their number, exact sums, and the leading components."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    vectors: np.ndarray  # one component a column
    trace: float

    @property
    def base(self) -> list[int]:
        """A whole number next to each mean; rows are handled as differences from it."""
        return [_nearest(s, self.n) for s in self.sums]


def _nearest(total: int, n: int) -> int:
    return (2 * total + n) // (2 * n)


def _whole(part: pa.Array, base: np.ndarray):
    """Chunks of rows as whole numbers less ``base``: (place of the first row, int64 matrix)."""
    width = len(base)
    step = max(1, CHUNK_VALUES // width)
    for at in range(0, len(part), step):
        flat = pc.list_flatten(part.slice(at, step)).to_numpy(zero_copy_only=False)
        c = np.clip(flat.reshape(-1, width).astype(np.float64), -LIMIT, LIMIT)
        yield at, np.floor(c * FACTOR).astype(np.int64) + (OFFSET - base)


def _products(d: np.ndarray) -> np.ndarray:
    """The exact matrix of products of columns, as int64 where that holds it."""
    most = int(np.abs(d).max(initial=0))
    if most * most * len(d) < 1 << 53:
        f = d.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    o = d.astype(object)
    return o.T @ o


def _usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, vector) of rows that have whole, finite vectors, as doubles."""
    rows = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return rows.where(
        "vector IS NOT NULL AND size(vector) > 0 AND "
        "forall(vector, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))"
    )


def _dimension(rows: DataFrame) -> int:
    """The most frequent length, the larger of equally frequent ones; 0 without rows."""
    lengths = rows.groupBy(F.size("vector").alias("length")).count()
    top = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    return top.length if top else 0


def _sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    def add(parts):
        n, total = 0, [0] * width
        for part in parts:
            for _, x in _whole(part.column(0), np.zeros(width, np.int64)):
                n += len(x)
                total = [a + b for a, b in zip(total, x.sum(0, dtype=np.int64).tolist())]
        if n:
            values = pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_pydict(
                {"i": pa.array(range(width), pa.int32()), "n": pa.array([n] * width, pa.int64()), "s": values}
            )

    got = rows.select("vector").mapInArrow(add, "i int, n long, s decimal(38,0)")
    by = {r.i: r for r in got.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
    return by[0].n, [int(by[i].s) for i in range(width)]


def _moments(rows: DataFrame, base: list[int]) -> np.ndarray:
    """Exact sums of products of differences from ``base``, as Python integers."""
    width = len(base)
    upper = np.triu_indices(width)

    def add(parts):
        total, room = np.zeros((width, width), np.int64), 1 << 62
        for part in parts:
            for _, d in _whole(part.column(0), np.array(base, np.int64)):
                more = _products(d)
                most = int(np.abs(more).max(initial=0))
                if most >= room:
                    total, room = total.astype(object), math.inf
                total, room = total + more, room - most
        flat = total[upper]
        if flat.any():
            high = np.array(flat >> 32, np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "i": pa.array(upper[0], pa.int32()),
                    "j": pa.array(upper[1], pa.int32()),
                    "high": pa.array(high),
                    "low": pa.array(np.array(flat & 0xFFFFFFFF, np.int64)),
                }
            )

    out = np.zeros((width, width), object)
    got = rows.select("vector").mapInArrow(add, "i int, j int, high long, low long")
    summed = got.groupBy("i", "j").agg(
        F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum("low").alias("low")
    )
    for r in summed.toLocalIterator():
        out[r.i, r.j] = out[r.j, r.i] = (int(r.high) << 32) + r.low
    return out


def _ratio(whole: int, by: int) -> np.longdouble:
    high = float(whole)
    return (np.longdouble(high) + np.longdouble(float(whole - int(high)))) / np.longdouble(by)


def fit(rows: DataFrame, width: int, components: int = COMPONENTS) -> Whitening:
    """Sums, covariance and its leading components over all rows of (id, vector)."""
    n, sums = _sums(rows, width)
    base = [_nearest(s, n) for s in sums]
    off = [s - n * b for s, b in zip(sums, base)]
    products = _moments(rows, base)
    covariance = np.array(
        [[_ratio(n * products[i, j] - off[i] * off[j], n * n) for j in range(width)] for i in range(width)],
        np.longdouble,
    )
    values, vectors = eigenvectors(covariance)
    take = min(components, width)
    return Whitening(n, sums, values[:take], vectors[:, :take], float(np.trace(covariance)))


# Application --------------------------------------------------------------------------------


def _project(d: np.ndarray, model: Whitening, base: list[int]) -> np.ndarray:
    """Whitened components of rows; NaN where a component has no variance."""
    shift = np.array([float(_ratio(s - model.n * b, model.n)) for s, b in zip(model.sums, base)])
    real = model.eigenvalues > NOTHING * model.trace
    size = np.sqrt(np.where(real, model.eigenvalues, np.nan))
    return (d.astype(np.float64) - shift) @ model.vectors / size


def _deviations(d: np.ndarray, model: Whitening, base: list[int]) -> list[int | None]:
    off = [s - model.n * b for s, b in zip(model.sums, base)]
    most = int(np.abs(d).max(initial=0)) * model.n + max(map(abs, off))
    kind = np.int64 if most * most * d.shape[1] < 1 << 63 else object
    each = d.astype(kind) * model.n - np.array(off, kind)
    return [v if v < 1 << 63 else None for v in (each * each).sum(1).tolist()]


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """Largest entry, in size, of the covariance of all whitened rows less the identity.

    Components without variance are left out; None if there is no other.
    """
    base, take = model.base, len(model.eigenvalues)
    real = np.flatnonzero(model.eigenvalues > NOTHING * model.trace)

    def add(parts):
        total = np.zeros((take + 1, take))
        for part in parts:
            for _, d in _whole(part.column(0), np.array(base, np.int64)):
                w = np.nan_to_num(_project(d, model, base))
                total[:take] += w.T @ w
                total[take] += w.sum(0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_pydict(
            {"i": pa.array(i.ravel(), pa.int32()), "j": pa.array(j.ravel(), pa.int32()), "s": pa.array(total.ravel())}
        )

    total = np.zeros((take + 1, take))
    got = rows.select("vector").mapInArrow(add, "i int, j int, s double").groupBy("i", "j")
    for r in got.agg(F.sum("s").alias("s")).collect():
        total[r.i, r.j] = r.s
    mean = total[take] / model.n
    error = total[:take] / model.n - np.outer(mean, mean) - np.eye(take)
    return float(np.abs(error[np.ix_(real, real)]).max()) if len(real) else None


def whiten(
    df: DataFrame, components: int = COMPONENTS, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every usable row.

    A row is usable if its vector is not null, not empty, holds no null, NaN or infinite entry and has
    the length that most such vectors have (the larger of equally frequent lengths). Others give
    no rows. Ids may be null or repeat; other columns are ignored. Entries are limited to
    2^30 in size. A component without variance has a null ``whitened``; a deviation beyond a long is
    null. A table without usable rows gives none. The driver holds one matrix of the dimension.
    """
    rows = _usable(df, id, vector)
    kind = rows.schema["id"].dataType.simpleString()
    schema = (
        f"`{id}` {kind}, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double"
    )
    width = _dimension(rows)
    if not width:
        return df.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("vector") == width)
    model = fit(rows, width, components)
    base, take = model.base, len(model.eigenvalues)
    error = identity_error(rows, model)
    share = [float(e / model.trace) if model.trace else None for e in model.eigenvalues]

    def apply(parts):
        for part in parts:
            for at, d in _whole(part.column(1), np.array(base, np.int64)):
                n = len(d)
                whitened = _project(d, model, base).ravel()
                ids = part.column(0).slice(at, n).take(pa.array(np.repeat(np.arange(n), take)))
                deviations = pa.array(_deviations(d, model, base), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, take + 1), n), pa.int32()),
                        pa.array(np.full(n * take, model.n), pa.int64()),
                        deviations.take(pa.array(np.repeat(np.arange(n), take))),
                        pa.array(whitened, mask=np.isnan(whitened)),
                        pa.array(share * n, pa.float64()),
                        pa.array([error] * (n * take), pa.float64()),
                    ],
                    names=[id, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(apply, schema)
