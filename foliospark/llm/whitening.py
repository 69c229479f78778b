"""Embedding whitening: Welford updates in partitions, parallel merges, symmetric QR.

Vectors are put on a grid (x = floor(64 c) + 1000000), and each distinct x
counts once in the fit.  A partition takes its vectors one by one: mean and
scatter matrix change by a rank-one update, already centred, so no large
squares are subtracted.  Partial states merge by the parallel update formula,
in two steps of bounded fan-in.  The merged state, a mean and a d by d matrix,
is all that reaches the driver; there the matrix is made tridiagonal by
reflections and diagonal by implicit QR steps with Wilkinson's shift.  Rows are
then projected where they are read.

Updates work on x - 1000000: the constant changes no covariance and keeps the
means small.  Sums and deviations are exact integers, and whitened values start
from (n x - S) / n.  The identity error is measured, not derived: whitened
vectors of the fit list go through the same states again.

Scale.  One shuffle, of distinct grid vectors, with repeated ones combined on the
map side; they are written once and read for both fits.

Cases: a null vector, an empty one, and one with null, NaN or infinite entries
is dropped; vectors of another length belong to a fit of their own (a state of
d squared doubles for each length, so there should be few lengths); grid values beyond
2**52 are cut to it; a null id stays; repeated rows each have their result;
``deviation`` is null if it doesn't fit a long; a component without variance
(less than 1e-13 of the largest) has null as ``whitened`` and doesn't count in
the identity error; without any variance ``explained`` and ``identity_error``
are null; an empty table gives no rows; other columns are neither read nor
returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.shared import materialize
from foliospark.session import ship

STEPS = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Partial states merged into one in the first step are those of every so many partitions.
FAN_IN = 64
_FLAT = 1e-13


def grid(embedding: Column) -> Column:
    """floor(64 c) of each entry as double, without the offset."""
    least, most = -(2.0**52), 2.0**52
    return F.transform(embedding, lambda c: F.floor(F.greatest(F.lit(least), F.least(F.lit(most), c.cast("double") * STEPS))))


def usable(embedding: Column) -> Column:
    return F.size(embedding).isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, lambda c: c.isNotNull() & (F.abs(c) < math.inf))


class State:
    """Count, mean and scatter of vectors, and their exact sums."""

    __slots__ = ("mean", "n", "scatter", "sums")

    def __init__(self, d: int):
        self.n, self.mean, self.scatter, self.sums = 0, np.zeros(d), np.zeros((d, d)), [0] * d

    def add(self, x: np.ndarray) -> None:
        """Welford's rank-one update."""
        self.n += 1
        delta = x - self.mean
        self.mean += delta / self.n
        self.scatter += np.outer(delta, x - self.mean)

    def extend(self, rows: np.ndarray) -> None:
        for x in rows.astype(np.float64):
            self.add(x)
        if rows.dtype == np.int64:
            for part in range(0, len(rows), 1024):  # 1024 entries of at most 2**52 fit a long
                self.sums = [a + b for a, b in zip(self.sums, rows[part : part + 1024].sum(axis=0).tolist(), strict=True)]

    def merge(self, other: State) -> None:
        """The parallel update formula."""
        n = self.n + other.n
        if not other.n:
            return
        delta = other.mean - self.mean
        self.scatter += other.scatter + np.outer(delta, delta) * (self.n * other.n / n)
        self.mean += delta * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def row(self) -> dict:
        sums = [str(s) for s in self.sums]
        return {"dim": len(self.mean), "n": self.n, "mean": self.mean.tolist(), "scatter": self.scatter.ravel().tolist(), "sums": sums}

    @classmethod
    def of(cls, row) -> State:
        out = cls(int(row["dim"]))
        out.n, out.mean, out.sums = int(row["n"]), np.array(row["mean"], dtype=float), [int(s) for s in row["sums"]]
        out.scatter = np.array(row["scatter"], dtype=float).reshape(len(out.mean), -1)
        return out


_STATE = "dim int, part int, n long, mean array<double>, scatter array<double>, sums array<string>"
_PLAIN = pa.schema([
    ("dim", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())),
    ("scatter", pa.list_(pa.float64())), ("sums", pa.list_(pa.string())),
])


def matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        own = lists if len(rows) == len(lists) else lists.take(pa.array(rows))
        yield rows, own.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), d)


def _states(project=None):
    """A partition's states, one for each length; ``project`` maps a matrix before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        states: dict[int, State] = {}
        for batch in batches:
            for _, x in matrices(batch.column("x")):
                d, x = x.shape[1], project(x) if project else x
                if x is not None and x.shape[1]:
                    states.setdefault(d, State(x.shape[1])).extend(x)
        part = TaskContext.get().partitionId() % FAN_IN
        rows = [s.row() | {"dim": d, "part": part} for d, s in states.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=_PLAIN)

    return run


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    whole = None
    for row in frame.to_dict("records"):
        state = State.of(row | {"dim": len(row["mean"])})
        if whole is None:
            whole = state
        else:
            whole.merge(state)
    return pd.DataFrame([whole.row() | {"dim": frame["dim"].iat[0], "part": frame["part"].iat[0]}])


def fit_states(vectors: DataFrame, project=None) -> dict[int, State]:
    """The merged state for each length: all that reaches the driver."""
    states = vectors.select("x").mapInArrow(_states(project), _STATE)
    some = states.groupBy("dim", "part").applyInPandas(_merged, _STATE)
    whole = some.groupBy("dim").applyInPandas(_merged, _STATE)
    return {r["dim"]: State.of(r.asDict() | {"dim": len(r["mean"])}) for r in whole.collect()}


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and reflections q of a symmetric matrix: a = q t q'."""
    a, q = a.astype(float).copy(), np.eye(len(a))
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if not length:
            continue
        v[0] += math.copysign(length, v[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def _qr_step(d: np.ndarray, e: np.ndarray, q: np.ndarray, lo: int, hi: int) -> None:
    """One implicit step on rows lo to hi, with Wilkinson's shift."""
    half = (d[hi - 1] - d[hi]) / 2
    shift = d[hi] - e[hi - 1] ** 2 / (half + math.copysign(math.hypot(half, e[hi - 1]), half))
    x, z = d[lo] - shift, e[lo]
    for k in range(lo, hi):
        r = math.hypot(x, z)
        c, s = (x / r, z / r) if r else (1.0, 0.0)
        if k > lo:
            e[k - 1] = r
        a, b, m = d[k], d[k + 1], e[k]
        d[k] = c * c * a + 2 * c * s * m + s * s * b
        d[k + 1] = s * s * a - 2 * c * s * m + c * c * b
        e[k] = c * s * (b - a) + (c * c - s * s) * m
        if k + 1 < hi:
            x, z = e[k], s * e[k + 1]
            e[k + 1] *= c
        left, right = q[:, k].copy(), q[:, k + 1].copy()
        q[:, k], q[:, k + 1] = c * left + s * right, c * right - s * left


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; the entry of largest size is positive."""
    d, e, q = tridiagonal(a)
    eps, hi = np.finfo(float).eps, len(d) - 1
    while hi > 0:
        small = np.abs(e[:hi]) <= eps * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0
        if small[hi - 1]:
            hi -= 1
            continue
        lo = hi - 1
        while lo > 0 and e[lo - 1]:
            lo -= 1
        _qr_step(d, e, q, lo, hi)
    order = np.argsort(-d, kind="stable")
    d, q = d[order], q[:, order]
    top = q[np.abs(q).argmax(axis=0), np.arange(len(d))]
    return d, q * np.where(top < 0, -1.0, 1.0)


@dataclass
class Whitener:
    """Projection of vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float | None = None

    @classmethod
    def of(cls, state: State, components: int = COMPONENTS) -> Whitener:
        cov = state.scatter / state.n
        values, vectors = symmetric_eigen((cov + cov.T) / 2)
        return cls(state.n, state.sums, values[:components], vectors[:, :components], float(np.trace(cov)))

    @property
    def flat(self) -> np.ndarray:
        """Components without variance."""
        return self.values <= _FLAT * max(self.values[0], 0) if len(self.values) else self.values > 0

    def scaled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n x - S as exact integers (of Python's kind if longs don't hold them), and whitened values."""
        most = int(np.abs(x).max(initial=0))
        if self.n * most + max(map(abs, self.sums)) < 2**62:
            wide = x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
        else:
            wide = x.astype(object) * self.n - np.array(self.sums, dtype=object)
        keep = ~self.flat
        white = np.full((len(x), len(self.values)), np.nan)
        white[:, keep] = (wide / self.n).astype(float) @ self.vectors[:, keep] / np.sqrt(self.values[keep])
        return wide, white

    def deviations(self, wide: np.ndarray) -> list[int | None]:
        """Exact sums of squares; null beyond a long."""
        if wide.dtype != object and wide.shape[1] * float(np.abs(wide).max(initial=0)) ** 2 < 2**62:
            return (wide * wide).sum(axis=1).tolist()
        totals = (sum(int(v) ** 2 for v in row) for row in wide)
        return [t if t < 2**63 else None for t in totals]


def _solid(models: dict[int, Whitener]):
    """Whitened values of the components that have variance."""

    def run(x: np.ndarray) -> np.ndarray:
        model = models[x.shape[1]]
        return model.scaled(x)[1][:, ~model.flat]

    return run


def _rows(models: dict[int, Whitener], id_type: pa.DataType):
    names = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch.column("x")):
                model = models[x.shape[1]]
                k, (wide, white) = len(model.values), model.scaled(x)
                where = np.repeat(np.arange(len(x)), k)
                explained = [v / model.trace if model.trace > 0 else None for v in model.values]
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(rows[where])).cast(id_type),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(where), model.n, dtype=np.int64)),
                    pa.array(model.deviations(wide), pa.int64()).take(pa.array(where)),
                    pa.array(white.ravel(), from_pandas=True),
                    pa.array(explained * len(x), pa.float64()),
                    pa.array([model.error] * len(where), pa.float64()),
                ], names=names)

    return run


def whiten(rows: DataFrame, key: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error of each usable row and component."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship(rows.sparkSession)
    kept = rows.where(usable(rows[embedding])).select(rows[key].alias("vec_id"), grid(rows[embedding]).alias("x"))
    listed = materialize(kept.select("x").groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x"), "vectors")
    models = {d: Whitener.of(s, components) for d, s in fit_states(listed).items()}
    for d, state in fit_states(listed, _solid(models)).items():
        cov = state.scatter / state.n
        models[d].error = float(np.abs(cov - np.eye(len(cov))).max())
    kind = kept.schema["vec_id"].dataType
    out = f"vec_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return kept.mapInArrow(_rows(models, to_arrow_type(kind)), out).withColumnRenamed("vec_id", key)
