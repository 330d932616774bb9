"""Embedding whitening by polarisation: every covariance is a difference of variances.

Entries become integers ``floor(64 * c) + 1000000``.  A first pass gives the number of vectors and exact sums, a second
the exact squares of centred values: one for every dimension, and one for the sum of every pair of dimensions.  With
``a`` and ``b`` centred, ``cov(a, b) = (var(a + b) - var(a) - var(b)) / 2``, all in integers; only the finished
quotients become doubles, for ``eigh`` on the driver.  Tasks centre by the integer next to the mean, and what that
leaves out is put right exactly.  Sums travel as four limbs of 40 bits, so neither longs nor the order of adding matter.

The driver holds numbers for pairs of dimensions, never for vectors.  Vectors don't shuffle: three map passes over the
table (sums, squares, how well the result is white) precede the one that returns rows.

Defined results: a vector that is null or holds null or non-finite entries is dropped, also one without entries and one
with an entry that a long can't hold 64 times (from 2**56 on); shorter vectors are as if padded with zeros; null ids and
repeated rows are rows like any other; further columns are ignored.  Components: ``min(32, dimensions)``, each with its
largest entry positive (the first such).  A component without variance (up to rounding) has ``whitened`` null and isn't
part of ``identity_error``; if no vector varies, ``explained`` and ``identity_error`` are null.  ``deviation`` is null
where a long can't hold it.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import Shared

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 32
# Entries from here on don't fit a long after scaling.
TOO_LARGE = float(1 << 56)
# Numbers of a matrix that one vectorised step looks at.
STEP = 1 << 20
LIMB, LIMBS = 40, 4
# Binary digits after the point in the sums of whitened products.
DIGITS = 40

_SUMS = "place long, " + ", ".join(f"l{k} long" for k in range(LIMBS))
_ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(batch: pa.RecordBatch, d: int | None = None) -> tuple[pa.Array, np.ndarray]:
    """Ids and integer entries of a batch's usable vectors, padded to ``d`` (default: its longest) dimensions."""
    column = batch.column("embedding")
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    fine = lengths > 0
    fine[row[~(np.abs(flat) < TOO_LARGE)]] = False
    d = int(lengths[fine].max(initial=0)) if d is None else d
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full((len(lengths), d), SHIFT, np.int64)
    used = fine[row]
    out[row[used], place[used]] = np.floor(SCALE * flat[used]).astype(np.int64) + SHIFT
    return batch.column("vec_id").filter(pa.array(fine)), out[fine]


def steps(batches, d: int):
    """Bounded parts of a task's vectors."""
    most = max(1, STEP // max(1, d))
    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            ids, x = integers(batch.slice(lo, most), d)
            if len(x):
                yield ids, x


def exact(y: np.ndarray, times: int) -> np.ndarray:
    """``y`` in the narrowest kind of number in which sums of ``times`` squares of twice its largest entry are exact."""
    return y if times * (2 * max(abs(int(y.min(initial=0))), abs(int(y.max(initial=0))))) ** 2 < 1 << 62 else y.astype(object)


def squares(y: np.ndarray) -> np.ndarray:
    """Sums of squares of every dimension, then of every pair's sum in the order of ``np.triu_indices(d, 1)``."""
    y = exact(y, len(y))
    total = [(y * y).sum(axis=0)]
    for i in range(y.shape[1] - 1):
        z = y[:, i : i + 1] + y[:, i + 1 :]
        z *= z
        total.append(z.sum(axis=0))
    return np.concatenate(total).astype(object)


def _limbs(values) -> pa.RecordBatch:
    values = [int(v) for v in values]
    mask = (1 << LIMB) - 1
    parts = [[(v >> (LIMB * k)) & mask if k < LIMBS - 1 else v >> (LIMB * k) for v in values] for k in range(LIMBS)]
    columns = [pa.array(np.arange(len(values))), *(pa.array(p, pa.int64()) for p in parts)]
    return pa.RecordBatch.from_arrays(columns, names=["place", *(f"l{k}" for k in range(LIMBS))])


def exact_sums(rows: DataFrame, task) -> list[int]:
    """Sums over all tasks of the integers that ``task(batches)`` returns, place by place; a task's list may be shorter."""

    def run(batches):
        values = task(batches)
        if values is not None:
            yield _limbs(values)

    parts = rows.mapInArrow(run, _SUMS).groupBy("place").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)))
    table = parts.toArrow().sort_by("place")
    limbs = [table.column(f"l{k}").to_pylist() for k in range(LIMBS)]
    return [sum(x << (LIMB * k) for k, x in enumerate(v)) for v in zip(*limbs)]


class Whitening:
    """Learned from all usable vectors of a table: mean, components and eigenvalues of the covariance."""

    def __init__(self, table: DataFrame, components: int = COMPONENTS):
        rows = self.rows = _entries(table)
        spark = table.sparkSession
        self.n, self.d, sums = _totals(rows)
        self.k = min(components, self.d)
        if not self.n:
            return
        n, d = self.n, self.d
        # The integer next to the mean, and what the sum of values centred by it is.
        middle = [(2 * s + n) // (2 * n) for s in sums]
        self.rest = [s - n * m for s, m in zip(sums, middle)]
        self.middle = Shared(spark, np.array(middle, np.int64))
        self.covariance = self._covariance()
        self.values, self.vectors = _components(self.covariance, self.k)
        trace = float(np.trace(self.covariance))
        self.varies = self.values > self.values[0] * d * np.finfo(float).eps if trace > 0 else np.zeros(self.k, bool)
        self.explained = self.values / trace if trace > 0 else None
        self.projection = self.vectors[:, self.varies] / np.sqrt(self.values[self.varies])
        self.identity_error = self._identity_error() if self.varies.any() else None

    def _covariance(self) -> np.ndarray:
        n, d, middle = self.n, self.d, self.middle

        def task(batches):
            total = None
            for _, x in steps(batches, d):
                own = squares(x - middle.value)
                total = own if total is None else total + own
            return total

        total = exact_sums(self.rows, task)
        i, j = np.triu_indices(d, 1)
        rest = [*self.rest, *(self.rest[a] + self.rest[b] for a, b in zip(i.tolist(), j.tolist()))]
        # Sums of (n * x - S)**2, by dimension and by pair.
        centred = [n * n * q - n * r * r for q, r in zip(total, rest)]
        cube = n * n * n
        out = np.zeros((d, d))
        for a in range(d):
            out[a, a] = centred[a] / cube
        for a, b, q in zip(i.tolist(), j.tolist(), centred[d:]):
            out[a, b] = out[b, a] = (q - centred[a] - centred[b]) / (2 * cube)
        return out

    def white(self):
        """A function from integer vectors to whitened coordinates along the components that vary."""
        middle, off, projection = self.middle, np.array([r / self.n for r in self.rest]), self.projection
        return lambda x: ((x - middle.value) - off) @ projection

    def _identity_error(self) -> float:
        n, d, white, k = self.n, self.d, self.white(), int(self.varies.sum())

        def task(batches):
            total = None
            for _, x in steps(batches, d):
                w = white(x)
                own = [int(v) for v in np.rint(np.concatenate([w.sum(axis=0), (w.T @ w).reshape(-1)]) * 2.0**DIGITS)]
                total = own if total is None else [a + b for a, b in zip(total, own)]
            return total

        total = np.array([v / (n << DIGITS) for v in exact_sums(self.rows, task)])
        mean, product = total[:k], total[k:].reshape(k, k)
        return float(np.abs(product - np.outer(mean, mean) - np.eye(k)).max())


def _entries(table: DataFrame) -> DataFrame:
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _totals(rows: DataFrame) -> tuple[int, int, list[int]]:
    """Number of usable vectors, dimensions, and the sum of every dimension."""

    def task(batches):
        n, total = 0, np.zeros(0, object)
        for batch in batches:
            _, x = integers(batch)
            if not len(x):
                continue
            own = x.astype(object).sum(axis=0) if int(np.abs(x).max()) >= (1 << 62) // len(x) else x.sum(axis=0).astype(object)
            d = max(len(own), len(total))
            # A vector that is short has the shift in each dimension it lacks.
            total, own = (np.concatenate([v, np.full(d - len(v), SHIFT * c, object)]) for v, c in ((total, n), (own, len(x))))
            total, n = total + own, n + len(x)
        # Without the shift, which is put back once the number of dimensions is known.
        return [n, *(t - SHIFT * n for t in total)] if n else None

    values = exact_sums(rows, task)
    if not values:
        return 0, 0, []
    n = values[0]
    return n, len(values) - 1, [v + SHIFT * n for v in values[1:]]


def _components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their unit vectors (columns), with a sign that is the same in every run."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(sign == 0, 1.0, sign)


def deviations(y: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Sum over dimensions of ``(n * x - S)**2`` for every row, null beyond a long."""
    largest = n * max(abs(int(y.min())), abs(int(y.max()))) + max(map(abs, rest))
    kind = np.int64 if largest * largest * y.shape[1] < 1 << 62 else object
    z = y.astype(kind) * n - np.array(rest, dtype=kind)
    return [v if v < 1 << 63 else None for v in map(int, (z * z).sum(axis=1))]


def whitened(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: id, component, ``n``, deviation, whitened value, and how much it explains."""
    model = Whitening(table, components)
    if not model.n:
        return table.sparkSession.createDataFrame([], _ROWS)
    n, d, k, rest, middle, varies = model.n, model.d, model.k, model.rest, model.middle, model.varies
    white, explained, error = model.white(), model.explained, model.identity_error

    def run(batches):
        for ids, x in steps(batches, d):
            rows = len(x)
            values = np.full((rows, k), np.nan)
            values[:, varies] = white(x)
            values = values.reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, np.int64)),
                    pa.array(deviations(x - middle.value, n, rest), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(values, mask=np.isnan(values)),
                    pa.array(np.tile(explained, rows)) if explained is not None else pa.nulls(rows * k, pa.float64()),
                    pa.array([error] * (rows * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return model.rows.mapInArrow(run, _ROWS)
