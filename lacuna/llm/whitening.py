"""Whitening of vectors by an incremental eigendecomposition.

Each partition keeps the spectrum of the scatter of its rows by centred rank-one updates
(:mod:`lacuna.llm.spectrum`); spectra of partitions are combined, again by rank-one updates, FAN_IN
at a time, until one is left. Its eigenvectors are a basis for a last pass over all rows, a
Rayleigh-Ritz step: with the exact mean taken off each row first, the small matrix of the covariance
in that basis is summed, and its eigenvectors turn the basis to double precision. A further pass
measures how far the whitened rows' covariance is from the identity.

What a task or the driver holds grows with the square of the number of dimensions, not with rows.

Entries are whole numbers x = floor(1024 * c) + 100000, so that sums and deviations are exact.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped; the rest are fitted
and returned, repeated ids and repeated vectors as often as they are there, null ids too. A vector that is shorter
than the longest has zeros in place of its missing entries. An entry whose x is beyond 2^62 counts as that bound.
There are as many components as dimensions at most. A component without variance has a null ``whitened``
and no part in ``identity_error``. ``deviation`` is null where it is beyond a long, and ``deviation_exact`` where it is beyond
38 digits. Without rows the result is empty. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm.spectrum import Spectrum
from lacuna.llm.store import Store

SCALE, SHIFT, BOUND = 1024, 100_000, 1 << 62
FAN_IN = 16
BLOCK_ROWS = 1024
"""Rows that are brought to a triangle before their rank-one updates; 1 updates by each row itself."""
ZERO = 1e-13
"""Share of the trace up to which an eigenvalue is rounding."""

_SPECTRUM = "part long, n long, mean array<double>, value double, vector array<double>"


def clean(df: DataFrame, vector_col: str) -> DataFrame:
    """Rows with a vector of finite entries."""
    entry = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.where(F.col(vector_col).isNotNull() & F.forall(vector_col, entry))


def whole_numbers(column: pa.ListArray, dims: int) -> np.ndarray:
    """Rows of floor(1024 * c) + 100000; missing entries count as zero."""
    offsets = column.offsets.to_numpy()
    c = column.values.to_numpy(zero_copy_only=False).astype(np.float64)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(c * SCALE), -float(BOUND), float(BOUND)).astype(np.int64) + SHIFT
    out = np.full((len(sizes), dims), SHIFT, dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(x)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = x
    return out


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, rows: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield whole_numbers(batch.column("vector").slice(at, rows), dims)


def _exact_sum(x: np.ndarray) -> np.ndarray:
    """Sums of columns as Python integers."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return (high.sum(0).astype(object) << 32) + low.sum(0).astype(object)


def _exact_squares(d: np.ndarray) -> list[int]:
    """Sums of squares of rows, as Python integers where 64 bits could overflow."""
    most = int(np.abs(d).max(initial=0)) if d.dtype != object else None
    if most is None or most * most * d.shape[1] >= 1 << 63:
        d = d.astype(object)
    return [int(v) for v in (d * d).sum(1)]


def _spectrum_batch(part: int, s: Spectrum) -> pa.RecordBatch:
    dims = len(s.mean)
    return pa.RecordBatch.from_pydict(
        {
            "part": [part] * dims, "n": [s.n] * dims, "mean": [s.mean.tolist()] * dims,
            "value": s.values, "vector": s.vectors.T.tolist(),
        },
        pa.schema([
            ("part", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())),
            ("value", pa.float64()), ("vector", pa.list_(pa.float64())),
        ]),
    )


def _as_spectrum(rows: pa.Table, dims: int) -> Spectrum:
    s = Spectrum(dims)
    s.n, s.mean = rows.column("n")[0].as_py(), np.array(rows.column("mean")[0].as_py())
    values = rows.column("value").to_numpy()
    order = np.argsort(values, kind="stable")
    s.values, s.vectors = values[order], np.array(rows.column("vector").to_pylist())[order].T
    return s


def fit_spectrum(vectors: DataFrame, dims: int, store: Store, block_rows: int = BLOCK_ROWS) -> Spectrum:
    """The spectrum of all rows of ``vectors`` (vector), by partition and then combined."""

    def of_partition(batches):
        from pyspark import TaskContext

        s = Spectrum(dims)
        for x in _blocks(batches, dims, block_rows):
            s.add_rows(x.astype(np.float64))
        if s.n:
            yield _spectrum_batch(TaskContext.get().partitionId(), s)

    def combined(rows: pa.Table) -> pa.Table:
        total = None
        for part in sorted(rows.column("part").unique().to_pylist()):
            s = _as_spectrum(rows.filter(pa.compute.equal(rows.column("part"), part)), dims)
            if total is None:
                total = s
            else:
                total.add(s)
        return pa.Table.from_batches([_spectrum_batch(rows.column("part")[0].as_py() // FAN_IN, total)])

    found, level = store.keep(vectors.mapInArrow(of_partition, _SPECTRUM), "spectra-0"), 0
    while found.select("part").distinct().count() > 1:
        level += 1
        found = store.keep(
            found.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(combined, _SPECTRUM), f"spectra-{level}"
        )
        store.drop(f"spectra-{level - 1}")
    return _as_spectrum(found.toArrow(), dims)


def _matrix(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of (i, row) of all tasks; as many rows as dimensions come to the driver."""
    entries = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((size, size))
    for i, j, v in entries.collect():
        out[i, j] = v
    return (out + out.T) / 2


@dataclass
class Whitening:
    """A fitted whitening; ``apply`` gives the components of any clean vectors."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def has_variance(self) -> np.ndarray:
        return self.values > ZERO * self.trace

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, max((abs(s) for s in self.sums), default=0))
        if most < 1 << 61:
            return x * self.n - np.array(self.sums, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def whitened(self, d: np.ndarray) -> np.ndarray:
        """Whitened components of rows of :meth:`deviations`; NaN where there is no variance."""
        centred = (d / self.n).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.has_variance, (centred @ self.vectors) / np.sqrt(self.values), np.nan)

    def apply(self, vectors: DataFrame) -> DataFrame:
        """``id`` and ``vector`` to a row for each component."""
        model, dims, parts = self, len(self.sums), len(self.values)
        explained = self.values / self.trace if self.trace > 0 else np.zeros(parts)
        schema = T.StructType([
            vectors.schema["id"], *T._parse_datatype_string(
                "component int, n long, deviation long, whitened double, explained double, identity_error double, "
                "deviation_exact decimal(38,0)"
            ),
        ])

        def components(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    rows = batch.slice(at, BLOCK_ROWS)
                    d = model.deviations(whole_numbers(rows.column("vector"), dims))
                    squares, white, m = _exact_squares(d), model.whitened(d), rows.num_rows
                    repeated = np.repeat(np.arange(m), parts)
                    fits = pa.array([v if v < 1 << 63 else None for v in squares], pa.int64())
                    exact = pa.array([v if v < 10**38 else None for v in squares], pa.decimal128(38, 0))
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows.column("id").take(pa.array(repeated)),
                            pa.array(np.tile(np.arange(1, parts + 1, dtype=np.int32), m)),
                            pa.array(np.full(m * parts, model.n, dtype=np.int64)),
                            fits.take(pa.array(repeated)),
                            pa.array(white.reshape(-1), from_pandas=True),
                            pa.array(np.tile(explained, m)),
                            pa.array([model.identity_error], pa.float64()).take(pa.array(np.zeros(m * parts, np.int64))),
                            exact.take(pa.array(repeated)),
                        ],
                        names=schema.names,
                    )

        return vectors.mapInArrow(components, schema)


def fit(vectors: DataFrame, components: int, store: Store, block_rows: int = BLOCK_ROWS) -> Whitening:
    """Fit on all rows of ``vectors`` (vector), which must be clean."""
    vectors = vectors.select("vector")
    n, dims = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
    dims = dims or 0
    if not n or not dims:
        return Whitening(n, [0] * dims, np.zeros(0), np.zeros((dims, 0)), 0.0)

    def sums_of(batches):
        total = np.zeros(dims, dtype=object)
        for x in _blocks(batches, dims, BLOCK_ROWS):
            total = total + _exact_sum(x)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dims), pa.int32()), "s": pa.array(total.tolist(), pa.decimal128(38, 0))})

    found = vectors.mapInArrow(sums_of, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s"))
    sums = [int(s) for _, s in sorted(map(tuple, found.collect()))]
    basis = fit_spectrum(vectors, dims, store, block_rows).vectors
    whole = Whitening(n, sums, np.ones(dims), basis, float(dims))

    def in_basis(model, columns):
        def products(batches):
            total = np.zeros((columns, columns))
            for x in _blocks(batches, dims, BLOCK_ROWS):
                y = np.nan_to_num(model.whitened(model.deviations(x)))
                total += y.T @ y
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(columns), pa.int32()), "row": total.tolist()})

        return _matrix(vectors.mapInArrow(products, "i int, row array<double>"), columns) / n

    covariance = in_basis(whole, dims)
    values, turn = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: min(components, dims)]
    best = Whitening(n, sums, np.maximum(values[order], 0.0), basis @ turn[:, order], float(np.trace(covariance)))
    with_variance = np.diag(best.has_variance.astype(float))
    best.identity_error = float(np.abs(in_basis(best, len(order)) - with_variance).max())
    return best


def whiten(df: DataFrame, id_col: str, vector_col: str, store: Store, components: int = 8) -> DataFrame:
    """The first components of every clean row, by a whitening fitted on all of them.

    Columns: the id under its own name, component, n, deviation, whitened, explained, identity_error, deviation_exact.
    """
    rows = clean(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), "vector")
    return fit(rows, components, store).apply(rows).withColumnRenamed("id", id_col)
