"""Low-rank completion by repeated soft-thresholded SVD.

Each round replaces Z by the known cells of X and, elsewhere, by S_lambda(Z), the
singular values of Z reduced by lambda. A row of Z is kept as its known cells and a
few coefficients: off the known cells Z is A V', with V shared by all rows. A round is one
pass over the rows, where they lie, that multiplies Z'Z with a basis of features; sums
of the size of the basis are all that leaves the tasks.

The basis follows the leading right singular vectors by subspace iteration, and grows until the
least singular value it finds is below lambda, so that every direction that
survives the threshold is in it, whatever the number of features. It ends when Z
moves by less than the tolerance and the directions are those of Z.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.checkpoints import cut_lineage
from lacuna.impute.baselines import MeanImputer
from lacuna.impute.common import (
    entity_rows,
    entity_type,
    feature_index,
    known_cells,
    prediction_columns,
)
from lacuna.kb.knowledge_base import KEY

_CHANGE_ROW = -1


class _Rows:
    """A batch of rows: known cells, and coefficients for the shared vectors elsewhere.

    Where an eighth of the cells or more is known, Z is multiplied as a dense matrix, some rows at a time.
    """

    def __init__(self, pdf: pd.DataFrame, n_features: int):
        counts = [len(i) for i in pdf["i"]]
        self.row = np.repeat(np.arange(len(pdf)), counts)
        self.col = np.concatenate(pdf["i"].to_numpy()) if sum(counts) else np.zeros(0, dtype=int)
        self.val = np.concatenate(pdf["v"].to_numpy()) if sum(counts) else np.zeros(0)
        self.n = len(pdf)
        self.by_col = np.argsort(self.col, kind="stable")
        self.dense: list[tuple[slice, np.ndarray, np.ndarray]] = []
        if 8 * len(self.val) >= self.n * n_features:
            ends, step = np.cumsum([0, *counts]), max(1, _DENSE_CELLS // n_features)
            for s in range(0, self.n, step):
                part = slice(s, min(self.n, s + step))
                cells = slice(ends[part.start], ends[part.stop])
                known, values = np.zeros((part.stop - s, n_features), bool), np.zeros((part.stop - s, n_features))
                known[self.row[cells] - s, self.col[cells]] = True
                values[self.row[cells] - s, self.col[cells]] = self.val[cells]
                self.dense.append((part, known, values))

    def _blocks(self, a: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
        for part, known, values in self.dense:
            z = a[part] @ vectors.T
            np.copyto(z, values, where=known)
            yield part, z

    def moved(self, a: np.ndarray, v: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[float, float]:
        """The squared change from B W' to A V' off the known cells, and the squared size of Z before."""
        size = float((self.val**2).sum())
        if self.dense:
            change = 0.0
            for part, known, _ in self.dense:
                new, old = a[part] @ v.T, b[part] @ w.T
                change += float(((new - old) ** 2).sum(where=~known))
                size += float((old**2).sum(where=~known))
            return change, size
        # |A V' - B W'|^2 of the whole rows, less what lies on known cells, which do not move.
        known_new, known_old = self.at(a, v, self.row, self.col), self.at(b, w, self.row, self.col)
        old = float((b * (b @ (w.T @ w))).sum())
        whole = float((a * (a @ (v.T @ v))).sum()) + old - 2 * float((a * (b @ (w.T @ v))).sum())
        change = max(0.0, whole - float(((known_new - known_old) ** 2).sum()))
        return change, size + max(0.0, old - float((known_old**2).sum()))

    def at(self, a: np.ndarray, vectors: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Entries of A V'."""
        out = np.empty(len(row))
        for s in range(0, len(row), _AT_ONCE):
            part = slice(s, s + _AT_ONCE)
            out[part] = np.einsum("ij,ij->i", a[row[part]], vectors[col[part]])
        return out

    def times(self, a: np.ndarray, vectors: np.ndarray, basis: np.ndarray) -> np.ndarray:
        """Z times a basis."""
        if self.dense:
            return np.concatenate([z @ basis for _, z in self._blocks(a, vectors)])
        rest = self.val - self.at(a, vectors, self.row, self.col)
        out = a @ (vectors.T @ basis)
        for s in range(0, len(rest), _AT_ONCE):
            part = slice(s, s + _AT_ONCE)
            _add_runs(out, self.row[part], rest[part, None] * basis[self.col[part]])
        return out

    def transposed(self, a: np.ndarray, vectors: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
        """Add Z' B to ``out``."""
        if self.dense:
            for part, z in self._blocks(a, vectors):
                out += z.T @ b[part]
            return
        rest = self.val - self.at(a, vectors, self.row, self.col)
        out += vectors @ (a.T @ b)
        for s in range(0, len(rest), _AT_ONCE):
            part = self.by_col[s : s + _AT_ONCE]
            _add_runs(out, self.col[part], rest[part, None] * b[self.row[part]])


_AT_ONCE = 50_000
_DENSE_CELLS = 1_000_000


def _add_runs(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Add rows of ``values`` to the rows ``at`` of ``out``; equal places stand together."""
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    out[at[starts]] += np.add.reduceat(values, starts, axis=0)


def _advance(pdf: pd.DataFrame, rows: _Rows, start: np.ndarray, steps: list):
    """(A, V) of the rows after the steps and before the last one; ``start`` are the vectors of the stored state."""
    vectors = start
    a = np.stack(pdf["a"].to_numpy()) if vectors.shape[1] else np.zeros((rows.n, 0))
    before = a, vectors
    for step in steps:
        new, shrink = step.value
        before = a, vectors
        a, vectors = rows.times(a, vectors, new) * shrink, new
    return (a, vectors), before


def _sums(start, steps: list, n_features: int, basis):
    """Per partition: rows of Z'Z times the basis, and the squared change and size of Z."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = basis.value
        total, change, size = np.zeros((n_features, q.shape[1])), 0.0, 0.0
        for pdf in batches:
            if not len(pdf):
                continue
            rows = _Rows(pdf, n_features)
            (a, v), (b, w) = _advance(pdf, rows, start.value, steps)
            rows.transposed(a, v, rows.times(a, v, q), total)
            moved, whole = rows.moved(a, v, b, w)
            change, size = change + moved, size + whole
        yield pd.DataFrame(
            {"row": [*range(n_features), _CHANGE_ROW], "sums": [*total.tolist(), [change, size] + [0.0] * (q.shape[1] - 2)]}
        )

    return run


def _states(start, steps: list, n_features: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                (a, _), _ = _advance(pdf, _Rows(pdf, n_features), start.value, steps)
                yield pdf.assign(a=list(a))

    return run


def _answers(start, steps: list, n_features: int):
    """Values of S_lambda(Z) at the wanted cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts = [len(w) for w in pdf["wanted"]]
            if not sum(counts):
                continue
            rows = _Rows(pdf, n_features)
            (a, v), _ = _advance(pdf, rows, start.value, steps)
            row = np.repeat(np.arange(len(pdf)), counts)
            col = np.concatenate(pdf["wanted"].to_numpy()).astype(int)
            yield pd.DataFrame(
                {"entity_id": pdf["entity_id"].to_numpy()[row], "i": col, "value": rows.at(a, v, row, col)}
            )

    return run


@dataclass(frozen=True)
class SoftImputeImputer:
    """Soft-thresholded SVD to convergence.

    ``center`` takes the feature means off first, so that a feature without any
    structure falls back to its mean. Cells of features without known cells get
    the mean imputer's value.
    """

    penalty: float = 1.0
    tolerance: float = 1e-5
    center: bool = True
    checkpoint_every: int = 10
    first_rank: int = 16
    most_rounds: int = 10_000

    def _collect_sums(self, state: DataFrame, start, steps: list, n: int, basis) -> tuple[np.ndarray, float]:
        partial = state.mapInPandas(_sums(start, steps, n, basis), "row int, sums array<double>")
        summed = partial.groupBy("row").agg(
            Summarizer.sum(array_to_vector("sums")).alias("sums")
        ).select("row", vector_to_array("sums").alias("sums"))
        rows = {r["row"]: r["sums"] for r in summed.toLocalIterator()}
        if not rows:
            return np.zeros((n, basis.value.shape[1])), 0.0
        change, size = rows.pop(_CHANGE_ROW)[:2]
        return np.array([rows[i] for i in range(n)]), change / max(size, 1e-12)

    def complete(self, cells: DataFrame, targets: DataFrame) -> DataFrame:
        """(entity_id, i, value) of the completed matrix at the targets, with the index."""
        spark: SparkSession = cells.sparkSession
        known, targets = known_cells(cells), targets.select(*KEY)
        index, n = feature_index(known, targets)
        id_type = entity_type(known)
        if self.center:
            means = MeanImputer().means(known).select(
                "feature", (F.col("total") / F.col("n_known")).alias("mean")
            )
            known = known.join(means, "feature").select(
                *KEY, (F.col("value") - F.col("mean")).alias("value")
            )
        rows = entity_rows(known, targets, index).select(
            "entity_id", F.col("known.i").alias("i"), F.col("known.v").alias("v"),
            F.col("need").alias("wanted"), F.array().cast("array<double>").alias("a"),
        )
        # Rows take more work than their bytes tell: a named number of partitions is not merged for being small.
        state = cut_lineage(spark, rows.repartition(spark.sparkContext.defaultParallelism, "entity_id"))
        state_schema = f"entity_id {id_type}, i array<int>, v array<double>, wanted array<int>, a array<double>"
        random = np.random.default_rng(0)
        share = spark.sparkContext.broadcast
        basis = np.linalg.qr(random.standard_normal((n, min(n, self.first_rank))))[0] if n else np.zeros((0, 0))
        start, steps = share(np.zeros((n, 0))), []
        for iteration in range(1, self.most_rounds + 1):
            if not n:
                break
            # Two columns at least, as the sums carry two numbers more.
            wide = basis if basis.shape[1] > 1 else np.hstack([basis, np.zeros((n, 1))])
            sums, change = self._collect_sums(state, start, steps, n, share(wide))
            sums = sums[:, : basis.shape[1]]
            small = basis.T @ sums
            squares, turn = np.linalg.eigh((small + small.T) / 2)
            singular, vectors = np.sqrt(np.maximum(squares, 0.0)), basis @ turn
            full = basis.shape[1] < n and singular[0] > self.penalty
            keep = singular > self.penalty
            # How far the directions are from being singular vectors of this Z.
            off = sums @ turn[:, keep] - vectors[:, keep] * squares[keep]
            settled = (off**2).sum() <= self.tolerance * (squares[keep] ** 2).sum()
            if steps and change < self.tolerance and settled and not full:
                break
            steps.append(share((vectors[:, keep], (singular[keep] - self.penalty) / singular[keep])))
            more = random.standard_normal((n, min(n - basis.shape[1], basis.shape[1]))) if full else np.zeros((n, 0))
            basis = np.linalg.qr(np.hstack([sums, more]))[0]
            if iteration % self.checkpoint_every == 0:
                last = steps[-1].value[0]
                state = cut_lineage(spark, state.mapInPandas(_states(start, steps, n), state_schema))
                start, steps = share(last), []
        else:
            raise RuntimeError(f"not converged after {self.most_rounds} rounds")
        answers = state.mapInPandas(_answers(start, steps, n), f"entity_id {id_type}, i int, value double")
        return answers.join(index, "i").select(*KEY, "value")

    def impute(self, cells: DataFrame, targets: DataFrame) -> DataFrame:
        completed = self.complete(cells, targets)
        means = MeanImputer().impute(cells, targets).select(*KEY, F.col("score").alias("mean"))
        base = F.col("mean") if self.center else F.lit(0.0)
        score = F.when(F.col("value").isNull(), F.col("mean")).otherwise(
            F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") + base))
        )
        return means.join(completed, KEY, "left").select(*prediction_columns("softimpute", score))
