"""Train and test parts of the known cells."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.hashing import draw


@dataclass(frozen=True)
class Split:
    """Folds by a hash of the ``unit`` columns.

    ``unit`` is what is kept together: single cells by default, ``("entity_id",)``
    to hold out entities, ``("feature",)`` for features, or a group column such
    as a family. The fold of a row depends on the row alone, so the split needs
    no shuffle and every recomputation agrees.
    """

    folds: int = 10
    test_folds: Sequence[int] = (0, 1)
    unit: Sequence[str] = ("entity_id", "feature")
    seed: str | None = None

    def fold(self) -> Column:
        return (draw([F.col(c) for c in self.unit], self.seed) % self.folds).cast("int")

    def assign(self, cells: DataFrame) -> DataFrame:
        part = F.when(self.fold().isin(list(self.test_folds)), "test").otherwise("train")
        return cells.withColumn("split", part)

    def train(self, cells: DataFrame) -> DataFrame:
        return cells.where(~self.fold().isin(list(self.test_folds)))

    def test(self, cells: DataFrame) -> DataFrame:
        return cells.where(self.fold().isin(list(self.test_folds)))

    @staticmethod
    def leaks(train: DataFrame, test: DataFrame, on: Sequence[str] = ("entity_id", "feature")) -> DataFrame:
        """Test rows that also occur in the training part."""
        return test.join(train.select(*on).distinct(), list(on), "left_semi")
