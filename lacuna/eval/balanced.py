"""Folds that keep groups whole and have about as many cells each.

Groups are ranked by size over stored ranges and dealt to the folds back and forth, the largest first. Two folds then
differ by the size of the largest group at most, and no group is in two folds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators.ordered import numbered


@dataclass(frozen=True)
class BalancedSplit:
    """Folds by ``group``; rows whose group is null belong to one group of their own."""

    folds: int = 5
    group: str = "family"

    def fold_of_group(self, cells: DataFrame) -> DataFrame:
        """(group, n, fold)."""
        sizes = cells.groupBy(F.col(self.group).alias("_group")).agg(F.count("*").alias("n")).withColumn("_minus", -F.col("n"))
        ranked = numbered(sizes, ["_minus", "_group"], "_rank")
        turn = F.col("_rank") % (2 * self.folds)
        fold = F.least(turn, 2 * self.folds - 1 - turn).cast("int")
        return ranked.select(F.col("_group").alias(self.group), "n", fold.alias("fold"))

    def assign(self, cells: DataFrame) -> DataFrame:
        """``cells`` with ``fold``."""
        folds = self.fold_of_group(cells).select(F.struct(F.col(self.group)).alias("_key"), "fold")
        return cells.withColumn("_key", F.struct(F.col(self.group).alias(self.group))).join(folds, "_key").drop("_key")
