"""Random and mean baselines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.hashing import uniform
from lacuna.impute.common import known_cells, prediction_columns


@dataclass(frozen=True)
class RandomImputer:
    """A uniform draw per cell, the same in every run with the same seed."""

    seed: str = "0"

    def impute(self, cells: DataFrame, targets: DataFrame) -> DataFrame:
        score = uniform([F.col("entity_id"), F.col("feature")], self.seed)
        return targets.select(*prediction_columns("random", score))


@dataclass(frozen=True)
class MeanImputer:
    """Mean of a feature's known cells.

    A feature without known cells gets the mean of all cells, or one half
    if nothing is known at all.
    """

    def means(self, cells: DataFrame) -> DataFrame:
        return known_cells(cells).groupBy("feature").agg(
            F.sum("value").alias("total"), F.count("value").alias("n_known")
        )

    def impute(self, cells: DataFrame, targets: DataFrame) -> DataFrame:
        """The table of means has one row per feature; Spark broadcasts it if it is
        small and otherwise shuffles, splitting hot features."""
        means = self.means(cells)
        known = F.sum("n_known").cast("double")
        overall = means.agg(F.coalesce(F.try_divide(F.sum("total"), known), F.lit(0.5)))
        score = F.coalesce(F.col("total") / F.col("n_known"), overall.scalar())
        return targets.join(means, "feature", "left").select(*prediction_columns("mean", score))
