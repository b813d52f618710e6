"""Predictions against gold."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.eval.calibration import Calibration
from lacuna.eval.metrics import compute_binary_metrics
from lacuna.kb.knowledge_base import KEY


class GoldItem(NamedTuple):
    """One cell with its true value."""

    entity_id: str
    feature: str
    gold: int

    @staticmethod
    def frame(spark: SparkSession, items: Iterable[GoldItem]) -> DataFrame:
        return spark.createDataFrame(list(items), "entity_id string, feature string, gold int")

    @staticmethod
    def of_cells(cells: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Known cells as gold rows."""
        return cells.where("value IS NOT NULL").select(
            *KEY, (F.col("value") >= threshold).cast("int").alias("gold")
        )


@dataclass(frozen=True)
class Evaluator:
    """Joins predictions to the gold rows and scores them."""

    gold: DataFrame
    bins: int = 10

    def scored(self, predictions: DataFrame) -> DataFrame:
        return predictions.join(self.gold.select(*KEY, "gold"), KEY, "inner")

    def metrics(self, predictions: DataFrame, by: Sequence[str] = ("imputer",)) -> DataFrame:
        """Metrics of the answered cells, with the numbers of gold cells and of those without an answer.

        ``by`` names columns of the predictions that tell imputers apart.
        """
        gold = self.gold.agg(F.count(F.lit(1)).alias("n")).scalar()
        found = compute_binary_metrics(self.scored(predictions), by).withColumn("n_gold", gold)
        return found.withColumn("n_unanswered", F.col("n_gold") - F.col("n"))

    def calibration(self, predictions: DataFrame, by: Sequence[str] = ("imputer",)) -> DataFrame:
        return Calibration(self.bins, tuple(by)).error(self.scored(predictions))

    def unanswered(self, predictions: DataFrame) -> DataFrame:
        """Gold rows without a prediction."""
        return self.gold.join(predictions.select(*KEY), KEY, "left_anti")

    def compare(self, predictions: Sequence[DataFrame]) -> DataFrame:
        """Metrics of several imputers, from one pass over all their predictions."""
        return self.metrics(reduce(DataFrame.unionByName, predictions))
