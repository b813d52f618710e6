"""Calibration of predicted probabilities."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.eval.metrics import expected_calibration_error, reliability


@dataclass(frozen=True)
class Calibration:
    """Reliability of predictions (gold, pred, score).

    The probability of a prediction is that of the predicted value, so 1 - score
    for a predicted 0, and its outcome is whether the prediction is right.
    """

    bins: int = 10
    by: Sequence[str] = ()

    @staticmethod
    def outcomes(scored: DataFrame) -> DataFrame:
        score = F.col("score")
        return scored.withColumns(
            {
                "probability": F.when(F.col("pred") == 1, score).otherwise(1 - score),
                "outcome": (F.col("gold") == F.col("pred")).cast("int"),
            }
        )

    def table(self, scored: DataFrame) -> DataFrame:
        return reliability(self.outcomes(scored), self.bins, by=self.by)

    def error(self, scored: DataFrame) -> DataFrame:
        return expected_calibration_error(self.outcomes(scored), self.bins, by=self.by)
