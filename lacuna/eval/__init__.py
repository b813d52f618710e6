"""Splits, scores, calibration and breakdowns."""

from lacuna.eval.breakdowns import FamilyAreaAnalysis, FeatureErrorAnalysis, ResourceSplitAnalysis
from lacuna.eval.calibration import Calibration
from lacuna.eval.evaluator import Evaluator, GoldItem
from lacuna.eval.metrics import (
    DEFAULT_CONFIDENCE_MAP,
    compute_binary_metrics,
    confidence_label_to_probability,
    expected_calibration_error,
)
from lacuna.eval.splits import Split

__all__ = [
    "DEFAULT_CONFIDENCE_MAP",
    "Calibration",
    "Evaluator",
    "FamilyAreaAnalysis",
    "FeatureErrorAnalysis",
    "GoldItem",
    "ResourceSplitAnalysis",
    "Split",
    "compute_binary_metrics",
    "confidence_label_to_probability",
    "expected_calibration_error",
]
