"""Imputers: known cells and target cells in, one prediction per target out."""

from lacuna.impute.baselines import MeanImputer, RandomImputer
from lacuna.impute.clients import Client
from lacuna.impute.neighbours import KNNImputer
from lacuna.impute.prompting import PromptingImputer, confidence_to_prob
from lacuna.impute.softimpute import SoftImputeImputer

__all__ = [
    "Client",
    "KNNImputer",
    "MeanImputer",
    "PromptingImputer",
    "RandomImputer",
    "SoftImputeImputer",
    "confidence_to_prob",
]
