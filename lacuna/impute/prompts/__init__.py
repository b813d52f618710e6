"""Prompt builders."""

from lacuna.impute.prompts.in_context import ICLPrompt
from lacuna.impute.prompts.knowledge import KGPrompt

__all__ = ["ICLPrompt", "KGPrompt"]
