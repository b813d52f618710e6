"""Prompts that show examples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.hashing import draw
from lacuna.impute.common import known_cells
from lacuna.kb.knowledge_base import KEY

QUESTION = 'Reply with JSON: {"value": 0 or 1, "confidence": "low", "medium" or "high"}'


@dataclass(frozen=True)
class ICLPrompt:
    """Up to ``k`` known cells of the same feature, then the question."""

    k: int = 3
    seed: str = "0"

    def feature_examples(self, cells: DataFrame) -> DataFrame:
        """k known cells per feature, drawn by hash; only k per task and feature are shuffled."""
        drawn = Window.partitionBy("feature").orderBy("_draw", "entity_id")
        return (
            known_cells(cells)
            .withColumn("_draw", draw([F.col("entity_id"), F.col("feature")], self.seed))
            .withColumn("rank", F.row_number().over(drawn))
            .where(F.col("rank") <= self.k)
            .select("feature", "rank", F.col("entity_id").alias("neighbour_id"), "value")
        )

    def build(self, targets: DataFrame, examples: DataFrame) -> DataFrame:
        """(entity_id, feature, prompt).

        ``examples`` has feature, rank, neighbour_id, value; with an entity_id column
        (as nearest neighbours have) they belong to one cell, else to the feature.
        """
        key = KEY if "entity_id" in examples.columns else ["feature"]

        def line(e: Column) -> Column:
            return F.format_string("- %s: %d", e["neighbour_id"].cast("string"), (e["value"] >= 0.5).cast("int"))

        shown = (
            examples.where(F.col("rank") <= self.k)
            .groupBy(*key)
            .agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour_id", "value"))).alias("list"))
            .select(*key, F.array_join(F.transform("list", line), "\n").alias("lines"))
        )
        prompt = F.concat_ws(
            "\n",
            F.concat(F.lit("Feature: "), F.col("feature")),
            F.when(F.col("lines").isNotNull(), F.lit("Known values:")),
            F.col("lines"),
            F.concat(F.lit("What is the value for "), F.col("entity_id").cast("string"), F.lit("?")),
            F.lit(QUESTION),
        )
        return targets.select(*KEY).join(shown, key, "left").select(*KEY, prompt.alias("prompt"))
