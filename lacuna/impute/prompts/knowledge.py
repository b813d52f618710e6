"""Prompts that state facts of the catalogue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.impute.common import known_cells
from lacuna.impute.prompts.in_context import QUESTION
from lacuna.kb.knowledge_base import KEY


def _fact(label: str, value: Column) -> Column:
    """A line, or NULL (which is left out) if the value is unknown."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"- {label}: "), value.cast("string")))


@dataclass(frozen=True)
class KGPrompt:
    """Lineage, area and place of the entity, and the values of its relatives."""

    def facts_of(self, records: DataFrame) -> DataFrame:
        """(entity_id, family, name, lineage_text, area, place) of catalogue records."""
        place = F.format_string("%.2f, %.2f", F.col("latitude"), F.col("longitude"))
        return records.select(
            F.col("languoid_id").alias("entity_id"),
            F.col("top_id").alias("family"),
            "name",
            F.array_join("lineage", " > ").alias("lineage_text"),
            F.array_join("macroareas", ", ").alias("area"),
            F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), place).alias("place"),
        )

    def relatives(self, cells: DataFrame, facts: DataFrame) -> DataFrame:
        """Known ones and zeros per (family, feature), counted before any join on them."""
        one = F.when(F.col("value") >= 0.5, 1).otherwise(0)
        return (
            known_cells(cells)
            .join(facts.select("entity_id", "family"), "entity_id")
            .groupBy("family", "feature")
            .agg(F.sum(one).alias("ones"), F.sum(1 - one).alias("zeros"))
        )

    def build(self, targets: DataFrame, cells: DataFrame, facts: DataFrame) -> DataFrame:
        prompt = F.concat_ws(
            "\n",
            F.concat(F.lit("Entity: "), F.coalesce(F.col("name"), F.col("entity_id").cast("string"))),
            _fact("lineage", F.col("lineage_text")),
            _fact("area", F.nullif(F.col("area"), F.lit(""))),
            _fact("place", F.col("place")),
            F.concat(F.lit("Feature: "), F.col("feature")),
            _fact("relatives with 1", F.col("ones")),
            _fact("relatives with 0", F.col("zeros")),
            F.lit(QUESTION),
        )
        return (
            targets.select(*KEY)
            .join(facts, "entity_id", "left")
            .join(self.relatives(cells, facts), ["family", "feature"], "left")
            .select(*KEY, prompt.alias("prompt"))
        )
