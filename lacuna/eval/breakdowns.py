"""Metrics by resource level, by family and area, and by feature.

Groups carry few columns, and every breakdown is one aggregation of counts, so
a group with a third of all rows is folded before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.eval.metrics import add_rates, compute_binary_metrics, confusion


def _counts() -> list[Column]:
    return [c.alias(k) for k, c in confusion(F.col("gold"), F.col("pred")).items()]


@dataclass(frozen=True)
class ResourceSplitAnalysis:
    """Metrics of entities with many and with few known cells, and overall."""

    threshold: int

    def resource(self, coverage: DataFrame) -> DataFrame:
        """(entity_id, resource) from (entity_id, n_known)."""
        level = F.when(F.col("n_known") >= self.threshold, "high").otherwise("low")
        return coverage.select("entity_id", level.alias("resource"))

    def run(self, scored: DataFrame, coverage: DataFrame) -> DataFrame:
        """Entities without any known cell are low-resource."""
        joined = scored.join(self.resource(coverage), "entity_id", "left").withColumn(
            "resource", F.coalesce("resource", F.lit("low"))
        )
        counts = joined.rollup("resource").agg(F.grouping("resource").alias("_all"), *_counts())
        named = counts.withColumn(
            "resource", F.when(F.col("_all") == 1, "all").otherwise(F.col("resource"))
        )
        return add_rates(named.drop("_all"))


@dataclass(frozen=True)
class FamilyAreaAnalysis:
    """Metrics by family, by area, by both and overall.

    In the result NULL never means a total: ``grain`` says what a row is about.
    """

    family: str = "family"
    area: str = "area"

    def run(self, scored: DataFrame, groups: DataFrame) -> DataFrame:
        joined = scored.join(
            groups.select("entity_id", F.col(self.family).alias("family"), F.col(self.area).alias("area")),
            "entity_id", "left",
        )
        grain = (
            F.when(F.grouping_id() == 0, "family and area")
            .when(F.grouping_id() == 1, "family")
            .when(F.grouping_id() == 2, "area")
            .otherwise("all")
        )
        return add_rates(joined.cube("family", "area").agg(grain.alias("grain"), *_counts()))

    @staticmethod
    def groups_of(records: DataFrame) -> DataFrame:
        """Family and area of catalogue records: the root, and the first macroarea."""
        return records.select(
            F.col("languoid_id").alias("entity_id"),
            F.col("top_id").alias("family"),
            F.try_element_at("macroareas", F.lit(1)).alias("area"),
        )


@dataclass(frozen=True)
class FeatureErrorAnalysis:
    """Features by error rate, hardest first."""

    k: int | None = None

    def run(self, scored: DataFrame) -> DataFrame:
        counts = compute_binary_metrics(scored, ["feature"]).select(
            "feature", "n", (F.col("fp") + F.col("fn")).alias("n_errors"),
            "tp", "fp", "fn", "tn", (1 - F.col("accuracy")).alias("error_rate"),
        )
        hardest = counts.orderBy(F.desc("error_rate"), F.desc("n_errors"), "feature")
        return hardest if self.k is None else hardest.limit(self.k)
