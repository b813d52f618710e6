"""Intervals of metrics by a Poisson bootstrap.

Every entity is drawn as often as a Poisson variable of mean 1 says, in each of k replicates, with all its
rows; the draws are hashes of (seed, replicate, entity), so no replicate needs a pass or a shuffle of its own. Rows
are folded to one per entity and group first, and each of those adds to k weighted sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.eval.metrics import add_rates, confusion
from lacuna.functions.hashing import uniform

COUNTS = ("tp", "fp", "fn", "tn")
_DRAWS = 12
"""A draw of more has a probability below one in a billion, and counts as this many."""


def poisson_steps() -> list[float]:
    """Probabilities of at most 0, 1, 2, ... for a mean of 1."""
    total, out = 0.0, []
    for n in range(_DRAWS):
        total += math.exp(-1) / math.factorial(n)
        out.append(total)
    return out


def poisson(u: Column) -> Column:
    """How often an entity is drawn, from a uniform number."""
    return sum((F.when(u >= step, 1).otherwise(0) for step in poisson_steps()), F.lit(0))


@dataclass(frozen=True)
class MetricIntervals:
    """Percentile intervals of accuracy, precision, recall and F1; ``unit`` names what is drawn whole."""

    replicates: int = 100
    level: float = 0.9
    unit: str = "entity_id"
    by: Sequence[str] = ()
    seed: str = "0"

    def replicated(self, scored: DataFrame) -> DataFrame:
        """Metrics of each replicate, with ``replicate``."""
        rows = scored.groupBy(*self.by, self.unit).agg(*[c.alias(k) for k, c in confusion(F.col("gold"), F.col("pred")).items()])
        drawn = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(self.replicates - 1))))
        weight = poisson(uniform([F.lit(self.seed), F.col("replicate"), F.col(self.unit)]))
        weighted = drawn.withColumn("_w", weight).where("_w > 0")
        sums = weighted.groupBy(*self.by, "replicate").agg(*[F.sum(F.col(c) * F.col("_w")).cast("long").alias(c) for c in COUNTS])
        return add_rates(sums)

    def run(self, scored: DataFrame) -> DataFrame:
        """(by, metric, low, high): the metric lies between in ``level`` of the replicates, by rank."""
        found = self.replicated(scored)
        metrics = ["accuracy", "precision", "recall", "f1"]
        long = found.select(*self.by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in metrics])).alias("m"))
        ranked = long.groupBy(*self.by, "m.metric").agg(F.array_sort(F.collect_list("m.x")).alias("xs"))
        cut = (1 - self.level) / 2
        # There are as many values as replicates.
        at = lambda p: F.element_at("xs", (F.floor((F.size("xs") - 1) * p) + 1).cast("int"))
        return ranked.select(*self.by, "metric", at(F.lit(cut)).alias("low"), at(F.lit(1 - cut)).alias("high"))
