"""Calibration by isotonic regression: the closest probabilities that rise with the score.

Rows are folded by score, dealt to stored ranges of the score, and each range pools adjacent violators on its own. What
is left are violations between ranges. Pairs of neighbouring ranges that violate meet in a task each and pool
again, round by round, until none do: a block that swallows a range empties it, and the rounds go on among
those that are left. No task holds more than two ranges, and only the first and last block of each range comes to the driver.

Outcomes are counts, so blocks are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.checkpoints import cut_lineage
from lacuna.operators.ordered import as_of_join, in_ranges, numbered

_SCHEMA = "_group long, _range int, lo double, hi double, n long, positives long"


def pool(blocks: Iterator[tuple]) -> list[list]:
    """Blocks (group, range, lo, hi, n, positives) in order, with neighbours of a group pooled until their means rise."""
    out: list[list] = []
    for block in blocks:
        out.append(list(block))
        while len(out) > 1 and out[-2][0] == out[-1][0] and out[-2][5] * out[-1][4] >= out[-1][5] * out[-2][4]:
            last = out.pop()
            out[-1][3] = last[3]
            out[-1][4] += last[4]
            out[-1][5] += last[5]
    return out


def _pooled(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["_range", "_group", "lo"], kind="stable")
    found = pool(zip(*(pdf[c].tolist() for c in ("_group", "_range", "lo", "hi", "n", "positives"))))
    return pd.DataFrame(found, columns=["_group", "_range", "lo", "hi", "n", "positives"])


@dataclass(frozen=True)
class IsotonicCalibration:
    """Blocks of scores with one calibrated probability each, for every group of ``by``.

    Rows without a score or an outcome teach nothing; a null group is a group of its own.
    """

    by: Sequence[str] = ()
    probability: str = "probability"
    outcome: str = "outcome"
    groups: DataFrame | None = field(default=None, compare=False)
    blocks: DataFrame | None = field(default=None, compare=False)

    def fit(self, scored: DataFrame) -> IsotonicCalibration:
        """Learn from rows with a probability and an outcome of 0 or 1."""
        spark = scored.sparkSession
        p, y = F.col(self.probability).cast("double"), F.col(self.outcome).cast("long")
        known = scored.where(p.isNotNull() & ~F.isnan(p) & y.isNotNull())
        folded = known.groupBy(*self.by, p.alias("lo")).agg(F.count("*").alias("n"), F.sum(y).alias("positives"))
        groups = cut_lineage(spark, numbered(folded.select(*self.by).distinct(), self.by, "_group")) if self.by else None
        fitted = IsotonicCalibration(self.by, self.probability, self.outcome, groups)
        rows = fitted._grouped(folded.withColumn("hi", F.col("lo")), "inner")
        ranged = in_ranges(rows, ["_group"], ["lo"]).select("_group", "_range", "lo", "hi", "n", "positives")
        now = cut_lineage(spark, ranged.groupBy("_range").applyInPandas(_pooled, _SCHEMA))
        while pairs := _violating(now):
            meet = F.broadcast(spark.createDataFrame(pairs, "_range int, _pair int"))
            with_pair = now.join(meet, "_range", "left")
            pooled = with_pair.where("_pair IS NOT NULL").groupBy("_pair").applyInPandas(_meeting, _SCHEMA)
            now = cut_lineage(spark, with_pair.where("_pair IS NULL").select(pooled.columns).unionByName(pooled))
        blocks = now.select("_group", "lo", "hi", "n", "positives", (F.col("positives") / F.col("n")).alias("calibrated"))
        return IsotonicCalibration(self.by, self.probability, self.outcome, groups, blocks)

    def _grouped(self, df: DataFrame, how: str) -> DataFrame:
        """``df`` with the number of its group."""
        if self.groups is None:
            return df.withColumn("_group", F.lit(0).cast("long"))
        # Structs are equal where the nulls in them are.
        named = self.groups.select(F.struct(*self.by).alias("_named"), "_group")
        return df.withColumn("_named", F.struct(*self.by)).join(named, "_named", how).drop("_named")

    def table(self) -> DataFrame:
        """(by, lo, hi, n, positives, calibrated) of each block."""
        if self.groups is None:
            return self.blocks.drop("_group")
        return self.groups.join(self.blocks, "_group").drop("_group")

    def apply(self, scored: DataFrame) -> DataFrame:
        """``scored`` with ``calibrated``: the probability of the last block that begins at or below the score.

        A score below all blocks gets the first block's. Groups that were not learned get NULL.
        """
        score = F.col(self.probability).cast("double")
        keyed = self._grouped(scored, "left").withColumn("_score", F.when(~F.isnan(score), score))
        found = as_of_join(keyed, self.blocks, ["_group"], "_score", "lo", ["calibrated"])
        lowest = self.blocks.groupBy("_group").agg(F.min_by("calibrated", "lo").alias("_lowest"))
        calibrated = F.coalesce("calibrated", F.when(F.col("_score").isNotNull(), F.col("_lowest")))
        return found.join(lowest, "_group", "left").withColumn("calibrated", calibrated).drop("_group", "_score", "_lowest")


def _meeting(pdf: pd.DataFrame) -> pd.DataFrame:
    return _pooled(pdf.drop(columns="_pair"))


def _violating(blocks: DataFrame) -> list[tuple[int, int]]:
    """(range, pair) of disjoint pairs of neighbouring ranges whose bordering blocks do not rise."""
    at, block = F.struct("_group", "lo"), F.struct("_group", "n", "positives")
    ends = blocks.groupBy("_range").agg(F.min_by(block, at).alias("first"), F.max_by(block, at).alias("last"))
    rows = sorted(ends.collect(), key=lambda r: r["_range"])
    pairs, i = [], 0
    while i + 1 < len(rows):
        a, b = rows[i]["last"], rows[i + 1]["first"]
        if a["_group"] == b["_group"] and a["positives"] * b["n"] >= b["positives"] * a["n"]:
            pairs += [(rows[i]["_range"], rows[i]["_range"]), (rows[i + 1]["_range"], rows[i]["_range"])]
            i += 1
        i += 1
    return pairs
