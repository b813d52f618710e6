"""Binary metrics, confidence words and calibration error."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Our own defaults; pass another mapping to change them.
DEFAULT_CONFIDENCE_MAP: Mapping[str, float] = {"low": 0.55, "medium": 0.75, "high": 0.95}


def confidence_label_to_probability(
    label: Column, mapping: Mapping[str, float] = DEFAULT_CONFIDENCE_MAP
) -> Column:
    """Probability of a confidence word, in any case; NULL for an unknown word."""
    table = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.try_element_at(table, F.lower(F.btrim(label)))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(gold: Column, pred: Column) -> dict[str, Column]:
    """Counts as aggregate columns. Rows with a NULL on either side count nowhere."""

    def count_if(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")

    return {
        "tp": count_if((gold == 1) & (pred == 1)),
        "fp": count_if((gold == 0) & (pred == 1)),
        "fn": count_if((gold == 1) & (pred == 0)),
        "tn": count_if((gold == 0) & (pred == 0)),
    }


def add_rates(counts: DataFrame) -> DataFrame:
    """Rates from the four counts; a rate with a zero denominator is 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "n": tp + fp + fn + tn,
            "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
            "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        }
    )


def compute_binary_metrics(
    scored: DataFrame, by: Sequence[str] = (), gold: str = "gold", pred: str = "pred"
) -> DataFrame:
    """One aggregation; with ``by``, one row per group."""
    counts = scored.groupBy(*by).agg(
        *[c.alias(k) for k, c in confusion(F.col(gold), F.col(pred)).items()]
    )
    return add_rates(counts)


def probability_bin(probability: Column, bins: int) -> Column:
    """Equal-width bin from 0; 1.0 belongs to the last one."""
    return F.least(F.floor(probability * bins), F.lit(bins - 1)).cast("int")


def reliability(
    scored: DataFrame, bins: int = 10, probability: str = "probability", outcome: str = "outcome",
    by: Sequence[str] = (),
) -> DataFrame:
    """Per bin the number of rows, mean probability and share of positive outcomes."""
    p = F.col(probability)
    return (
        scored.where(p.isNotNull() & F.col(outcome).isNotNull())
        .groupBy(*by, probability_bin(p, bins).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(p).alias("mean_probability"),
            F.avg(F.col(outcome).cast("double")).alias("accuracy"),
        )
    )


def expected_calibration_error(
    scored: DataFrame, bins: int = 10, probability: str = "probability", outcome: str = "outcome",
    by: Sequence[str] = (),
) -> DataFrame:
    """Mean gap between probability and accuracy over the bins, weighted by size."""
    gap = F.abs(F.col("accuracy") - F.col("mean_probability"))
    return (
        reliability(scored, bins, probability, outcome, by)
        .groupBy(*by)
        .agg(F.sum("n").alias("n"), (F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))
    )
