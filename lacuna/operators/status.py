"""Status lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.status import grade_rank
from lacuna.sources.lookups import status_labels, status_ranges


def status_lookup(records: DataFrame, statuses: DataFrame, status: str = "status") -> DataFrame:
    """Records name the display name of a status; add its id and ordinal."""
    s = statuses.select(
        F.col("name").alias(status), F.col("id").alias("status_id"),
        F.col("ordinal").alias("status_ordinal"),
    )
    return records.join(s, status, "left")


def status_from_grade(graded: DataFrame, statuses: DataFrame, grade: str = "grade") -> DataFrame:
    """The status whose range of grades holds the grade.

    The scale has few steps, so each range is written out step by step and the
    range join becomes an equi-join.
    """
    steps = status_ranges(statuses).select(
        F.col("name").alias("grade_status"), F.col("ordinal").alias("grade_ordinal"),
        F.explode(F.sequence("lo", "hi")).alias("_rank"),
    )
    ranked = graded.withColumn("_rank", grade_rank(F.col(grade)))
    return ranked.join(steps, "_rank", "left").drop("_rank")


def status_from_label(
    labelled: DataFrame, statuses: DataFrame, scheme: str, label: str = "label"
) -> DataFrame:
    """Equi-join of a label with the words of a scheme (``unesco`` or ``elcat``)."""
    words = status_labels(statuses).where(F.col("scheme") == scheme).select(
        F.col("word").alias("_word"), F.col("name").alias("label_status"),
        F.col("ordinal").alias("label_ordinal"),
    )
    return (
        labelled.withColumn("_word", F.lower(F.col(label)))
        .join(words, "_word", "left")
        .drop("_word")
    )


def status_disagreements(graded: DataFrame, statuses: DataFrame) -> DataFrame:
    """Comments whose grade does not fall into the range of the record's status."""
    return status_from_grade(graded, statuses).where(
        "grade_status IS NOT NULL AND grade_status <> status"
    )


def best_document(documents: DataFrame, types: DataFrame, entity: str, document: str, kind: str) -> DataFrame:
    """Per entity the document of the best (lowest) rank; ties by document id.

    Documents of an unknown kind have no rank and come last.
    """
    ranked = documents.join(types.select(F.col("id").alias(kind), "rank"), kind, "left")
    best = F.min(F.struct(F.col("rank").isNull().alias("unranked"), "rank", document))
    return ranked.groupBy(entity).agg(best.alias("b")).select(
        entity, F.col(f"b.{document}").alias(document), F.col("b.rank").alias("rank")
    )
