"""What all imputers share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.checkpoints import stored
from lacuna.kb.knowledge_base import KEY, KnowledgeBase
from lacuna.operators.ordered import numbered


def entity_type(df: DataFrame) -> str:
    """SQL type of the entity ids, for the schemas of Python steps."""
    return df.schema["entity_id"].dataType.simpleString()


def feature_index(cells: DataFrame, targets: DataFrame) -> tuple[DataFrame, int]:
    """(feature, i) and the number of features, in the order of their names; stored, so that numbers last."""
    names = cells.select("feature").unionByName(targets.select("feature")).distinct()
    index = numbered(names, ["feature"], "i").select("feature", F.col("i").cast("int").alias("i"))
    # A table of files has a known size, so a join with a small one needs no shuffle.
    index = stored(cells.sparkSession, index, "features")
    return index, index.count()


def entity_rows(known: DataFrame, targets: DataFrame, index: DataFrame) -> DataFrame:
    """(entity_id, known ARRAY<STRUCT<i, v>> by position, need ARRAY<INT>).

    ``need`` has the targets that are not known. An entity's row is as long as
    the vocabulary at most.
    """
    cells = known.withColumn("target", F.lit(False))
    wanted = targets.select(*KEY).withColumns(
        {"value": F.lit(None).cast("double"), "target": F.lit(True)}
    )
    both = cells.unionByName(wanted).join(index, "feature")
    rows = both.groupBy("entity_id").agg(
        F.array_sort(
            F.collect_list(F.when(~F.col("target"), F.struct("i", F.col("value").alias("v"))))
        ).alias("known"),
        F.collect_set(F.when(F.col("target"), F.col("i"))).alias("wanted"),
    )
    return rows.select(
        "entity_id", "known", F.array_except("wanted", F.col("known.i")).alias("need")
    )


def known_cells(cells: DataFrame) -> DataFrame:
    return cells.where("value IS NOT NULL").select(*KEY, F.col("value").cast("double").alias("value"))


def prediction_columns(name: str, score: Column, label: Column | None = None) -> list[Column]:
    """The columns of a prediction. A score of one half counts as 1."""
    return [
        *[F.col(c) for c in KEY],
        F.lit(name).alias("imputer"),
        score.cast("double").alias("score"),
        (score >= 0.5).cast("int").alias("pred"),
        (F.lit(None) if label is None else label).cast("string").alias("confidence_label"),
    ]


def fill(kb: KnowledgeBase, predictions: DataFrame) -> DataFrame:
    """Known cells as they are, and predictions for the rest.

    The anti-join makes sure that a prediction never replaces a known value.
    """
    known = kb.known()
    filled = predictions.join(known.select(*KEY), KEY, "left_anti").select(
        *KEY, F.col("pred").cast("double").alias("value"), F.lit(True).alias("imputed")
    )
    return known.withColumn("imputed", F.lit(False)).unionByName(filled)
