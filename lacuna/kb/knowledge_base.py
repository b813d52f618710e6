"""Access to a sparse entity-by-feature matrix.

The matrix is kept long, one row per known cell. A cell that is missing has no
row or a NULL value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.checkpoints import cut_lineage
from lacuna.operators.ordered import numbered

KEY = ["entity_id", "feature"]
MOST_COLUMNS = 10_000
BLOCK = 4096


class KnowledgeBase:
    """Cells (entity_id, feature, value), one row per (entity_id, feature).

    ``entity_id`` may have any type that can be ordered; ``feature`` is a string.

    Only ``wide`` and ``features`` bring the vocabulary to the driver, as a list of columns.
    """

    def __init__(self, cells: DataFrame):
        self.cells = cells.select(*KEY, F.col("value").cast("double").alias("value"))
        self._features: list[str] | None = None

    @classmethod
    def from_sources(cls, cells: DataFrame, how: str = "union") -> KnowledgeBase:
        """Combine the sources of a cell: ``union`` (largest value) or ``average``."""
        combine = {"union": F.max, "average": F.avg}[how]
        return cls(cells.groupBy(*KEY).agg(combine("value").alias("value")))

    @classmethod
    def from_parquet(cls, spark: SparkSession, path: str) -> KnowledgeBase:
        return cls(spark.read.parquet(path))

    @classmethod
    def from_wide(cls, wide: DataFrame, entity: str, features: Sequence[str]) -> KnowledgeBase:
        """One column per feature to one row per known cell."""
        long = wide.unpivot(
            [F.col(entity).alias("entity_id")],
            [F.col(f).cast("double").alias(f) for f in features],
            "feature", "value",
        )
        return cls(long.where("value IS NOT NULL"))

    @classmethod
    def from_vectors(
        cls, vectors: DataFrame, entity: str, vector: str, threshold: float | None = None
    ) -> KnowledgeBase:
        """One array per entity; features are positions from 0.

        With ``threshold`` the values become 1 (above it) or 0.
        """
        cells = vectors.select(
            F.col(entity).alias("entity_id"),
            F.posexplode(vector).alias("pos", "raw"),
        )
        value = F.col("raw").cast("double")
        if threshold is not None:
            value = F.when(F.col("raw") > threshold, 1.0).when(F.col("raw").isNotNull(), 0.0)
        return cls(
            cells.select("entity_id", F.col("pos").cast("string").alias("feature"), value.alias("value")),
        )

    def known(self) -> DataFrame:
        return self.cells.where("value IS NOT NULL")

    def features(self) -> list[str]:
        """The sorted vocabulary, as the columns of :meth:`wide`; more than ``MOST_COLUMNS`` are an error."""
        if self._features is None:
            rows = self.cells.select("feature").distinct().limit(MOST_COLUMNS + 1).collect()
            if len(rows) > MOST_COLUMNS:
                raise ValueError(f"more than {MOST_COLUMNS} features; name those that are wanted")
            self._features = sorted(r["feature"] for r in rows)
        return self._features

    def entities(self) -> DataFrame:
        return self.cells.select("entity_id").distinct()

    def missing(self) -> DataFrame:
        """(entity_id, feature) of the cells without a value.

        Complements each entity's own features against the vocabulary, a block of ``BLOCK`` features at a time, so no row is longer
        than that. An entity of which no cell is known must have a row with a NULL value to be seen.
        """
        index = numbered(self.cells.select("feature").distinct(), ["feature"], "i")
        index = cut_lineage(self.cells.sparkSession, index.withColumn("block", F.floor(F.col("i") / BLOCK)))
        blocks = index.groupBy("block").agg(F.collect_list("feature").alias("all"))
        last = index.agg(F.max("block")).first()[0]
        if last is None:
            return self.cells.select("entity_id", "feature")
        of_each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last))).alias("block")
        every = self.entities().select("entity_id", of_each).join(blocks, "block")
        have = self.known().join(index, "feature").groupBy("entity_id", "block").agg(F.collect_set("feature").alias("have"))
        rest = F.array_except("all", F.coalesce("have", F.array().cast("array<string>")))
        return every.join(have, ["entity_id", "block"], "left").select("entity_id", F.explode(rest).alias("feature"))

    def wide(self, features: Sequence[str] | None = None) -> DataFrame:
        """One row per entity, one column per feature.

        A pivot groups twice, by cell and by entity; dealt out by entity first,
        both find their rows in place and the cells are shuffled once.
        """
        names = list(features) if features is not None else self.features()
        return (
            self.cells.where(F.col("feature").isin(names))
            .repartition("entity_id")
            .groupBy("entity_id")
            .pivot("feature", names)
            .agg(F.first("value", ignorenulls=True))
        )

    def coverage(self) -> DataFrame:
        """Known cells and positive cells per feature."""
        return self.known().groupBy("feature").agg(
            F.count(F.lit(1)).alias("n_known"),
            F.sum(F.when(F.col("value") >= 0.5, 1).otherwise(0)).cast("long").alias("n_positive"),
        )

    def entity_coverage(self) -> DataFrame:
        """Known cells per entity: how well resourced it is."""
        return self.known().groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_known"))

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """Values of the wanted cells, NULL where unknown."""
        return wanted.join(self.known(), KEY, "left")

    def write(self, path: str) -> None:
        """Parquet clustered by feature, so reads of a few features skip the rest."""
        self.cells.hint("rebalance", "feature").sortWithinPartitions(*KEY).write.mode(
            "overwrite"
        ).parquet(path)
