"""Trees as nested intervals.

A tour of the tree that visits a node before what lies below it numbers the nodes: ``enter`` is a node's place
in the order of lineages, and ``leave`` the last place below it. A subtree is then one range of ``enter``, and in a table
that is sorted by it a range of few row groups; the rest is never read. Ancestors are the nodes whose
interval holds a place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.checkpoints import stored
from lacuna.operators.ordered import numbered


def with_intervals(nodes: DataFrame) -> DataFrame:
    """``nodes`` (languoid_id, lineage, ...) with ``enter`` and ``leave``, from 0.

    Every node of the tree must be there, those without a record too (``nodes_from_paths``). Numbers come from running
    counts over stored ranges of the lineages; sizes are folded before they are shuffled.
    """
    placed = numbered(nodes, ["lineage"], "enter")
    sizes = nodes.select(F.explode("lineage").alias("languoid_id")).groupBy("languoid_id").agg(F.count("*").alias("_size"))
    return placed.join(sizes, "languoid_id").withColumn("leave", F.col("enter") + F.col("_size") - 1).drop("_size")


class NestedTree:
    """A table of nodes with their intervals, sorted by ``enter``."""

    def __init__(self, table: DataFrame):
        self.table = table

    @staticmethod
    def store(nodes: DataFrame, row_group_bytes: int = 8 << 20) -> NestedTree:
        """Number the nodes and write them in the order of the tour."""
        labelled = with_intervals(nodes)
        spark = nodes.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        in_order = labelled.repartitionByRange(parts, "enter").sortWithinPartitions("enter")
        return NestedTree(stored(spark, in_order, "tree", **{"parquet.block.size": row_group_bytes}))

    def interval(self, node_id: str) -> tuple[int, int] | None:
        row = self.table.where(F.col("languoid_id") == node_id).select("enter", "leave").first()
        return None if row is None else (row["enter"], row["leave"])

    def descendants(self, node_id: str) -> DataFrame:
        """All nodes below a node; the range reaches the scan. A node that is not there has none."""
        enter, leave = self.interval(node_id) or (0, -1)
        return self.table.where((F.col("enter") > enter) & (F.col("enter") <= leave))

    def ancestors(self, node_id: str) -> DataFrame:
        enter, _ = self.interval(node_id) or (-1, -1)
        return self.table.where((F.col("enter") < enter) & (F.col("leave") >= enter))

    def below(self, nodes: DataFrame, id_col: str = "languoid_id") -> DataFrame:
        """(id, below) for many nodes: how many nodes lie below each, from the intervals alone."""
        sizes = self.table.select(F.col("languoid_id").alias(id_col), (F.col("leave") - F.col("enter")).alias("n_below"))
        return nodes.join(sizes, id_col, "left")
