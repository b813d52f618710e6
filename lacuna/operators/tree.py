"""Tree operators on lineage arrays.

A node's lineage holds all its ancestors, so closure, common ancestors and
distances need no recursion, and nodes without a record still count.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.sources.catalog import with_lineage


def nodes_from_paths(records: DataFrame, *keep: str) -> DataFrame:
    """Every prefix of every lineage is a node; ``has_record`` tells if it has a file.

    ``keep`` names record columns to carry along, NULL for nodes without a file.
    Each record emits one row per ancestor, and the partial aggregation folds
    the many copies of a big root before the shuffle.
    """
    prefixes = records.select(
        *keep,
        "lineage",
        F.explode(F.sequence(F.lit(1), F.size("lineage"))).alias("_d"),
    )
    own = F.col("_d") == F.size("lineage")
    nodes = prefixes.groupBy(F.slice("lineage", 1, F.col("_d")).alias("_node")).agg(
        F.max(own).alias("has_record"), *[F.max(F.when(own, F.col(c))).alias(c) for c in keep]
    )
    return with_lineage(nodes.withColumnRenamed("_node", "lineage"))


def closure(records: DataFrame, include_self: bool = True) -> DataFrame:
    """(languoid_id, ancestor_id, distance) for every ancestor."""
    pairs = records.select(
        "languoid_id", F.size("lineage").alias("depth"), F.posexplode("lineage").alias("pos", "ancestor_id")
    ).select("languoid_id", "ancestor_id", (F.col("depth") - 1 - F.col("pos")).alias("distance"))
    return pairs if include_self else pairs.where("distance > 0")


def descendants(records: DataFrame, ancestor_id: str) -> DataFrame:
    """Records below a node, found by a scan alone."""
    return records.where(
        F.array_contains("lineage", ancestor_id) & (F.col("languoid_id") != ancestor_id)
    )


def ancestors(records: DataFrame, languoid_id: str) -> DataFrame:
    return closure(records.where(F.col("languoid_id") == languoid_id), include_self=False)


def common_depth(a: Column, b: Column) -> Column:
    """Length of the shared prefix of two lineages."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_difference = F.array_position(same, False)
    return F.when(first_difference == 0, F.size(same)).otherwise(first_difference - 1).cast("int")


def lowest_common_ancestor(a: Column, b: Column) -> Column:
    """NULL for nodes under different roots."""
    d = common_depth(a, b)
    return F.when(d > 0, F.try_element_at(a, F.greatest(d, F.lit(1))))


def tree_distance(a: Column, b: Column) -> Column:
    """Edges between two nodes; roots hang under a virtual common root of depth 0."""
    return (F.size(a) + F.size(b) - 2 * common_depth(a, b)).cast("int")


def isolates(records: DataFrame) -> DataFrame:
    """Languages at the top of the tree."""
    return records.where((F.col("depth") == 1) & (F.col("level") == "language"))


def exclude_roots(records: DataFrame, root_ids: Iterable[str]) -> DataFrame:
    """Leave out trees that are no families, such as bookkeeping."""
    return records.where(~F.col("top_id").isin(list(root_ids)))


def family_rollup(records: DataFrame) -> DataFrame:
    """Counts per top-level node; a family's area comes from its descendants."""

    def count_if(condition: Column) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0)).cast("long")

    return records.groupBy("top_id").agg(
        F.count(F.lit(1)).alias("n_records"),
        count_if(F.col("level") == "family").alias("n_families"),
        count_if(F.col("level") == "language").alias("n_languages"),
        count_if(F.col("level") == "dialect").alias("n_dialects"),
        F.max("depth").alias("max_depth"),
    )


def family_areas(records: DataFrame) -> DataFrame:
    """Languages by (family, area)."""
    return (
        records.where(F.col("level") == "language")
        .select("top_id", F.explode_outer("macroareas").alias("area"))
        .groupBy("top_id", "area")
        .agg(F.count(F.lit(1)).alias("n_languages"))
    )


def family_statuses(records: DataFrame) -> DataFrame:
    """Records by (family, endangerment status)."""
    return (
        records.where(F.col("endangerment.status").isNotNull())
        .groupBy("top_id", F.col("endangerment.status").alias("status"))
        .agg(F.count(F.lit(1)).alias("n_records"))
    )
