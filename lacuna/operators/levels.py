"""Levels of nodes: the nesting rules, and the levels of nodes without a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ordered levels.
LEVEL_ORDINAL = {"family": 1, "language": 2, "dialect": 3}


def level_ordinal(level: Column) -> Column:
    ranks = F.create_map(*[F.lit(v) for kv in LEVEL_ORDINAL.items() for v in kv])
    return F.try_element_at(ranks, level)


def level_violations(records: DataFrame) -> DataFrame:
    """Nodes that break a nesting rule, one row per broken rule.

    Parents whose record is missing break no rule that needs their level.
    """
    parents = records.select(
        F.col("languoid_id").alias("parent_id"), F.col("level").alias("parent_level")
    )
    level, parent = F.col("level"), F.col("parent_level")
    broken = F.array_compact(
        F.array(
            F.when(
                (level == "dialect") & F.col("parent_id").isNull(), "top-level dialect"
            ),
            F.when((level == "dialect") & (parent == "family"), "dialect under family"),
            F.when(
                (level == "language") & parent.isNotNull() & (parent != "family"),
                "language not under family",
            ),
            F.when(level_ordinal(level) < level_ordinal(parent), "level above its parent"),
        )
    )
    # Roots have no parent to look up, and would all be one key.
    rows = records.select("languoid_id", "parent_id", "level")
    roots = rows.where("parent_id IS NULL").withColumn("parent_level", F.lit(None).cast("string"))
    below = rows.where("parent_id IS NOT NULL").join(parents, "parent_id", "left")
    return (
        below.unionByName(roots)
        .select("languoid_id", "level", "parent_level", F.explode(broken).alias("rule"))
    )


def infer_levels(nodes: DataFrame) -> DataFrame:
    """Levels of nodes without a record, as far as the nesting rules settle them.

    A path from the root reads families, then at most one language, then
    dialects. So a node above a family or language is a family; a node below a
    language or dialect is a dialect; and a node that is a root or sits under a
    family, and has a dialect child, is a language, which makes the nodes below
    it dialects. These steps settle everything the rules can settle, hence no
    fixpoint loop.

    ``nodes`` needs lineage, languoid_id, parent_id, level (NULL = unknown).
    Returns all nodes with ``inferred_level``; undetermined ones keep NULL.
    """
    known = nodes.where("level IS NOT NULL").select("languoid_id", "parent_id", "lineage", "level")
    above_language = (
        known.where(F.col("level").isin("family", "language"))
        .select(F.explode(F.slice("lineage", 1, F.size("lineage") - 1)).alias("languoid_id"))
        .distinct()
        .withColumn("family_below", F.lit(True))
    )
    unknown = nodes.where("level IS NULL").select("languoid_id", "parent_id", "lineage")
    unknown_ancestors = unknown.select(
        "languoid_id", F.explode(F.slice("lineage", 1, F.size("lineage") - 1)).alias("ancestor_id")
    )

    def below(anchors: DataFrame) -> DataFrame:
        """Unknown nodes with one of the anchors among their ancestors."""
        return (
            unknown_ancestors.join(
                anchors.select(F.col("languoid_id").alias("ancestor_id")), "ancestor_id", "left_semi"
            )
            .select("languoid_id")
            .distinct()
        )

    deep = known.where(F.col("level").isin("language", "dialect"))
    first = (
        unknown.join(above_language, "languoid_id", "left")
        .join(below(deep).withColumn("language_above", F.lit(True)), "languoid_id", "left")
        .withColumn(
            "level",
            F.when(F.col("family_below"), "family").when(F.col("language_above"), "dialect"),
        )
        .select("languoid_id", "parent_id", "lineage", "level")
    )
    settled = first.unionByName(known)
    dialect_parents = (
        settled.where(F.col("level") == "dialect")
        .select(F.col("parent_id").alias("languoid_id"))
        .distinct()
    )
    families = settled.where(F.col("level") == "family").select(
        F.col("languoid_id").alias("parent_id"), F.lit(True).alias("under_family")
    )
    languages = (
        first.where("level IS NULL")
        .join(dialect_parents, "languoid_id", "left_semi")
        .join(families, "parent_id", "left")
        .where(F.col("under_family") | F.col("parent_id").isNull())
        .select("languoid_id")
    )
    found = languages.withColumn("late", F.lit("language")).unionByName(
        below(languages).withColumn("late", F.lit("dialect"))
    )
    inferred = (
        first.select("languoid_id", F.col("level").alias("early"))
        .join(found, "languoid_id", "left")
        .select("languoid_id", F.coalesce("early", "late").alias("found_level"))
    )
    return nodes.join(inferred, "languoid_id", "left").select(
        *nodes.columns, F.coalesce("level", "found_level").alias("inferred_level")
    )
