"""What changed between two releases of a catalogue.

Every record has a digest, and every node the sum of the digests of all records at and below it, in two
64-bit parts; sums need one pass, however deep the tree. Two releases are compared from the roots down, and only
below nodes whose sums differ, so what is read grows with the changes and not with the catalogue.
Digests of two different subtrees agree by chance with a probability of about 2^-128.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.checkpoints import cut_lineage, stored


def subtree_digests(records: DataFrame, content: Sequence[str]) -> DataFrame:
    """(lineage, parent, depth, own, below) of every node of ``records`` (lineage, content); ``own`` is NULL without a record.

    Columns are told apart from each other and nulls from texts. A node with several records has the sum of theirs.
    """
    text = F.to_json(F.struct(F.col("lineage"), *[F.col(c) for c in content]), {"ignoreNullFields": "false"})
    rows = records.where(F.col("lineage").isNotNull() & (F.size("lineage") > 0))
    parts = rows.select("lineage", F.xxhash64(text).alias("a"), F.xxhash64(text, F.lit("second")).alias("b"))
    up = parts.select("a", "b", F.size("lineage").alias("own_depth"), "lineage", F.explode(F.sequence(F.lit(1), F.size("lineage"))).alias("depth"))
    up = up.groupBy(F.slice("lineage", 1, F.col("depth")).alias("node"), "depth")
    here = F.col("own_depth") == F.col("depth")
    wide = "decimal(38,0)"
    sums = up.agg(
        *[F.sum(F.when(here, F.col(c)).cast(wide)).alias(f"own_{c}") for c in ("a", "b")],
        *[F.sum(F.col(c).cast(wide)).alias(f"below_{c}") for c in ("a", "b")],
    )
    return sums.select(
        F.col("node").alias("lineage"), F.slice("node", 1, F.col("depth") - 1).alias("parent"), "depth",
        F.when(F.col("own_a").isNotNull(), F.struct("own_a", "own_b")).alias("own"), F.struct("below_a", "below_b").alias("below"),
    )


@dataclass
class ReleaseDiff:
    """``changes`` (languoid_id, change, old_lineage, new_lineage), and how many digests were compared for them."""

    changes: DataFrame
    compared: int


def store_digests(records: DataFrame, content: Sequence[str]) -> DataFrame:
    """Digests of a release, stored by depth and parent, as :func:`compare` reads them."""
    found = subtree_digests(records, content)
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = found.repartitionByRange(parts, "depth", "parent").sortWithinPartitions("depth", "parent")
    return stored(records.sparkSession, in_order, "digests")


def compare(old: DataFrame, new: DataFrame) -> ReleaseDiff:
    """Added, removed, moved and changed records, from the digests of two releases.

    A record whose id is in both releases in different places is moved, whatever else changed in it. Each
    round joins one level of both releases below the nodes that differ one level up.
    """
    spark = old.sparkSession

    def level(side: DataFrame, depth: int, above: DataFrame | None) -> DataFrame:
        here = side.where(F.col("depth") == depth)
        return here if above is None else here.join(above.select(F.col("lineage").alias("parent")), "parent", "left_semi")

    found, above, depth, compared = [], None, 0, 0
    while True:
        depth += 1
        sides = [
            level(side, depth, above).select("lineage", F.col("own").alias(f"{n}_own"), F.col("below").alias(f"{n}_below"))
            for side, n in ((old, "old"), (new, "new"))
        ]
        both = cut_lineage(spark, sides[0].join(sides[1], "lineage", "full"))
        compared += both.count()
        above = both.where(~F.col("old_below").eqNullSafe(F.col("new_below")))
        if above.isEmpty():
            break
        found.append(above.where(~F.col("old_own").eqNullSafe(F.col("new_own"))).select("lineage", "old_own", "new_own"))
    if not found:
        found = [both.where("false").select("lineage", "old_own", "new_own")]
    own = reduce(DataFrame.unionByName, found)
    # At most one place of an id in each release: an id in two places is added here and removed there.
    by_id = own.groupBy(F.element_at("lineage", -1).alias("languoid_id")).agg(
        F.max(F.when(F.col("old_own").isNotNull(), F.col("lineage"))).alias("old_lineage"),
        F.max(F.when(F.col("new_own").isNotNull(), F.col("lineage"))).alias("new_lineage"),
    )
    change = (
        F.when(F.col("old_lineage").isNull(), "added").when(F.col("new_lineage").isNull(), "removed")
        .when(F.col("old_lineage") == F.col("new_lineage"), "changed").otherwise("moved")
    )
    return ReleaseDiff(by_id.select("languoid_id", change.alias("change"), "old_lineage", "new_lineage"), compared)
