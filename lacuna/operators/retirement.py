"""Retired codes and their successors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.checkpoints import cut_lineage
from lacuna.functions.refs import remedy_codes


def retirement_targets(records: DataFrame) -> DataFrame:
    """(languoid_id, code, reason, position, target); target NULL if there is none."""
    r = F.col("iso_retirement")
    return records.where(r.isNotNull()).select(
        "languoid_id", r["code"].alias("code"), r["reason"].alias("reason"),
        F.posexplode_outer(r["change_to"]).alias("position", "target"),
    )


def resolve_once(records: DataFrame) -> DataFrame:
    """One hop: targets with the record that carries the code now, if any."""
    now = records.where("iso639_3 IS NOT NULL").select(
        F.col("iso639_3").alias("target"), F.col("languoid_id").alias("target_id")
    )
    return retirement_targets(records).join(now, "target", "left")


def resolve_codes(spark: SparkSession, changes: DataFrame) -> DataFrame:
    """Follow (code, target) edges to codes that are not retired themselves: code, final, hops, status.

    Each round doubles the number of edges a path covers, so a chain of n codes takes log2(n) rounds. ``status``
    is ``current`` for a final code, ``none`` for a retirement without successor. A code from which a path leads into a
    cycle has a row with ``cycle`` and no final code; such paths are found when, after as many
    rounds as the codes allow, they still lead on.
    """
    edges = cut_lineage(spark, changes.select("code", "target").distinct())
    retired = edges.select(F.col("code").alias("target")).distinct().withColumn("leads_on", F.lit(True))
    ends = edges.join(retired, "target", "left").select(
        "code", "target", F.when(F.col("target").isNull(), 0).otherwise(1).alias("hops"),
        F.when(F.col("target").isNull(), "none").when(F.col("leads_on"), "moving").otherwise("current").alias("status"),
    )
    # All paths of 1 edge; then of up to 2, 4, 8 ... edges from a code.
    paths = cut_lineage(spark, ends)
    n_codes, covered = edges.select("code").distinct().count(), 1
    while covered <= n_codes and not paths.where("status = 'moving'").isEmpty():
        onward = paths.select(
            F.col("code").alias("target"), F.col("target").alias("next"), F.col("hops").alias("more"), F.col("status").alias("then")
        )
        moved = paths.where("status = 'moving'").drop("status").join(onward, "target").select(
            "code", F.coalesce("next", "target").alias("target"), (F.col("hops") + F.col("more")).alias("hops"),
            F.col("then").alias("status"),
        )
        # What moves on is cut by its end alone: around a cycle it would else pile up by hops.
        still = moved.where("status = 'moving'").groupBy("code", "target", "status").agg(F.max("hops").alias("hops"))
        settled = paths.where("status <> 'moving'").unionByName(moved.where("status <> 'moving'")).distinct()
        paths = cut_lineage(spark, settled.unionByName(still.select(settled.columns)))
        covered *= 2
    none = F.col("status") == "none"
    done = paths.where("status <> 'moving'").select(
        "code", F.when(~none | (F.col("hops") > 0), F.col("target")).alias("final"), "hops", "status"
    )
    circling = paths.where("status = 'moving'").select("code").distinct().select(
        "code", F.lit(None).cast("string").alias("final"), F.lit(None).cast("int").alias("hops"), F.lit("cycle").alias("status")
    )
    return done.distinct().unionByName(circling)


def arity_report(records: DataFrame) -> DataFrame:
    """Number of successors by reason."""
    n = F.coalesce(F.size("iso_retirement.change_to"), F.lit(0))
    return (
        records.where("iso_retirement IS NOT NULL")
        .select(F.col("iso_retirement.reason").alias("reason"), F.greatest(n, F.lit(0)).alias("n_targets"))
        .groupBy("reason", "n_targets")
        .agg(F.count(F.lit(1)).alias("n_records"))
    )


def remedy_differences(records: DataFrame) -> DataFrame:
    """Retirements whose remedy text names other codes than ``change_to``."""
    named = F.array_distinct(remedy_codes(F.col("iso_retirement.remedy")))
    listed = F.coalesce(F.col("iso_retirement.change_to"), F.array().cast("array<string>"))
    return (
        records.where("iso_retirement.remedy IS NOT NULL")
        .select(
            "languoid_id",
            F.array_sort(F.array_except(named, listed)).alias("only_remedy"),
            F.array_sort(F.array_except(listed, named)).alias("only_change_to"),
        )
        .where("size(only_remedy) + size(only_change_to) > 0")
    )
