"""Distinct counts for every node of a tree, by sketches that merge.

Each place in the tree gets a sketch of the values that lie at it, and sketches are merged upwards: a value is
hashed once, and what travels for a node is a few kilobytes, however many values lie below.
The relative standard error is about 1.04 / sqrt(2^lg_k).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


TASK_ROWS = 500_000
"""Rows of a task, about, whatever the size of the table: they expand to several rows each, which are grouped in memory."""


def tasks(spark: SparkSession, n_rows: int) -> int:
    return max(spark.sparkContext.defaultParallelism, math.ceil(n_rows / TASK_ROWS))


def standard_error(lg_k: int) -> float:
    return 1.04 / math.sqrt(1 << lg_k)


def sketches_by_prefix(rows: DataFrame, value: str, lg_k: int = 12, lineage: str = "lineage") -> DataFrame:
    """(prefix, sketch) for every prefix of the lineages of ``rows``."""
    at_place = rows.where(F.col(value).isNotNull() & F.col(lineage).isNotNull()).groupBy(lineage).agg(
        F.hll_sketch_agg(value, F.lit(lg_k)).alias("sketch")
    )
    prefixes = F.transform(F.sequence(F.lit(1), F.size(lineage)), lambda d: F.slice(F.col(lineage), 1, d))
    up = at_place.where(F.size(lineage) > 0).select(F.explode(prefixes).alias("prefix"), "sketch")
    return up.groupBy("prefix").agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_by_prefix(rows: DataFrame, value: str, lg_k: int = 12, lineage: str = "lineage") -> DataFrame:
    """(prefix, estimate) of the distinct values below each prefix. Null values do not count."""
    found = sketches_by_prefix(rows, value, lg_k, lineage)
    return found.select("prefix", F.hll_sketch_estimate("sketch").alias("estimate"))


def values_by_prefix(rows: DataFrame, value: str, lineage: str = "lineage") -> DataFrame:
    """(prefix, value): every value below a prefix, once. Tasks have a bounded number of rows."""
    spark = rows.sparkSession
    some = rows.where(F.col(value).isNotNull() & (F.size(lineage) > 0)).select(lineage, value)
    n_rows, n_prefixes = some.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(lineage)), F.lit(0))).first()
    prefixes = F.transform(F.sequence(F.lit(1), F.size(lineage)), lambda d: F.slice(F.col(lineage), 1, d))
    pairs = some.repartition(tasks(spark, n_rows), lineage, value).distinct()
    below = pairs.select(F.explode(prefixes).alias("prefix"), value)
    return below.repartition(tasks(spark, n_prefixes), "prefix", value).distinct()


def exact_by_prefix(rows: DataFrame, value: str, lineage: str = "lineage") -> DataFrame:
    """(prefix, n_distinct), with a row for every value below a prefix; for tests and small trees. Reads ``rows`` twice."""
    return values_by_prefix(rows, value, lineage).groupBy("prefix").agg(F.count(F.lit(1)).alias("n_distinct"))
