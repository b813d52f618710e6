"""Running values, earlier rows and as-of joins over a global order.

A window without a partition sends all rows to one task, and one by a hot key sends a large
part of them. Here rows are dealt to ranges of (key, order), each small enough for a task, so a key may
span many ranges. A scan has two levels: within a range, by a window, and across ranges, over the totals of the first
and last key of each range, which are twice as many rows as there are ranges. The ranges are stored,
since bounds drawn anew after a loss could differ from those that were counted.

Nulls sort first, in keys and in the order. Rows that tie in key and order come in any order among each other;
name columns enough to tell them apart where that matters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lacuna.checkpoints import cut_lineage

_RANGE, _ORDER, _KEY = "_range", "_order", "_key"


def in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with the number of its range of (``by``, ``order``), stored."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumns(
        {_KEY: F.struct(F.lit(0).alias("all"), *by), _ORDER: F.struct(F.lit(0).alias("all"), *order)}
    )
    return cut_lineage(spark, placed.repartitionByRange(parts, _KEY, _ORDER).withColumn(_RANGE, F.spark_partition_id()))


class Running:
    """A value of a row and all rows before it with the same key."""

    def __init__(self, total: Column, local: Column, carried: Column, merged):
        self.total, self.local, self.carried, self.merged = total, local, carried, merged


def _within() -> WindowSpec:
    return Window.partitionBy(_RANGE, _KEY).orderBy(_ORDER)


def _so_far() -> WindowSpec:
    return _within().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _earlier() -> WindowSpec:
    return Window.partitionBy(_KEY).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)


def running_sum(value: Column) -> Running:
    """Sum so far; null until there is a value."""

    def merged(before: Column, here: Column) -> Column:
        return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(before + here)

    return Running(F.sum(value), F.sum(value).over(_so_far()), F.sum("_total").over(_earlier()), merged)


def running_max(value: Column) -> Running:
    return Running(F.max(value), F.max(value).over(_so_far()), F.max("_total").over(_earlier()), lambda a, b: F.greatest(a, b))


def running_min(value: Column) -> Running:
    return Running(F.min(value), F.min(value).over(_so_far()), F.min("_total").over(_earlier()), lambda a, b: F.least(a, b))


def last_value(value: Column) -> Running:
    """The last value that is not null, this row's included."""
    total = F.max(F.when(value.isNotNull(), F.struct(_ORDER, value.alias("v"))))["v"]
    return Running(
        total, F.last(value, True).over(_so_far()), F.last("_total", True).over(_earlier()), lambda a, b: F.coalesce(b, a)
    )


def previous(value: Column) -> Running:
    """The value of the row before, null or not; null in the first row of a key."""
    total = F.max_by(F.struct(value.alias("v")), F.col(_ORDER))
    local = F.lag(F.struct(value.alias("v"))).over(_within())
    return Running(total, local, F.last("_total", True).over(_earlier()), lambda a, b: F.coalesce(b, a)["v"])


def row_number() -> Running:
    return running_sum(F.lit(1).cast("long"))


def scan(df: DataFrame, order: Sequence[str], values: Mapping[str, Running], by: Sequence[str] = ()) -> DataFrame:
    """``df`` with running values, in the order of ``order`` within each ``by``."""
    return _scan(in_ranges(df, by, order), values).drop(_RANGE, _KEY, _ORDER)


def _scan(ranged: DataFrame, values: Mapping[str, Running]) -> DataFrame:
    names = list(values)
    ends = ranged.groupBy(_RANGE).agg(F.min(_KEY).alias("_first"), F.max(_KEY).alias("_last"))
    # Only the first and the last key of a range can go on in another one.
    at_ends = ranged.join(F.broadcast(ends), _RANGE).where((F.col(_KEY) == F.col("_first")) | (F.col(_KEY) == F.col("_last")))
    totals = at_ends.groupBy(_RANGE, _KEY).agg(*[values[n].total.alias(f"_total_{n}") for n in names])
    # A window function reads the column _total; each value has its own.
    carried = totals
    for n in names:
        carried = carried.withColumn("_total", F.col(f"_total_{n}")).withColumn(f"_carry_{n}", values[n].carried).drop("_total")
    carried = carried.select(_RANGE, _KEY, *[f"_carry_{n}" for n in names])
    local = ranged.withColumns({f"_local_{n}": values[n].local for n in names})
    out = local.join(carried, [_RANGE, _KEY], "left")
    keep = [c for c in ranged.columns if c not in names]
    return out.select(*keep, *[values[n].merged(F.col(f"_carry_{n}"), F.col(f"_local_{n}")).alias(n) for n in names])


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with the place of each row in the order, from 0."""
    return scan(df, order, {name: row_number()}).withColumn(name, F.col(name) - 1)


def as_of_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_at: str, right_at: str, keep: Sequence[str],
    strict: bool = False, ties: Sequence[str] = (),
) -> DataFrame:
    """Every row of ``left`` with the columns ``keep`` of the last row of ``right`` that has its key and is not later.

    With ``strict`` it must be earlier. Of rows of ``right`` with equal times the last by ``ties`` counts. Rows whose key or time is
    null meet nothing, and rows without an earlier one have nulls. A key with any number of rows on either
    side is spread over ranges, and no pairs are made.
    """
    # Earlier rows of the right come before rows of the left at the same time, unless only earlier ones count.
    first, second = (1, 0) if strict else (0, 1)
    key = [F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)]
    keys = [f"_by_{i}" for i in range(len(by))]
    tie = [F.col(c).alias(f"_tie_{i}") for i, c in enumerate(ties)]
    tie_names = [f"_tie_{i}" for i in range(len(ties))]
    at_type = left.schema[left_at].dataType
    r = right.where(F.col(right_at).isNotNull()).select(
        *key, F.col(right_at).cast(at_type).alias("_at"), F.lit(first).alias("_side"), *tie,
        F.struct(*[F.col(c) for c in keep]).alias("_found"),
    )
    for k in keys:
        r = r.where(F.col(k).isNotNull())
    found_type = r.schema["_found"].dataType
    l = left.select(
        *key, F.col(left_at).alias("_at"), F.lit(second).alias("_side"),
        *[F.lit(None).cast(r.schema[t].dataType).alias(t) for t in tie_names],
        F.lit(None).cast(found_type).alias("_found"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"),
    )
    both = r.withColumn("_row", F.lit(None).cast(l.schema["_row"].dataType)).unionByName(l)
    scanned = _scan(in_ranges(both, keys, ["_at", "_side", *tie_names]), {"_last": last_value(F.col("_found"))})
    usable = F.col("_at").isNotNull()
    for k in keys:
        usable &= F.col(k).isNotNull()
    last = F.when(usable, F.col("_last"))
    return scanned.where(F.col("_row").isNotNull()).select("_row.*", *[last[c].alias(c) for c in keep])


def range_sum(df: DataFrame, value: str, at: str, width, name: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same key whose ``at`` lies in [at - width, at].

    ``width`` is what is taken off ``at``: a number or an interval column. It is the difference of two running sums, so ``value``
    should be exact (a long or a decimal). A row whose ``at`` is null has a null sum.
    """
    keys = [f"_g_{i}" for i in range(len(by))]
    width = width if isinstance(width, Column) else F.lit(width)
    # A struct is a key even where the column in it is null.
    sums = df.where(F.col(at).isNotNull()).groupBy(
        *[F.struct(F.col(c).alias("k")).alias(k) for c, k in zip(by, keys)], F.col(at).alias("_x")
    ).agg(F.sum(value).alias("_v"))
    so_far = scan(sums, ["_x"], {"_sum": running_sum(F.col("_v"))}, keys).withColumn("_from", F.col("_x") - width)
    so_far = cut_lineage(df.sparkSession, so_far)
    earlier = so_far.select(*keys, F.col("_x").alias("_earlier"), F.col("_sum").alias("_before"))
    ended = as_of_join(so_far, earlier, keys, "_from", "_earlier", ["_before"], strict=True)
    total = (F.col("_sum") - F.coalesce("_before", F.lit(0))).alias(name)
    sums_at = ended.select(*keys, "_x", total)
    on = F.col(at) == F.col("_x")
    for c, k in zip(by, keys):
        on &= F.struct(F.col(c).alias("k")) == F.col(k)
    return df.join(sums_at, on, "left").select(*[df[c] for c in df.columns], name)
