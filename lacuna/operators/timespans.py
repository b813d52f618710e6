"""Interval joins over spans of years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.checkpoints import cut_lineage
from lacuna.functions.intervals import contains_year


_BLOCK_YEARS = 1024
_SIZES = 34
"""Sizes of dyadic intervals, from one year to all years of 32 bits and one more."""
_NODES = "array<struct<size:int,number:bigint>>"


def as_of(records: DataFrame, year: int) -> DataFrame:
    """Records whose timespan contains the year."""
    return records.where(contains_year(F.col("timespan"), F.lit(year)))


def _nodes(start: Column, end: Column) -> Column:
    """The fewest dyadic intervals that cover the closed range, two of a size at most: (size, number) structs.

    A range is taken off at its ends while they do not fill the next larger size; what is
    left in the middle is covered there.
    """

    def step(state: Column, size: Column) -> Column:
        lo, hi, found = state["lo"], state["hi"], state["found"]
        low = F.when((lo <= hi) & (lo % 2 == 1), F.array(F.struct(size.alias("size"), lo.alias("number"))))
        lo = F.when(low.isNotNull(), lo + 1).otherwise(lo)
        high = F.when((lo <= hi) & (hi % 2 == 0), F.array(F.struct(size.alias("size"), hi.alias("number"))))
        hi = F.when(high.isNotNull(), hi - 1).otherwise(hi)
        nothing = F.array().cast(_NODES)
        more = F.concat(found, F.coalesce(low.cast(_NODES), nothing), F.coalesce(high.cast(_NODES), nothing))
        # Numbers at the next size; an empty middle stays empty.
        return F.struct(F.when(lo <= hi, F.shiftright(lo, 1)).otherwise(F.lit(1).cast("long")).alias("lo"),
                        F.when(lo <= hi, F.shiftright(hi, 1)).otherwise(F.lit(0).cast("long")).alias("hi"), more.alias("found"))

    first = F.struct(
        _place(start).alias("lo"), _place(end).alias("hi"), F.array().cast(_NODES).alias("found")
    )
    return F.aggregate(F.sequence(F.lit(0), F.lit(_SIZES - 1)), first, step, lambda state: state["found"])


def _place(year: Column) -> Column:
    return year.cast("long") + (1 << (_SIZES - 2))


def overlap_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of (left_id, right_id) whose closed year ranges overlap.

    Both sides need id, start_year, end_year, any whole years of 32 bits. Of two ranges that overlap, exactly one
    begins within the other, or both begin together: ranges are joined with the begins that lie in them. A range becomes the few dyadic intervals
    that cover it, two of each size at most, and a begin the intervals around it, one of each size that
    ranges have; so rows are bounded by the bits of a year, however long the ranges, and the join is an equi-join
    in which every row is a pair of the result.
    """

    def ranges(df: DataFrame, side: str) -> DataFrame:
        return df.where("start_year <= end_year").select(
            F.col("id").alias(f"{side}_id"), F.explode(_nodes(F.col("start_year"), F.col("end_year"))).alias("node")
        )

    def begins(df: DataFrame, side: str, sizes: list[int]) -> DataFrame:
        place = _place(F.col("start_year"))
        node = F.transform(
            F.array(*[F.lit(s) for s in sizes]), lambda s: F.struct(s.alias("size"), F.call_function("shiftright", place, s).alias("number"))
        )
        return df.where("start_year <= end_year").select(F.col("id").alias(f"{side}_id"), F.explode(node.cast(_NODES)).alias("node"))

    def later(df: DataFrame) -> DataFrame:
        # Begins that are equal were met on the other side.
        return df.withColumn("start_year", F.col("start_year").cast("long") + 1)

    def met(inner: DataFrame, inner_side: str, outer: DataFrame, outer_side: str) -> DataFrame:
        covers = ranges(outer, outer_side)
        sizes = sorted(r[0] for r in covers.select("node.size").distinct().collect())  # one for each bit at most
        return begins(inner, inner_side, sizes or [0]).join(covers, "node").select("left_id", "right_id")

    return met(right, "right", left, "left").unionByName(met(left, "left", later(right), "right"))


def overlap_spans(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of distinct year ranges that overlap, and how many pairs of rows each stands for.

    Equal ranges are folded first, so however many rows share a range, the join
    sees it once; the rows of a range are an equi-join away.
    """

    def folded(df: DataFrame) -> DataFrame:
        ranges = df.groupBy("start_year", "end_year").agg(F.count(F.lit(1)).alias("n"))
        # Stored, as the join reads each side four times.
        return cut_lineage(df.sparkSession, ranges).withColumn("id", F.struct("start_year", "end_year", "n"))

    a, b = F.col("left_id"), F.col("right_id")
    return overlap_pairs(folded(left), folded(right)).select(
        a["start_year"].alias("left_start"), a["end_year"].alias("left_end"),
        b["start_year"].alias("right_start"), b["end_year"].alias("right_end"),
        (a["n"] * b["n"]).alias("n_pairs"),
    )


def overlap_totals(left: DataFrame, right: DataFrame, value: str | None = None) -> DataFrame:
    """``left`` with n_overlaps, how many right ranges overlap each, and with ``value`` the sum of that whole-number column
    over them as ``total``; no pairs are made.

    Right ranges that overlap are those that start by the end of the left one,
    less those that ended before it begins. Both are running totals over the
    distinct years: within blocks of years, and over the totals of the blocks, of which
    there are 2^22 at most for whole-number years. The rest are equi-joins.
    """
    zero, one = F.lit(0), F.lit(1)
    measures = {"n_overlaps": one} | ({"total": F.coalesce(F.col(value), zero)} if value else {})
    ranges = left.where("start_year <= end_year").select("start_year", "end_year").distinct()
    spans = right.where("start_year <= end_year")
    start, end = F.col("start_year").cast("long"), F.col("end_year").cast("long")
    nothing = [zero.cast("long").alias(f"{side}_{m}") for m in measures for side in "se"]

    def at(year: Column, side: str) -> list[Column]:
        return [year.alias("year")] + [
            (v if s == side else zero).cast("long").alias(f"{s}_{m}") for m, v in measures.items() for s in "se"
        ]

    sums = [f"{side}_{m}" for m in measures for side in "se"]
    years = (
        spans.select(*at(start, "s"))
        .unionByName(spans.select(*at(end + 1, "e")))
        .unionByName(ranges.select(end.alias("year"), *nothing))
        .unionByName(ranges.select(start.alias("year"), *nothing))
        .groupBy("year")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
    years = years.withColumn("block", F.floor(F.col("year") / _BLOCK_YEARS))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = years.groupBy("block").agg(*[F.sum(c).alias(c) for c in sums]).select(
        "block", *[F.coalesce(F.sum(c).over(earlier), zero).alias(f"before_{c}") for c in sums]
    )
    within = Window.partitionBy("block").orderBy("year").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = years.select("year", "block", *[F.sum(c).over(within).alias(c) for c in sums]).join(blocks, "block")
    started = totals.select(F.col("year").alias("_end"), *[(F.col(f"before_s_{m}") + F.col(f"s_{m}")).alias(f"_s_{m}") for m in measures])
    ended = totals.select(F.col("year").alias("_start"), *[(F.col(f"before_e_{m}") + F.col(f"e_{m}")).alias(f"_e_{m}") for m in measures])
    return (
        left.where("start_year <= end_year")
        .withColumns({"_start": start, "_end": end})
        .join(started, "_end")
        .join(ended, "_start")
        .select(*left.columns, *[(F.col(f"_s_{m}") - F.col(f"_e_{m}")).cast("long").alias(m) for m in measures])
    )


def overlap_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """For each left range, how many right ranges overlap it."""
    return overlap_totals(left, right)
