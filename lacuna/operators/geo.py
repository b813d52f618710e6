"""Distances and nearest places on the globe.

The nearest-place search works on cubes around the unit sphere, from one cube for
everything down to cubes of a few hundred metres, so neither the poles nor the
date line are special. For every cube the number of its places is known.

A query takes the smallest cube around it that holds more than k places; any k + 1
of those bound how far the search has to reach. Cubes within the reach are looked
up by key, and those that hold many places are replaced by their parts that
are still within reach, which shortens the reach as well. Only then are places
compared. So neither a crowded region nor a query far from everything turns into
all pairs, and no result is cut off.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.checkpoints import cut_lineage
from lacuna.functions.geo import haversine_km

_LEVELS = 16
TASK_PAIRS = 1_000_000
"""Pairs of a query and a place that a task compares, about."""
_AXES = ("x", "y", "z")


def _on_sphere(df: DataFrame) -> DataFrame:
    lat, lon = F.radians("lat"), F.radians("lon")
    return df.withColumns(
        {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    )


def _scale(level: Column) -> Column:
    """Cubes of a level per unit length. Kept as a column, as every formula below needs it."""
    return F.pow(F.lit(2.0), level - 1)


def _cube(coordinate: Column) -> Column:
    """Index of a coordinate in [-1, 1] along an axis."""
    index = F.floor((coordinate + 1) * F.col("scale"))
    return F.least(F.greatest(index, F.lit(0)), (F.col("scale") * 2 - 1).cast("long"))


def _all_levels(df: DataFrame) -> DataFrame:
    leveled = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS))).alias("cube_level"))
    scaled = leveled.withColumn("scale", _scale(F.col("cube_level")))
    return scaled.withColumns({f"c{a}": _cube(F.col(a)) for a in _AXES}).drop("scale")


def _offsets(df: DataFrame) -> DataFrame:
    """Add the distance from (x, y, z) to the cube along each axis, below 0 inside it, to either side."""
    scaled = df.withColumns({"scale": _scale(F.col("cube_level"))})
    low = {a: F.col(f"c{a}") / F.col("scale") - 1 for a in _AXES}
    return scaled.withColumns(
        {
            **{f"b{a}": low[a] - F.col(a) for a in _AXES},
            **{f"e{a}": F.col(a) - low[a] - 1 / F.col("scale") for a in _AXES},
        }
    )


def _with_chords(df: DataFrame) -> DataFrame:
    """Add ``near`` and ``far``, the shortest and longest distance from (x, y, z) to the cube."""
    near = sum((F.pow(F.greatest(f"b{a}", f"e{a}", F.lit(0.0)), 2) for a in _AXES), F.lit(0.0))
    far = sum((F.pow(F.greatest(F.abs(f"b{a}"), F.abs(f"e{a}")), 2) for a in _AXES), F.lit(0.0))
    return (
        _offsets(df)
        .withColumns({"near": F.sqrt(near), "far": F.sqrt(far)})
        .drop("scale", *(f"{side}{a}" for side in "be" for a in _AXES))
    )


def _within_reach(df: DataFrame, level: Column, inside: bool = False) -> DataFrame:
    """One row per cube of ``level`` that the reach may touch, with ``inside`` only parts of the row's cube."""
    out = df.withColumn("_level", level)
    out = out.withColumns(
        {"scale": _scale(F.col("_level")), "_parts": F.pow(F.lit(2.0), F.col("_level") - F.col("cube_level")).cast("long")}
    )
    for a in _AXES:
        low, high = _cube(F.col(a) - F.col("reach")), _cube(F.col(a) + F.col("reach"))
        if inside:
            first = F.col(f"c{a}") * F.col("_parts")
            low, high = F.greatest(low, first), F.least(high, first + F.col("_parts") - 1)
        out = out.withColumns({f"_low{a}": low, f"_high{a}": high})
    for a in _AXES:
        out = out.where(F.col(f"_low{a}") <= F.col(f"_high{a}")).withColumn(
            f"c{a}", F.explode(F.sequence(f"_low{a}", f"_high{a}"))
        )
    return out.withColumn("cube_level", F.col("_level")).drop(
        "_level", "_parts", "scale", *(f"_low{a}" for a in _AXES), *(f"_high{a}" for a in _AXES)
    )


def _dealt(asking: DataFrame, spots: DataFrame, cubes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Queries (lat, lon, cube, ``n`` places in it) and places, dealt by cube to as many tasks as the pairs of the two need.

    A cube with more pairs than a task takes is dealt by ``part``: its queries to one of them, its places to all.
    """
    spark = asking.sparkSession
    load = cut_lineage(spark, asking.groupBy(*cubes).agg(F.sum("n").alias("pairs")))
    pairs = load.agg(F.sum("pairs")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(pairs / TASK_PAIRS))
    parts = load.select(*cubes, F.ceil(F.col("pairs") / TASK_PAIRS).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("lat", "lon"), F.col("parts")).cast("int"), F.lit(0)).alias("part")
    to_one = asking.join(parts.where("parts > 1"), cubes, "left").select("lat", "lon", *cubes, part)
    to_all = spots.join(parts, cubes).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return to_one.repartition(tasks, *cubes, "part"), to_all.repartition(tasks, *cubes, "part")


def nearest_places(
    queries: DataFrame, places: DataFrame, k: int, cube_places: int = 64
) -> DataFrame:
    """(id, rank, neighbour_id, distance_km): the k places nearest to each query.

    Both inputs have id, lat, lon. A place with the query's own id is no neighbour.
    Distances are compared to the millimetre; ties go to the smaller id. Places at
    the same coordinates are searched once, with the k + 1 smallest ids. Cubes with
    more than ``cube_places`` places are taken apart.
    """
    spark = queries.sparkSession
    cubes = ["cube_level", *(f"c{a}" for a in _AXES)]
    query = ["lat", "lon", *_AXES]
    level = F.col("cube_level")
    have = "lat IS NOT NULL AND lon IS NOT NULL"
    same_spot = Window.partitionBy("lat", "lon").orderBy("id")
    spots = _on_sphere(
        places.where(have)
        .select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
        .withColumn("copy", F.row_number().over(same_spot))
        .where(F.col("copy") <= k + 1)
        .drop("copy")
    )
    asked = queries.where(have).select(
        "id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")
    )
    origins = _on_sphere(asked.select("lat", "lon").distinct())
    leveled = _all_levels(spots)
    counts = cut_lineage(spark, leveled.groupBy(*cubes).agg(F.count(F.lit(1)).alias("n")))

    # The reach: the farthest point of the smallest own cube with more than k places.
    own = (
        _all_levels(origins)
        .join(counts.where((F.col("n") > k) | (level == 0)), cubes)
        .groupBy(*query)
        .agg(F.max(F.struct("cube_level", "cx", "cy", "cz", "n")).alias("own"))
        .select(*query, "own.*")
    )
    # A margin covers rounding. Fewer places than asked for means that there are no more.
    farthest = F.when(F.col("n") > k, F.col("far") + 1e-8).otherwise(2.0)
    # Each query turns into many rows from here on. A named number of partitions is
    # not merged for being small now.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = cut_lineage(
        spark,
        _with_chords(own).withColumn("reach", farthest).drop("n", "near", "far")
        .repartition(partitions, "lat", "lon"),
    )
    fitting = F.greatest(F.lit(0), F.least(F.lit(_LEVELS), F.floor(F.log2(4.0 / F.col("reach"))).cast("int")))
    frontier = _within_reach(own, fitting)

    by_query = Window.partitionBy("lat", "lon")
    nearest_first = by_query.orderBy("far").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    settled = []
    while True:
        frontier = cut_lineage(
            spark,
            _with_chords(frontier.join(counts, cubes))
            .where(F.col("near") <= F.col("reach"))
            .withColumn("seen", F.sum("n").over(nearest_first))
            .withColumn("bound", F.min(F.when(F.col("seen") > k, F.col("far") + 1e-8)).over(by_query))
            .withColumn("reach", F.least("reach", "bound"))
            .where(F.col("near") <= F.col("reach"))
            .select(*query, "reach", *cubes, "n"),
        )
        large = (F.col("n") > cube_places) & (level < _LEVELS)
        settled.append(frontier.where(~large).select("lat", "lon", *cubes, "n"))
        if frontier.where(large).isEmpty():
            break
        finer = F.least(level + 2, F.lit(_LEVELS))
        frontier = _within_reach(frontier.where(large).drop("n"), finer, inside=True)

    spot = leveled.select(
        F.col("id").alias("neighbour_id"), F.col("lat").alias("nlat"), F.col("lon").alias("nlon"), *cubes
    )
    km = F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("nlat"), F.col("nlon")), 6)
    by_spot = Window.partitionBy("lat", "lon").orderBy("distance_km", "neighbour_id")
    asking, held = _dealt(reduce(DataFrame.unionByName, settled), spot, cubes)
    best = (
        asking.join(held, [*cubes, "part"])
        .select("lat", "lon", "neighbour_id", km.alias("distance_km"))
        .withColumn("rank", F.row_number().over(by_spot))
        .where(F.col("rank") <= k + 1)
        .drop("rank")
    )
    by_id = Window.partitionBy("id").orderBy("distance_km", "neighbour_id")
    return (
        asked.join(best, ["lat", "lon"])
        .where(F.col("id") != F.col("neighbour_id"))
        .withColumn("rank", F.row_number().over(by_id))
        .where(F.col("rank") <= k)
        .select("id", "rank", "neighbour_id", "distance_km")
    )


def distances(pairs: DataFrame, places: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """Great-circle distance of given pairs of ids; NULL where a place is unknown."""
    p = places.select("id", "lat", "lon")
    a = p.toDF(left, "lat1", "lon1")
    b = p.toDF(right, "lat2", "lon2")
    km = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return (
        pairs.join(a, left, "left").join(b, right, "left")
        .select(*pairs.columns, km.alias("distance_km"))
    )
