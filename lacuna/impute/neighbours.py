"""k nearest neighbours over the commonly known features.

The distance of two entities is the mean squared difference over the features
both know (for 0/1 values the share of mismatches), scaled and floored to an
whole number, which takes up rounding. Neighbours of a cell are the k nearest
entities that know its feature, ties by entity id. Distances use known cells
only, so a target never counts towards its own prediction.

An exact search compares every pattern with every entity. What keeps that
workable:

* Entities with equal known cells share a pattern. They miss the same features,
  so they are never each other's neighbours, and each pattern is searched once
  and contributes at most k entities. Copies cost nothing.
* Entities are packed into blocks of bounded bytes, and blocks make up sections; values of 0 and 1 are packed
  as bits, so a section holds many blocks. Patterns are dealt to parts. Each part and section is one group of
  some rows with matrices, so the work splits evenly over tasks of fixed memory.
* Once a query has k rows for each of its cells, their greatest distance is a bound, and a product of
  matrices tells which rows of the rest may be below it. Only those are looked at one by one.
* A part and section yield k candidates per target; pairs of entities never leave
  the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.checkpoints import cut_lineage
from lacuna.impute.baselines import MeanImputer
from lacuna.impute.common import (
    entity_rows,
    entity_type,
    feature_index,
    known_cells,
    prediction_columns,
)
from lacuna.kb.knowledge_base import KEY

_TILE_CELLS = 1_000_000
_TILE_ROWS = 4096
_RARE = 4
"""A feature that fewer than so many times k rows know is rare."""
_MOST_TASKS = 100_000
_PAIRS_OF_BLOCKS = 4
"""How many pairs of blocks of bits a task compares: a pair takes a second or two."""


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, item) of the items of all lists."""
    lists = lists.combine_chunks()
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), counts), lists.flatten().to_numpy(zero_copy_only=False)


def _pack(n_features: int, binary: bool):
    """Rows (block, id, i, v, need) to one row with a matrix: bits of known cells and of ones, or numbers."""

    def pack(rows: pa.Table) -> pa.Table:
        shape = rows.num_rows, n_features
        (row, column), values = _flat(rows["i"]), _flat(rows["v"])[1]
        if binary:
            known, ones = np.zeros(shape, bool), np.zeros(shape, bool)
            known[row, column] = True
            ones[row, column] = values != 0
            data = np.hstack([np.packbits(known, axis=1), np.packbits(ones, axis=1)])
        else:
            data = np.full(shape, np.nan)
            data[row, column] = values
        need = np.zeros(shape, bool)
        need[_flat(rows["need"])] = True
        ids = rows["id"].combine_chunks()
        return pa.table(
            {
                "block": rows["block"].slice(0, 1),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                "data": pa.array([data.tobytes()], pa.binary()),
                "need": pa.array([np.packbits(need, axis=1).tobytes()], pa.binary()),
            }
        )

    return pack


@dataclass(frozen=True)
class _Rows:
    """Packed rows: bits of known cells and of ones beside each other, or numbers."""

    data: np.ndarray
    n_features: int
    binary: bool

    @staticmethod
    def of(packed: pa.ChunkedArray, n_features: int, binary: bool) -> _Rows:
        kind, width = (np.uint8, 2 * math.ceil(n_features / 8)) if binary else (np.float64, n_features)
        parts = [np.frombuffer(x.as_buffer(), kind).reshape(-1, width) for x in packed]
        return _Rows(np.concatenate(parts), n_features, binary)

    def part(self, rows: np.ndarray | slice) -> _Rows:
        return _Rows(self.data[rows], self.n_features, self.binary)

    def _bits(self) -> tuple[np.ndarray, np.ndarray]:
        half = self.data.shape[1] // 2
        return self.data[:, :half], self.data[:, half:]

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """(known, value), with any value where it is not known."""
        if not self.binary:
            return ~np.isnan(self.data), self.data
        known, ones = (np.unpackbits(x, axis=1, count=self.n_features).astype(bool) for x in self._bits())
        return known, ones

    def dense(self) -> np.ndarray:
        known, values = self.cells()
        return np.where(known, values, np.nan) if self.binary else values

    def distances(self, other: _Rows, scale: int) -> np.ndarray:
        """Of rows of bits, one by one."""
        (known, ones), (known_too, ones_too) = self._bits(), other._bits()
        both = known & known_too
        common = np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        squares = np.bitwise_count((ones ^ ones_too) & both).sum(axis=1, dtype=np.float64)
        return np.where(common > 0, np.floor(squares * scale / np.maximum(common, 1.0)), np.inf)


def _first(distance: np.ndarray, count: int) -> np.ndarray:
    """Columns of the ``count`` least of each row, in order; of equal ones those further left."""
    if count < distance.shape[1]:
        edge = np.partition(distance, count - 1, axis=1)[:, count - 1 : count]
        below, level = distance < edge, distance == edge
        room = count - below.sum(axis=1, keepdims=True)
        chosen = below | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= room))
        columns = np.nonzero(chosen)[1].reshape(len(distance), count)
    else:
        columns = np.broadcast_to(np.arange(distance.shape[1]), distance.shape)
    order = np.argsort(np.take_along_axis(distance, columns, axis=1), axis=1, kind="stable")
    return np.take_along_axis(columns, order, axis=1)


def nearest_in_block(
    query: np.ndarray, need: np.ndarray, block: np.ndarray, k: int, scale: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, feature, distance, block row) of the k nearest per needed cell.

    Missing values are NaN. Rows of the block are in tie order.
    """
    n, n_features = block.shape
    known = ~np.isnan(block)
    values = np.nan_to_num(block)
    known_f = known.astype(np.float64)
    shortlist = min(n, max(8 * k, 64))
    step = max(1, min(_TILE_CELLS // n, 2 * _TILE_CELLS // (shortlist * n_features)))
    for start in range(0, len(query), step):
        part, wanted = query[start : start + step], need[start : start + step]
        q_known = (~np.isnan(part)).astype(np.float64)
        q = np.nan_to_num(part)
        common = q_known @ known_f.T
        squares = (q * q) @ known_f.T + q_known @ (values * values).T - 2.0 * (q @ values.T)
        np.maximum(squares, 0.0, out=squares)
        distance = np.where(common > 0, np.floor(squares * scale / np.maximum(common, 1.0)), np.inf)

        # Nearest rows once per query; enough for every feature most rows know.
        top = _first(distance, shortlist)
        real = np.isfinite(np.take_along_axis(distance, top, axis=1))
        usable = known[top] & real[:, :, None]
        running = np.cumsum(usable, axis=1, dtype=np.int32)
        complete = (running[:, -1, :] >= k) | (shortlist == n)
        chosen = usable & (running <= k) & (wanted & complete)[:, None, :]
        row, rank, feature = np.nonzero(chosen)
        column = top[row, rank]
        yield row + start, feature, distance[row, column], column

        # The rest are looked up among all rows of the block that know the feature.
        open_cells = wanted & ~complete
        for f in np.nonzero(open_cells.any(axis=0))[0]:
            rows = np.nonzero(open_cells[:, f])[0]
            cols = np.nonzero(known[:, f])[0]
            if not len(cols):
                continue
            sub = distance[np.ix_(rows, cols)]
            best = _first(sub, min(k, len(cols)))
            r, c = np.nonzero(np.isfinite(np.take_along_axis(sub, best, axis=1)))
            place = best[r, c]
            yield rows[r] + start, np.full(len(r), f), sub[r, place], cols[place]


def _chosen(
    row: np.ndarray, known: np.ndarray, need: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of (query row, distance, place): the features for which each is one of the first k, and its number there."""
    # A feature's rows lie side by side.
    usable = np.ascontiguousarray((known & need[row]).T)
    number = np.cumsum(usable, axis=1, dtype=np.int32)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    number -= np.repeat(number[:, first] - usable[:, first], np.diff(first, append=len(row)), axis=1)
    return (usable & (number <= k)).T, number.T


class _Search:
    """The nearest rows of a section for each query row, tile by tile in the order of the ids.

    A query whose wanted cells have k rows each has a bound, the greatest distance among those, and only rows below it can be of
    use: one product of matrices tells all pairs that may be, and those few are compared exactly. Of rows at the bound an
    earlier one goes before. All rows that know a feature that few know are looked at first, and it has no part in the bound.
    Queries without a bound, and numbers other than 0 and 1, are compared whole.
    """

    def __init__(self, queries: _Rows, need: np.ndarray, rows: _Rows, k: int, scale: int):
        self.queries, self.need, self.rows, self.k, self.scale = queries, need, rows, k, scale
        self.bound = np.full(len(need), np.inf)
        self.rare = np.zeros(rows.n_features, bool)
        none = np.zeros(0, np.int64)
        self.found = [(none, none, np.zeros(0))]
        n_features = rows.n_features
        self.kind = np.float32 if n_features <= 128 else np.float64
        # More than a sum of 2 n products of at most 1 can be wrong by, twice.
        self.slack = 4.0 * n_features**2 * np.finfo(self.kind).eps
        self.step = max(64, min(_TILE_ROWS, 2 * _TILE_CELLS // n_features))
        # Queries at once, so that a product stays in a core's cache.
        self.queries_at_once = 256

    def _by_row(self) -> list[slice]:
        """Cuts of what was found, at query rows, with a bounded number of cells or of one row."""
        row = self.found[0][0]
        most, cuts, at = max(1, 4 * _TILE_CELLS // self.rows.n_features), [], 0
        while at < len(row):
            end = min(len(row), at + most)
            if end < len(row):
                end = int(np.searchsorted(row, row[end]))
                end = end if end > at else int(np.searchsorted(row, row[at], side="right"))
            cuts.append(slice(at, end))
            at = end
        return cuts

    def _sort(self) -> None:
        row, place, distance = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((place, distance, row))
        row, place, distance = row[order], place[order], distance[order]
        once = (np.diff(row, prepend=-1) != 0) | (np.diff(place, prepend=-1) != 0)
        self.found = [(row[once], place[once], distance[once])]

    def _trim(self, seen: int) -> None:
        """Leave only rows among the k of a wanted cell, and find the bounds by the rows in tiles seen, which go before those of tiles to come."""
        self._sort()
        kept = []
        for s in self._by_row():
            row, place, distance = (x[s] for x in self.found[0])
            known = self.rows.part(place).cells()[0]
            chosen, number = _chosen(row, known, self.need, self.k)
            use = chosen.any(axis=1)
            kept.append((row[use], place[use], distance[use]))
            past = place < seen
            if not past.all():
                row, distance = row[past], distance[past]
                chosen, number = _chosen(row, known[past], self.need, self.k)
            if self.rows.binary and len(row):
                last = np.flatnonzero(np.diff(row, append=-1))
                whole = ((number[last] >= self.k) | ~self.need[row[last]] | self.rare).all(axis=1)
                ends = (chosen & (number == self.k) & ~self.rare).any(axis=1)
                bound = np.full(len(self.need), -1.0)
                # They rise within a query: the last one stays.
                bound[row[ends]] = distance[ends]
                mine = row[last[whole]]
                self.bound[mine] = np.minimum(self.bound[mine], bound[mine])
        self.found = kept or self.found

    def _sides(self, queries: np.ndarray) -> np.ndarray:
        """Rows whose product with (known, ones) is the number of differences less the bound's share of common cells."""
        known, ones = (x.astype(self.kind) for x in self.queries.part(queries).cells())
        share = (self.bound[queries] / self.scale + self.slack).astype(self.kind)
        return np.hstack([known * ones - share[:, None] * known, known - 2 * known * ones])

    def _tile(self, at: int, tile: _Rows, closed: np.ndarray, sides: np.ndarray) -> None:
        opened = np.flatnonzero(np.isinf(self.bound))
        if len(opened):
            n = len(tile.data)
            cells = nearest_in_block(self.queries.part(opened).dense(), self.need[opened], tile.dense(), self.k, self.scale)
            pairs, distances = zip(*((row * n + column, distance) for row, _, distance, column in cells), strict=True)
            # A row may be near for several cells of a query.
            pair, first = np.unique(np.concatenate(pairs), return_index=True)
            self.found.append((opened[pair // n], at + pair % n, np.concatenate(distances)[first]))
        if len(closed):
            known, ones = tile.cells()
            facing = np.hstack([known, ones & known]).astype(self.kind).T
            for s in range(0, len(closed), self.queries_at_once):
                part = slice(s, s + self.queries_at_once)
                row, column = divmod(np.flatnonzero(sides[part] @ facing < -self.slack / 4), facing.shape[1])
                row = closed[part][row]
                distance = self.queries.part(row).distances(tile.part(column), self.scale)
                near = distance < self.bound[row]
                self.found.append((row[near], at + column[near], distance[near]))

    def _look_at_rare(self) -> None:
        counts = np.zeros(self.rows.n_features, np.int64)
        for at in range(0, len(self.rows.data), self.step):
            counts += self.rows.part(slice(at, at + self.step)).cells()[0].sum(axis=0)
        self.rare = counts < _RARE * self.k
        few = [[] for _ in counts]
        for at in range(0, len(self.rows.data), self.step):
            known = self.rows.part(slice(at, at + self.step)).cells()[0]
            for place, feature in zip(*np.nonzero(known & self.rare), strict=True):
                few[feature].append(at + place)
        size = 0
        for feature in np.flatnonzero(self.rare):
            rows, places = np.flatnonzero(self.need[:, feature]), np.array(few[feature], np.int64)
            row, place = np.repeat(rows, len(places)), np.tile(places, len(rows))
            distance = self.queries.part(row).distances(self.rows.part(place), self.scale)
            near = np.isfinite(distance)
            self.found.append((row[near], place[near], distance[near]))
            size += len(row)
            if size * self.rows.n_features > 16 * _TILE_CELLS:
                self._trim(0)
                size = 0

    def run(self) -> None:
        n, at, trimmed, size = len(self.rows.data), 0, 0, 0
        if self.rows.binary:
            self._look_at_rare()
            self.bound[~(self.need & ~self.rare).any(axis=1)] = -1.0
        closed, sides = np.zeros(0, np.int64), None
        while at < n:
            # No query has a bound yet in the first tile.
            end = min(n, at + (self.step if at else max(64, self.step // 4)))
            before = len(self.found)
            self._tile(at, self.rows.part(slice(at, end)), closed, sides)
            size, at = size + sum(len(x[0]) for x in self.found[before:]), end
            # Bounds are worth finding anew when twice as many rows are seen.
            if at >= 2 * trimmed or size * self.rows.n_features > 16 * _TILE_CELLS:
                self._trim(at)
                trimmed, size = at, 0
                closed = np.flatnonzero(np.isfinite(self.bound))
                sides = self._sides(closed) if len(closed) else None
        self._trim(n)

    def answers(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query row, feature, distance, place, value) in the order of cells and of distances."""
        self._sort()
        for s in self._by_row():
            row, place, distance = (x[s] for x in self.found[0])
            known, values = self.rows.part(place).cells()
            which, feature = np.nonzero(_chosen(row, known, self.need, self.k)[0])
            order = np.lexsort((which, feature, row[which]))
            which, feature = which[order], feature[order]
            yield row[which], feature, distance[which], place[which], values[which, feature].astype(np.float64)


def _score(n_features: int, k: int, scale: int, binary: bool):
    def score(group: pa.Table) -> pa.Table:
        """(pattern_id, i, near) of the queries of a part among the rows of a section."""
        q, c = (group.filter(pc.equal(group["is_query"], x)) for x in (True, False))
        ids = pa.concat_arrays([x.flatten() for x in c["c_ids"].chunks] or [pa.array([], group["c_ids"].type.value_type)])
        patterns = pa.concat_arrays([x.flatten() for x in q["q_ids"].chunks] or [pa.array([], pa.binary())])
        kinds = [("distance", pa.float64()), ("entity_id", ids.type), ("value", pa.float64())]
        schema = pa.schema([("pattern_id", pa.binary()), ("i", pa.int32()), ("near", pa.list_(pa.struct(kinds)))])
        if not len(ids) or not len(patterns):
            return schema.empty_table()
        order = pc.array_sort_indices(ids, null_placement="at_start")
        rows = _Rows.of(c["data"], n_features, binary).part(order.to_numpy())
        ids = ids.take(order)
        need = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in q["need"]]).reshape(len(patterns), -1)
        need = np.unpackbits(need, axis=1, count=n_features).astype(bool)
        search = _Search(_Rows.of(q["data"], n_features, binary), need, rows, k, scale)
        search.run()
        parts = []
        for row, feature, distance, place, value in search.answers():
            first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(feature, prepend=-1) != 0))
            near = pa.StructArray.from_arrays(
                [pa.array(distance), ids.take(pa.array(place)), pa.array(value)], names=[x for x, _ in kinds]
            )
            ends = pa.array(np.append(first, len(row)), pa.int32())
            columns = [patterns.take(pa.array(row[first])), pa.array(feature[first], pa.int32()), pa.ListArray.from_arrays(ends, near)]
            parts.append(pa.Table.from_arrays(columns, schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return score


@dataclass(frozen=True)
class KNNImputer:
    """Mean of the k nearest entities that know the feature.

    Cells without any neighbour fall back to the feature's mean. Targets should
    be missing in ``cells``; a target that is known there also gets the mean.
    """

    k: int = 5
    scale: int = 1_000_000
    block_bytes: int = 16 << 20
    min_block_rows: int = 256

    def _entities(self, known: DataFrame, targets: DataFrame, index: DataFrame) -> DataFrame:
        """Entity rows with the hash of their known cells."""
        content = F.array_join(
            F.transform(
                "known", lambda c: F.concat_ws(":", c["i"].cast("string"), c["v"].cast("string"))
            ),
            ",",
        )
        digest = F.unhex(F.substring(F.sha2(content, 256), 1, 32))
        return entity_rows(known, targets, index).withColumn("pattern_id", digest)

    def _found(self, cells: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(pattern_id, feature, near ARRAY<STRUCT<distance, entity_id, value>>), nearest first, and the entities' patterns."""
        spark = cells.sparkSession
        known, targets = known_cells(cells), targets.select(*KEY)
        index, n_features = feature_index(known, targets)
        id_type = entity_type(known)
        entities = cut_lineage(spark, self._entities(known, targets, index))

        wanted = (
            entities.select("pattern_id", F.explode("need").alias("i")).distinct()
            .groupBy("pattern_id").agg(F.collect_list("i").alias("need"))
        )
        queries = (
            entities.where(F.size("need") > 0)
            .groupBy("pattern_id").agg(F.any_value("known").alias("known"))
            .join(wanted, "pattern_id")
            .select(F.col("pattern_id").alias("id"), "known", "need")
        )
        by_id = Window.partitionBy("pattern_id").orderBy("entity_id")
        candidates = (
            entities.where(F.size("known") > 0)
            .withColumn("copy", F.row_number().over(by_id)).where(F.col("copy") <= self.k)
            .select(F.col("entity_id").alias("id"), "known", F.lit(None).cast("array<int>").alias("need"))
        )

        bits = F.coalesce(F.min(F.forall("known", lambda c: (c["v"] == 0) | (c["v"] == 1))), F.lit(True))
        n_rows, binary = entities.agg(F.greatest(F.count("*"), F.lit(1)), bits).first()
        slots = spark.sparkContext.defaultParallelism
        largest = max(1, self.block_bytes // (8 * n_features))
        spread = math.ceil(n_rows / math.ceil(math.sqrt(2 * slots)))
        block_rows = min(largest, max(self.min_block_rows, spread))
        blocks = math.ceil(n_rows / block_rows)
        # A part and section make as many pairs of rows as a few pairs of blocks, however many there are: a task's time and
        # memory do not grow with the input.
        tasks = min(blocks * blocks, _MOST_TASKS)
        row_bytes = 2 * math.ceil(n_features / 8) if binary else 8 * n_features
        in_section = max(1, self.block_bytes // (block_rows * row_bytes))
        sections = math.ceil(blocks / in_section)
        at_once = _PAIRS_OF_BLOCKS if binary and tasks > 4 * _PAIRS_OF_BLOCKS * slots else 1
        parts = math.ceil(tasks / sections / at_once)

        def packed(rows: DataFrame, n: int) -> DataFrame:
            kind = rows.schema["id"].dataType.simpleString()
            schema = f"block int, ids array<{kind}>, data binary, need binary"
            return (
                rows.select(
                    F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"),
                    "id", F.col("known.i").alias("i"), F.col("known.v").alias("v"), "need",
                )
                .groupBy("block").applyInArrow(_pack(n_features, binary), schema)
            )

        def each(n: int) -> Column:
            return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

        query_side = packed(queries, parts).select(
            F.col("block").alias("part"), each(sections).alias("section"), F.lit(True).alias("is_query"),
            F.col("ids").alias("q_ids"), F.lit(None).cast(f"array<{id_type}>").alias("c_ids"), "data", "need",
        )
        block_side = packed(candidates, blocks).select(
            each(parts).alias("part"), (F.col("block") % sections).alias("section"), F.lit(False).alias("is_query"),
            F.lit(None).cast("array<binary>").alias("q_ids"), F.col("ids").alias("c_ids"), "data",
            F.lit(None).cast("binary").alias("need"),
        )
        near = f"near array<struct<distance: double, entity_id: {id_type}, value: double>>"
        found = (
            query_side.unionByName(block_side)
            .repartition(max(1, tasks), "part", "section")
            .groupBy("part", "section").applyInArrow(
                _score(n_features, self.k, self.scale, binary), f"pattern_id binary, i int, {near}"
            )
        )
        if sections > 1:
            every = F.array_sort(F.flatten(F.collect_list("near")))
            found = found.groupBy("pattern_id", "i").agg(F.slice(every, 1, self.k).alias("near"))
        return (
            found.join(index, "i").select("pattern_id", "feature", "near"),
            entities.select("entity_id", "pattern_id", F.size("need").alias("n_need")),
        )

    def neighbours(self, cells: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The ranked neighbours per (pattern_id, feature), and the entities' patterns."""
        found, patterns = self._found(cells, targets)
        ranked = found.select("pattern_id", "feature", F.posexplode("near").alias("place", "near")).select(
            "pattern_id", "feature", (F.col("place") + 1).alias("rank"), "near.distance", "near.entity_id", "near.value"
        )
        return ranked, patterns

    def impute(self, cells: DataFrame, targets: DataFrame) -> DataFrame:
        found, patterns = self._found(cells, targets)
        total = F.aggregate("near", F.lit(0.0), lambda total, row: total + row["value"])
        answers = found.select("pattern_id", "feature", (total / F.size("near")).alias("knn_score"))
        fallback = MeanImputer().impute(cells, targets).select(*KEY, F.col("score").alias("mean_score"))
        return (
            fallback.join(patterns.select("entity_id", "pattern_id"), "entity_id", "left")
            .join(answers, ["pattern_id", "feature"], "left")
            .select(*prediction_columns("knn", F.coalesce("knn_score", "mean_score")))
        )

    def neighbour_examples(self, cells: DataFrame, targets: DataFrame) -> DataFrame:
        """(entity_id, feature, rank, neighbour_id, value) for every target with neighbours."""
        ranked, patterns = self.neighbours(cells, targets)
        return (
            targets.select(*KEY).join(patterns.select("entity_id", "pattern_id"), "entity_id")
            .join(ranked.withColumnRenamed("entity_id", "neighbour_id"), ["pattern_id", "feature"])
            .select(*KEY, "rank", "distance", "neighbour_id", "value")
        )
