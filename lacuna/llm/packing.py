"""Packing along a space-filling curve.

A document is the vector of its token counts (1 + log), projected by random signs of the hashed ids to four
dimensions. The Hilbert key of the projection, 10 bits a dimension, orders the documents; they are
laid end to end in that order and cut every ``seq_len`` tokens, so documents that share a
sequence lie near each other on the curve, and only the last sequence is short.

The order is a range partitioning on (key, id, row) without the ids; running sums within the ranges
and one number for each range give every document its place, and its ids are cut where they lie.

Defined cases: null and empty texts have the end token alone. Rows with equal ids are separate
documents; equal keys are ordered by id, then by row. Without rows there are no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.store import Store
from lacuna.llm.tokens import tokenised, unpack_ids
from lacuna.llm.words import mix

DIMENSIONS, BITS = 4, 10


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates from 0 to 2^bits - 1."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    # From the coarsest bit on, undo the turns of the curve; then the Gray code of the axes is the key.
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            set_ = (x[i] >> b & 1).astype(bool)
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] >> b & 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def project(ids: list[bytes]) -> np.ndarray:
    """Four coordinates of each document, about normally distributed."""
    row = np.repeat(np.arange(len(ids)), [len(x) // 4 for x in ids])
    pairs = np.sort(row << 32 | np.frombuffer(b"".join(ids), "<u4"))
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    weight = 1 + np.log(np.diff(first, append=len(pairs)))
    row, token = pairs[first] >> 32, pairs[first] & 0xFFFFFFFF
    signs = mix(token.astype(np.uint64) + np.uint64(1 << 40))
    length = np.sqrt(np.bincount(row, weight**2, minlength=len(ids)))
    out = np.empty((len(ids), DIMENSIONS))
    for d in range(DIMENSIONS):
        signed = np.where(signs >> np.uint64(d) & np.uint64(1), weight, -weight)
        out[:, d] = np.bincount(row, signed, minlength=len(ids)) / length
    return out


def _describe(ids: list[bytes]) -> list[pa.Array]:
    # A logistic curve close to the normal distribution's spreads the coordinates evenly.
    even = 1 / (1 + np.exp(-1.702 * project(ids)))
    return [pa.array(hilbert_keys((even * ((1 << BITS) - 1)).astype(np.int64), BITS))]


def _places(light: DataFrame, parts: int, store: Store) -> DataFrame:
    """(row_no, begin): tokens before each document, in the order of the curve."""
    ranged = light.repartitionByRange(parts, "key", "doc_id", "row_no").withColumn("part", F.spark_partition_id())
    ranged = store.keep(ranged, "ranged")
    sums = ranged.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # a number for each range
    before, begins = 0, {}
    for part, n in sorted(map(tuple, sums)):
        begins[part] = before
        before += n
    starts = store.spark.createDataFrame(list(begins.items()), "part int, base long")
    order = Window.partitionBy("part").orderBy("key", "doc_id", "row_no").rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("within", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    return within.join(starts, "part").select("row_no", (F.col("base") + F.col("within")).alias("begin"))


def pack(docs: DataFrame, tokenizer: str, store: Store, *, seq_len: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of documents in sequences of ``seq_len`` tokens.

    doc_id, start (ids of its document before it), length, ids (32-bit little-endian), doc_tokens (with the end
    token), sequence_id, offset (in the sequence), curve_key.
    """
    tokens = store.keep(tokenised(docs, tokenizer, end_id, _describe, "key long"), "tokens")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    places = _places(tokens.select("row_no", "doc_id", "key", "n_tokens"), parts, store)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "packed", "n_tokens", "begin", "key")]
            rows, held = [], 0
            for doc, packed, n, begin, key in zip(*columns, strict=True):
                ids = unpack_ids(packed, opener)
                bounds = [0, *range(seq_len - begin % seq_len, n, seq_len), n]
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    at = begin + a
                    rows.append((doc, a, b - a, ids[a:b].tobytes(), n, at // seq_len, at % seq_len, key))
                    held += b - a
                    if held > 1 << 20:
                        yield _pieces(rows)
                        rows, held = [], 0
            if rows:
                yield _pieces(rows)

    joined = tokens.select("row_no", "doc_id", "packed", "n_tokens", "key").join(places, "row_no")
    return joined.drop("row_no").mapInArrow(cut, _SCHEMA)


_SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, curve_key long"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("curve_key", pa.int64())]
)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)
