"""Sequences in training order, in shards of fixed stride.

Documents are laid end to end within each task and cut every ``seq_len`` tokens; a task's last sequence is filled
up with the padding id. Sequences are numbered through, by one count for each task. A keyed Feistel
permutation over the smallest even number of bits that holds them, walked on until the result is a number of a
sequence, gives each its slot: a bijection that needs no table and no sort by a random number.

Slots are dealt by their shards; a task writes each of its shards to a file of its own and renames it when
it is whole, so a task that runs again, or twice, leaves the same file. Slot s begins at byte ``s % slots * stride`` of shard ``s // slots``,
so reading can go on from any slot.

Defined cases: null and empty texts are their end token alone. Rows with equal ids are separate documents. Without
rows there are no shards. Ids take 2 bytes if the vocabulary allows it, else 4, little-endian.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm.store import Store
from lacuna.llm.tokens import PieceTokenizer, pack_ids, unpack_ids
from lacuna.llm.words import mix, small_batches

FEISTEL_ROUNDS = 6
PIECE = 32
"""Slots of a piece of a shard, about the square root of those of a shard."""


def permute(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1, for each of ``numbers``."""
    half = max(1, -(-(max(n, 2) - 1).bit_length() // 2))
    mask, width = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, FEISTEL_ROUNDS + 1, dtype=np.uint64) + np.uint64(key & 0xFFFFFFFFFFFF) * np.uint64(1 << 16))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> width, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return left << width | right

    out = once(numbers.astype(np.uint64))
    while (over := out >= n).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """How ids lie in the shards."""

    seq_len: int = 2048
    slots: int = 1024
    id_bytes: int = 2

    @property
    def stride(self) -> int:
        return self.seq_len * self.id_bytes

    def place(self, slot: Column) -> tuple[Column, Column]:
        """Shard and first byte of a slot."""
        return F.floor(slot / self.slots), slot % self.slots * self.stride


def sequences(docs: DataFrame, tokenizer: str, layout: Layout, *, end_id: int = 1, pad_id: int = 0) -> DataFrame:
    """(task, number, n_tokens, doc_ids, packed) of the sequences of each task."""
    end, full = np.array([end_id], "<u4").tobytes(), layout.seq_len * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, packer = PieceTokenizer.of(tokenizer), zstandard.ZstdCompressor(level=1)
        # Documents of the open sequence, and its ids so far.
        open_, held, number, task, rows = [], bytearray(), 0, 0, []

        def close() -> None:
            nonlocal number, held
            ids = bytes(held[:full])
            ids += np.full(layout.seq_len - len(ids) // 4, pad_id, "<u4").tobytes()
            rows.append((task, number, min(len(held), full) // 4, list(open_), pack_ids(ids, packer)))
            number, held = number + 1, held[full:]

        def emit() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["task", "number", "n_tokens", "doc_ids", "packed"]
            )

        for batch in small_batches(batches, most=1 << 20):
            task = batch.column("task")[0].as_py()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), pieces.ids(texts), strict=True):
                ids, at = ids + end, 0
                while at < len(ids):
                    take = min(full - len(held), len(ids) - at)
                    held += ids[at : at + take]
                    open_.append(doc)
                    at += take
                    if len(held) == full:
                        close()
                        open_.clear()
                if len(rows) > 200:
                    yield emit()
        if held:
            close()
        if rows:
            yield emit()

    schema = "task int, number long, n_tokens long, doc_ids array<long>, packed binary"
    return docs.select(F.spark_partition_id().alias("task"), "doc_id", "text").mapInArrow(run, schema)


def _slots(made: DataFrame, counts: list[tuple[int, int]], key: int) -> DataFrame:
    """``made`` with sequence_id and slot, by the sequences of each task."""
    spark = made.sparkSession
    total, bases = 0, {}
    for task, n in counts:
        bases[task] = total
        total += n
    shared = spark.sparkContext.broadcast(bases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                base = np.array([shared.value[t] for t in batch.column("task").to_pylist()], np.int64)
                ids = base + batch.column("number").to_numpy()
                yield batch.append_column("sequence_id", pa.array(ids)).append_column("slot", pa.array(permute(ids, total, key)))

    schema = T.StructType([*made.schema, T.StructField("sequence_id", T.LongType()), T.StructField("slot", T.LongType())])
    return made.mapInArrow(run, schema)


def write_shards(docs: DataFrame, tokenizer: str, store: Store, *, key: int = 20240229, seq_len: int = 2048, slots: int = 1024) -> tuple[DataFrame, Layout, str]:
    """Write the sequences of ``docs`` in their order; the table of slots, the layout and the folder of the shards.

    Table: slot, sequence_id, n_tokens (without padding), doc_ids (in the order of the sequence).
    """
    from tokenizers import Tokenizer

    small = Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16
    layout = Layout(seq_len, slots, 2 if small else 4)
    made = store.keep(sequences(docs, tokenizer, layout), "sequences")
    counts = sorted(map(tuple, made.groupBy("task").count().collect()))  # a number for each task
    placed = _slots(made.select("task", "number", "packed"), counts, key)
    folder = store.path("shards")
    kind = f"<u{layout.id_bytes}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        opener, now, out, name, count = zstandard.ZstdDecompressor(), None, None, "", 0

        def close() -> pa.RecordBatch:
            out.close()
            system.move(name, f"{path}/{now:010d}.bin")
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([count], pa.int64())], names=["shard", "sequences"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "attempt", "packed")]
            for shard, attempt, packed in zip(*columns, strict=True):
                if shard != now:
                    if out:
                        yield close()
                    now, count, name = shard, 0, f"{path}/.{shard:010d}-{attempt}"
                    out = system.open_output_stream(name)
                out.write(unpack_ids(packed, opener).astype(kind).tobytes())
                count += 1
        if out:
            yield close()

    dealt = placed.select("slot", layout.place(F.col("slot"))[0].alias("shard"), "packed").repartition("shard")
    ordered = dealt.sortWithinPartitions("slot").withColumn("attempt", F.expr("uuid()")).select("shard", "attempt", "packed")
    store.keep(ordered.mapInArrow(write, "shard long, sequences long"), "manifest")
    order = _slots(made.select("task", "number", "n_tokens", "doc_ids"), counts, key)
    return order.select("slot", "sequence_id", "n_tokens", "doc_ids"), layout, folder


def read_shards(spark: SparkSession, folder: str, layout: Layout, from_slot: int = 0) -> DataFrame:
    """(slot, shard, byte_offset, ids) from ``from_slot`` on; ids as they lie in the file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    shard = F.regexp_extract("path", r"([0-9]+)\.bin$", 1).cast("long").alias("shard")

    def cut(rows: DataFrame, slots: int) -> DataFrame:
        """Pieces of so many slots, the last one of those left; ``i`` is the first slot of each."""
        size = slots * layout.stride
        number = F.sequence(F.lit(0), F.ceil(F.length("content") / size).cast("int") - 1)
        pieces = F.transform(
            number,
            lambda n: F.struct((F.col("i") + n * slots).alias("i"), F.col("content").substr(n * size + 1, F.lit(size)).alias("content")),
        )
        return rows.select("shard", F.inline(pieces))

    # Each piece that is cut copies what it is cut from, so a file is cut twice.
    rows = files.select(shard, F.lit(0).alias("i"), "content").where(F.col("shard") >= from_slot // layout.slots)
    rows = cut(cut(rows, PIECE), 1).withColumnRenamed("content", "ids")
    slot = F.col("shard") * layout.slots + F.col("i")
    place = (F.col("i") * layout.stride).cast("long").alias("byte_offset")
    return rows.select(slot.alias("slot"), "shard", place, "ids").where(F.col("slot") >= from_slot)
