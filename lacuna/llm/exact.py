"""Exact duplicates, by a digest index that lasts between runs.

The index is a table bucketed and sorted by digest. New rows are reduced to one
winner per digest before they meet it, and a sort-merge anti-join, for which the index
is not shuffled, tells which winners are new; these are appended. An append that
is run again finds its rows in the index and adds nothing.

Texts are equal when they are identical after deleting all of ``[\\x20\\x09-\\x0D]``.
The row with the most code points in its original text stays, then the one with
the smallest id; a digest already in the index keeps the id it has there.

Defined cases: a null text counts as empty, and empty texts equal each other. A null
id loses against any other; rows that repeat the winner's id all stay. Without rows
nothing is appended. Column names other than doc_id and text are of no matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.store import Store

SALTS = 16


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    for space in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(""))
    return text


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, length) of each row."""
    return docs.select(
        "doc_id",
        F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("digest"),
        F.length(F.coalesce("text", F.lit(""))).alias("length"),
    )


class DigestIndex:
    """(digest, keep_id) in ``path``, opened or made there."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark = spark
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        self.buckets = buckets

    @property
    def table(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append_new(self, winners: DataFrame) -> None:
        """Append those of ``winners`` (digest, keep_id) whose digest is not in the index."""
        known = self.table.select("digest")
        new = winners.select("digest", "keep_id").join(known.hint("merge"), "digest", "left_anti")
        # A file for each bucket, not one for each bucket and task.
        new.repartition(self.buckets, "digest").write.insertInto(self.name)


def dedup(docs: DataFrame, index: DigestIndex, store: Store) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    group_size counts the rows of ``docs`` in the group. ``index`` gets the new digests.
    """
    rows = store.keep(digests(docs), "digests")
    # Of equal lengths the smallest id: the largest of its negation; null is the smallest of all.
    best = F.max(F.struct("length", (-F.col("doc_id")).alias("minus_id"))).getField("minus_id")
    groups = store.keep(
        rows.groupBy("digest").agg((-best).alias("keep_id"), F.count("*").alias("group_size")), "groups"
    )
    index.append_new(groups)
    stays = index.table.select("digest", F.col("keep_id").alias("stays"))
    settled = groups.select("digest", "group_size").join(stays.hint("merge"), "digest")
    # A group may hold a third of all rows: each row looks in one of several copies of its group.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    copies = settled.select("digest", "group_size", "stays", salts.alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(copies, ["digest", "salt"])
    return joined.select(
        "doc_id",
        F.col("stays").alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("stays")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def new_index(spark: SparkSession) -> tuple[DigestIndex, Store]:
    """An empty index of its own, with the folder it lies in."""
    store = Store(spark, "exact-dedup")
    return DigestIndex(spark, store.path("index")), store
