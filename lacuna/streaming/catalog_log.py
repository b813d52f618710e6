"""A catalogue that follows a stream of record versions.

A version is (path, text, modified); a null text says that the record is gone. The stream appends each micro-batch
to a log, in a folder named by the batch: a batch that is run again after a failure writes the same folder again and changes
nothing. The catalogue is the latest version of each path, so versions may come late, in any order or
repeatedly. Deliveries that are repeated within the watermark are dropped before they are written, with
state that is bounded by it. A snapshot folds the log so far, so that readers need not go over it again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "path string, text string, modified timestamp"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


@dataclass(frozen=True)
class CatalogLog:
    """Versions in ``folder``, which all executors share."""

    spark: SparkSession
    folder: str

    def write_batch(self, versions: DataFrame, batch: int) -> None:
        """The versions of one batch; a batch that is there already is replaced by itself."""
        versions.select("path", "text", "modified").write.mode("overwrite").parquet(f"{self.folder}/versions/batch={batch}")

    def _versions(self) -> DataFrame:
        if not _exists(self.spark, f"{self.folder}/versions"):
            return self.spark.createDataFrame([], f"{VERSION}, batch long")
        return self.spark.read.schema(f"{VERSION}, batch long").parquet(f"{self.folder}/versions")

    def _snapshots(self) -> DataFrame:
        if not _exists(self.spark, f"{self.folder}/snapshots"):
            return self.spark.createDataFrame([], f"{VERSION}, batch long, up_to long")
        return self.spark.read.schema(f"{VERSION}, batch long, up_to long").parquet(f"{self.folder}/snapshots")

    def latest(self) -> DataFrame:
        """(path, text, modified, batch): the last version of each path, gone records included.

        Of versions with equal times the one of the later batch counts, then the greater text.
        """
        snapshots = self._snapshots()
        last = snapshots.agg(F.max("up_to")).first()[0]
        rows = self._versions().where(F.col("batch") > F.lit(-1 if last is None else last))
        rows = rows.unionByName(snapshots.where(F.col("up_to") == F.lit(last)).drop("up_to"))
        order = F.struct("modified", "batch", "text")
        return rows.groupBy("path").agg(F.max(order).alias("v")).select("path", "v.text", "v.modified", "v.batch")

    def current(self) -> DataFrame:
        """(path, text) of the records that are there, as the record parser takes them."""
        return self.latest().where(F.col("text").isNotNull()).select("path", "text")

    def snapshot(self) -> None:
        """Fold all batches written so far; gone records stay, so that late versions of them stay gone."""
        up_to = self._versions().agg(F.max("batch")).first()[0]
        if up_to is not None:
            self.latest().write.mode("overwrite").parquet(f"{self.folder}/snapshots/up_to={up_to}")

    def follow(self, versions: DataFrame, late: str = "7 days") -> None:
        """Take in all that the stream ``versions`` (path, text, modified) has now."""
        fresh = versions.withWatermark("modified", late).dropDuplicatesWithinWatermark(["path", "text", "modified"])
        query = fresh.writeStream.foreachBatch(self.write_batch).option(
            "checkpointLocation", f"{self.folder}/checkpoint"
        ).trigger(availableNow=True).start()
        query.awaitTermination()


def read_versions(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files of versions that come to a folder."""
    reader = spark.readStream.schema(VERSION)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
