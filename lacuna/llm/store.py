"""Tables of one run, written to the folder that driver and executors share.

A written table cuts the lineage: an executor that is lost takes no part of it
along, and readers see the same rows however often a task is repeated.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

WRITING = {
    # The shuffles behind a written table have no other reader.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Batches for Python are bounded by their bytes: ten thousand texts may be of any size.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}
"""Settings of a session while it writes a table; they are put back after it."""


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder, which goes with the process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="lacuna-llm-")
        atexit.register(shutil.rmtree, named, True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Store:
    """A run's own folder within the shared one."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table."""
        before = {k: self.spark.conf.get(k, None) for k in WRITING}
        try:
            for k, v in WRITING.items():
                self.spark.conf.set(k, v)
            df.write.option("compression", "zstd").parquet(self.path(name))
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
