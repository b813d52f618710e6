"""Cutting the lineage of iterative jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; only a local session without one gets a folder, for the life of the process.

    On a cluster the folder must be shared, or a lost executor takes the
    checkpoint with it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if named is None:
        named = tempfile.mkdtemp(prefix="lacuna-checkpoint-")
        atexit.register(shutil.rmtree, named, True)
    context.setCheckpointDir(named)


def cut_lineage(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def stored(spark: SparkSession, df: DataFrame, purpose: str, **options: object) -> DataFrame:
    """``df`` written as a Parquet table of its own in the checkpoint folder, and read from there."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{purpose}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
