"""A query over the catalogue that follows a stream of versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.checkpoints import ensure_checkpoint_dir
from lacuna.plans.inputs import fill_in, table
from lacuna.plans.registry import query
from lacuna.sources.catalog import parse_records
from lacuna.streaming.catalog_log import CatalogLog, read_versions


def _versions(spark: SparkSession, sf_dir: str, name: str, day: int, where: str, gone: bool = False) -> DataFrame:
    text = fill_in(f"# -*- coding: utf-8 -*-\n[core]\nname = {name}\nlevel = language\n")
    return table(spark, sf_dir, "customer").where(where).selectExpr(
        f"{fill_in('file:/data/tree/n<<c_nationkey>>/c<<c_custkey>>/md.ini')} AS path",
        f"{'CAST(NULL AS STRING)' if gone else text} AS text",
        f"TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval({day}, c_custkey % 24) AS modified",
    )


@query("""SELECT 'c' || c_custkey AS languoid_id, CASE WHEN c_custkey % 5 = 0 THEN 'Renamed ' || c_custkey ELSE c_name END AS name
  FROM customer WHERE c_custkey % 11 <> 0 OR c_custkey % 13 = 0""")
def streamed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' records after a stream of new, renamed, stale, repeated, withdrawn and restored versions."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    first = _versions(spark, sf_dir, "<<c_name>>", 3, "true")
    renamed = "<<if(c_custkey % 5 = 0, concat('Renamed ', c_custkey), c_name)>>"
    arrivals = [
        first,
        _versions(spark, sf_dir, renamed, 5, "c_custkey % 5 = 0").unionByName(_versions(spark, sf_dir, "<<c_name>>", 3, "c_custkey % 4 = 1")),
        _versions(spark, sf_dir, "", 6, "c_custkey % 11 = 0", gone=True).unionByName(_versions(spark, sf_dir, "Stale", 2, "c_custkey % 7 = 0")),
        _versions(spark, sf_dir, renamed, 7, "c_custkey % 11 = 0 AND c_custkey % 13 = 0"),
    ]
    log = CatalogLog(spark, f"{folder}/log")
    for n, arrival in enumerate(arrivals):
        arrival.write.mode("append").parquet(f"{folder}/arrivals")
        log.follow(read_versions(spark, f"{folder}/arrivals"))
        if n == 1:
            log.snapshot()
    return parse_records(log.current(), ["name"]).select("languoid_id", "name")
