"""Alphabetic index pages: markdown lists that link to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.sources.catalog import lineage_of_path

# Fixed value: an index line is "- [Name [id][iso]](path)"; the iso part is optional.
ENTRY = r"^- \[(.*) \[([a-z0-9]+)\](?:\[([a-z]{3})\])?\]\((\S+)\)$"


def parse_index_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    c = F.col(line)
    keep = [k for k in lines.columns if k != line]
    return (
        lines.where(c.rlike(ENTRY))
        .select(
            *keep,
            F.regexp_extract(c, ENTRY, 1).alias("name"),
            F.regexp_extract(c, ENTRY, 2).alias("languoid_id"),
            F.nullif(F.regexp_extract(c, ENTRY, 3), F.lit("")).alias("iso639_3"),
            F.regexp_extract(c, ENTRY, 4).alias("path"),
        )
        .withColumn("lineage", lineage_of_path(F.col("path")))
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return parse_index_lines(spark.read.text(path))


def index_line(name: Column, languoid_id: Column, iso: Column, lineage: Column) -> Column:
    return F.concat(
        F.lit("- ["), name, F.lit(" ["), languoid_id, F.lit("]"),
        F.coalesce(F.concat(F.lit("["), iso, F.lit("]")), F.lit("")),
        F.lit("](tree/"), F.concat_ws("/", lineage), F.lit("/md.ini)"),
    )


def build_index(records: DataFrame) -> DataFrame:
    """Index lines with the page (level, initial) each belongs to."""
    return records.select(
        "level",
        F.upper(F.substring("name", 1, 1)).alias("initial"),
        "name",
        "languoid_id",
        index_line(
            F.col("name"), F.col("languoid_id"), F.col("iso639_3"), F.col("lineage")
        ).alias("line"),
    )


def write_index(index: DataFrame, out: str) -> None:
    """Text files by page, each page in name order.

    Range partitioning on (page, name) spreads a page with very many names
    over several files instead of one task.
    """
    keys = ["level", "initial", "name", "languoid_id"]
    (
        index.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("level", "initial", "line")
        .write.mode("overwrite")
        .partitionBy("level", "initial")
        .text(out)
    )


def index_problems(entries: DataFrame, records: DataFrame) -> DataFrame:
    """Entries without a record, or whose name, path, level or code differs from it; the first of these is told.

    Levels and codes are compared where both sides have them as columns: a page is of one level, and an entry
    without a code says that the record has none.
    """
    compared = [c for c in ("level", "iso639_3") if c in entries.columns and c in records.columns]
    r = records.select(
        "languoid_id", F.col("name").alias("record_name"), F.col("lineage").alias("record_lineage"),
        *[F.col(c).alias(f"record_{c}") for c in compared], F.lit(True).alias("has_record"),
    )
    joined = entries.join(r, "languoid_id", "left")
    problem = (
        F.when(F.col("has_record").isNull(), "missing")
        .when(~F.col("name").eqNullSafe(F.col("record_name")), "name")
        .when(F.col("lineage") != F.col("record_lineage"), "path")
    )
    for c, told in (("level", "level"), ("iso639_3", "code")):
        if c in compared:
            problem = problem.when(~F.col(c).eqNullSafe(F.col(f"record_{c}")), told)
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").select(
        *entries.columns, "problem"
    )
