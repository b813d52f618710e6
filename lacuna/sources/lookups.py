"""Lookup tables kept as INI files: a section is a row, ``[DEFAULT]`` fills gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.ini import entry_text, parse_ini
from lacuna.functions.status import grade_range, label_words

LEVELS = {"ordinal": "int", "description": "string"}
STATUSES = {
    "ordinal": "int",
    "name": "string",
    "egids": "string",
    "unesco": "string",
    "elcat": "string",
    "icon": "string",
    "reference_id": "string",
}
DOCUMENT_TYPES = {"rank": "int", "name": "string", "description": "string", "icon": "string"}
EDITORS = {
    "name": "string",
    "affiliation": "string",
    "orcid": "string",
    "github": "string",
    "ord": "int",
    "current": "boolean",
}
PUBLICATION = {
    "name": "string",
    "url": "string",
    "version": "string",
    "doi": "string",
    "title_format": "string",
    "place": "string",
    "description": "string",
    "contact": "string",
    "license_id": "string",
    "keywords": "string",
    "communities": "string",
}

# Statuses (id, ordinal, display name, grades, unesco label, elcat label).
STATUS_ROWS = (
    ("safe", 1, "not endangered", "<=6a", "safe", "at risk/safe"),
    ("vulnerable", 2, "threatened", "6b", "vulnerable", "vulnerable"),
    ("definite", 3, "shifting", "7", "definitely endangered", "threatened/endangered"),
    ("severe", 4, "moribund", "8a", "severely endangered", "severely endangered"),
    ("critical", 5, "nearly extinct", "8b", "critically endangered", "critically endangered"),
    ("extinct", 6, "extinct", ">=9", "extinct", "dormant/awakening"),
)
# Document kinds, best first.
DOCUMENT_TYPE_ROWS = (
    ("long_grammar", 0),
    ("grammar", 1),
    ("grammar_sketch", 2),
    ("phonology_or_text", 3),
    ("wordlist_or_less", 4),
)


def default_statuses(spark: SparkSession) -> DataFrame:
    """The statuses, for use without the catalogue's config files."""
    return spark.createDataFrame(
        list(STATUS_ROWS),
        "id string, ordinal int, name string, egids string, unesco string, elcat string",
    )


def default_document_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DOCUMENT_TYPE_ROWS), "id string, rank int")


def inherit(own: Column, default: Column) -> Column:
    """A key of the section, or of ``[DEFAULT]`` if the section has none.

    A key that is present but empty is NULL and does not fall back.
    """
    return F.when(own.isNotNull(), entry_text(own)).otherwise(entry_text(default))


def parse_lookup(configs: DataFrame, schema: dict[str, str], text: str = "text") -> DataFrame:
    """One row per section of each config text."""
    keep = [c for c in configs.columns if c != text]
    ini = configs.select(*keep, parse_ini(F.col(text)).alias("ini"))
    rows = ini.select(
        *keep,
        F.try_element_at("ini", F.lit("DEFAULT")).alias("defaults"),
        F.explode(F.map_entries("ini")).alias("section"),
    ).where(F.col("section.key") != "DEFAULT")
    return rows.select(
        *keep,
        F.col("section.key").alias("id"),
        *[
            inherit(
                F.try_element_at("section.value", F.lit(key)),
                F.try_element_at("defaults", F.lit(key)),
            )
            .try_cast(kind)
            .alias(key)
            for key, kind in schema.items()
        ],
    )


def read_lookup(spark: SparkSession, path: str, schema: dict[str, str]) -> DataFrame:
    return parse_lookup(spark.read.text(path, wholetext=True).toDF("text"), schema)


def status_ranges(statuses: DataFrame) -> DataFrame:
    """Statuses with the closed range of grades each one covers."""
    r = grade_range(F.col("egids"))
    return statuses.select("id", "name", "ordinal", r["lo"].alias("lo"), r["hi"].alias("hi"))


def status_labels(statuses: DataFrame) -> DataFrame:
    """One row per (scheme, word): alternatives of a label are split."""
    schemes = [
        statuses.select(
            F.lit(s).alias("scheme"), "id", "name", "ordinal",
            F.explode(label_words(F.col(s))).alias("word"),
        )
        for s in ("unesco", "elcat")
    ]
    return schemes[0].unionByName(schemes[1])
