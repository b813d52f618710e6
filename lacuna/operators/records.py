"""Nested parts of records as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import refs
from lacuna.functions.status import comment_clauses


def explode_list(records: DataFrame, column: str, alias: str, keep_empty: bool = False) -> DataFrame:
    """One row per list value; ``keep_empty`` keeps records without any."""
    explode = F.explode_outer if keep_empty else F.explode
    return records.select("languoid_id", explode(column).alias(alias))


def altnames(records: DataFrame) -> DataFrame:
    """(languoid_id, provider, name, lang); a provider's repeated name counts once.

    Repeats can only occur inside one record, so they are removed inside it and
    nothing is shuffled.
    """
    return records.select(
        "languoid_id", F.explode("altnames").alias("provider", "names")
    ).select(
        "languoid_id", "provider",
        F.inline(F.array_distinct(F.transform("names", refs.tagged_name))),
    )


def distinct_names(records: DataFrame) -> DataFrame:
    """(languoid_id, name): a name that several providers give counts once."""
    names = F.flatten(F.map_values("altnames"))
    bare = F.transform(names, lambda n: refs.tagged_name(n)["name"])
    return records.select("languoid_id", F.explode(F.array_distinct(bare)).alias("name"))


def _codes(entries: Column) -> Column:
    """Map entries (scheme, ids) to an array of (scheme, identifier), URLs decoded."""

    def one(scheme: Column, value: Column) -> Column:
        decoded = F.when(value.contains("://"), refs.percent_decode(value)).otherwise(value)
        return F.struct(scheme.alias("scheme"), decoded.alias("identifier"))

    return F.flatten(
        F.transform(entries, lambda e: F.transform(e["value"], lambda v: one(e["key"], v)))
    )


def identifiers(records: DataFrame) -> DataFrame:
    """(languoid_id, scheme, identifier), URL identifiers decoded."""
    return records.select("languoid_id", F.inline(_codes(F.map_entries("identifier"))))


def id_crosswalk(records: DataFrame) -> DataFrame:
    """Every external code of a record, ISO codes included, in one pass. A code may fan out."""
    none = F.array().cast("array<struct<scheme:string,identifier:string>>")
    iso = F.array(F.struct(F.lit("iso639-3").alias("scheme"), F.col("iso639_3").alias("identifier")))
    codes = F.concat(
        F.coalesce(_codes(F.map_entries("identifier")), none),
        F.when(F.col("iso639_3").isNotNull(), iso).otherwise(none),
    )
    return records.select("languoid_id", F.inline(codes))


def resolve_ids(codes: DataFrame, records: DataFrame) -> DataFrame:
    """Join (scheme, identifier) rows to records; unknown codes keep a NULL id."""
    return codes.join(id_crosswalk(records), ["scheme", "identifier"], "left")


def links(records: DataFrame) -> DataFrame:
    return records.select("languoid_id", F.inline("links"))


def sources(records: DataFrame) -> DataFrame:
    """(languoid_id, provider, key, pages) of the listed sources."""
    return records.select("languoid_id", F.inline("sources"))


def prose_refs(records: DataFrame, text: str = "classification.sub") -> DataFrame:
    return records.select("languoid_id", F.inline(refs.inline_refs(F.col(text))))


def ref_differences(records: DataFrame) -> DataFrame:
    """Records whose listed references differ from those in the prose."""
    d = refs.derived_ref_difference(F.col("classification.sub"), F.col("classification.subrefs"))
    return (
        records.where("classification.sub IS NOT NULL AND classification.subrefs IS NOT NULL")
        .select("languoid_id", d.alias("d"))
        .select("languoid_id", "d.only_prose", "d.only_list")
        .where("size(only_prose) + size(only_list) > 0")
    )


def status_comments(records: DataFrame) -> DataFrame:
    """One row per clause of the endangerment comments."""
    return records.select(
        "languoid_id",
        F.col("endangerment.status").alias("status"),
        F.inline(comment_clauses(F.col("endangerment.comment"))),
    )


def versions(records: DataFrame) -> DataFrame:
    return records.select(
        "languoid_id",
        F.explode("hh_ethnologue_comment.ethnologue_versions").alias("version"),
    )


def trigger_hits(titles: DataFrame, records: DataFrame, key: str, title: str = "title") -> DataFrame:
    """(key, languoid_id) of the titles for which an alternative of a record holds.

    ``key`` names a column that tells titles apart. An alternative is looked up by the rarest word it requires. Only
    keys and words that are looked up are shuffled; the titles of the candidates are joined back and tested whole.
    """
    alternatives = records.select("languoid_id", F.explode("triggers").alias("_alt")).distinct()
    alternatives = alternatives.withColumn("_required", refs.required_words(F.col("_alt")))
    wanted = alternatives.select(F.explode("_required").alias("_word")).distinct()
    tokens = titles.select(F.col(key).alias("_key"), F.explode(refs.text_words(F.col(title))).alias("_word")).join(
        wanted, "_word", "left_semi"
    )
    counts = tokens.groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))
    rarest = F.min_by("_word", F.struct("_n", "_word")).alias("_word")
    # A word that no title has makes its alternative hold nowhere.
    keyed = (
        alternatives.select("languoid_id", "_alt", F.explode("_required").alias("_word"))
        .join(counts, "_word", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
        .groupBy("languoid_id", "_alt").agg(rarest)
    )
    candidates = tokens.join(keyed, "_word").select("_key", "languoid_id", "_alt")
    whole = titles.select(F.col(key).alias("_key"), refs.text_words(F.col(title)).alias("_words"))
    hits = candidates.join(whole, "_key").where(refs.holds(F.col("_words"), F.col("_alt")))
    return hits.select(F.col("_key").alias(key), "languoid_id").distinct()
