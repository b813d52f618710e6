"""Licenses named in texts, by ordered signature rules.

A text is brought to its words: A-Z lower-cased, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``, each with
a space of its own on both sides. One scan tells which of the rules' keywords stand in it; only rules
with such a keyword are tried. Of the places that the rules find, one within another is dropped, of
equal ones all but that of the earliest rule. Of the rest, in the order of the text, one that overlaps the one
before or after it is dropped if that one's rule comes first.

All of it is work within the row: nothing is shuffled, and a long text costs its own length.

Defined cases: a null text counts as empty and has no words; rows that repeat are judged each on its own. Columns
of ``docs`` other than the text are kept as they are; those with a result's name must be renamed before.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.license_rules import BASE, RULES, Rule

CHUNK = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLACE = "struct<start:int,end:int,order:int,label:string,confidence:double,words:string>"


def spaced_words(text: Column) -> Column:
    """The words of a text, each between two spaces of its own; empty without words."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    words = F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  "))
    return F.when(words == "", "").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def count_words(spaced: Column) -> Column:
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" "), F.lit("")))) / 2).cast("int")


def keyword_pattern(rules: list[Rule]) -> str:
    """All keywords, by their first letter, so that most words fail at once."""
    letters = defaultdict(list)
    for word in sorted({k for r in rules for k in r.keywords}):
        letters[word[0]].append(word[1:])
    return " (" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(letters.items())) + ") "


def _rule_array(rules: list[Rule]) -> Column:
    """The rules as one constant; hundreds of expressions would take seconds to plan."""
    schema = "array<struct<order:int,label:string,confidence:double,keywords:array<string>,regex:string>>"
    return F.from_json(F.lit(json.dumps([asdict(r) for r in rules])), schema)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once; within a lambda an expression is worked out wherever it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column], zero: Column) -> Column:
    """What each element and all before it merge to. Chunks keep the work far from the square of the length."""

    def of_chunks(chunks: Column) -> Column:
        return let(F.transform(chunks, lambda chunk: F.aggregate(chunk, zero, merge)), lambda totals: F.transform(
            chunks,
            lambda chunk, at: let(F.aggregate(F.slice(totals, 1, at), zero, merge), lambda before: F.transform(
                chunk, lambda _, i: F.aggregate(F.slice(chunk, 1, i + 1), before, merge)
            )),
        ))

    def of_values(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int"))
        return F.flatten(let(F.transform(starts, lambda c: F.slice(v, c * CHUNK + 1, CHUNK)), of_chunks))

    return let(values, lambda v: F.when(F.size(v) > 0, of_values(v)))


def _places(spaced: Column, rule: Column, hits: Column) -> Column:
    """Where the matches of a rule stand, in words."""
    between = F.slice(F.transform(F.split(spaced, rule["regex"], -1), count_words), 1, F.size(hits))

    def of_lengths(lengths: Column) -> Column:
        # The words before the end of each match.
        ends = running(F.zip_with(between, lengths, lambda a, b: a + b), lambda a, b: a + b, F.lit(0))
        return F.transform(
            F.arrays_zip(hits.alias("hit"), lengths.alias("length"), ends.alias("end")),
            lambda x: F.struct(
                (x["end"] - x["length"]).alias("start"), x["end"].alias("end"), rule["order"].alias("order"), rule["label"].alias("label"),
                rule["confidence"].alias("confidence"), F.trim(F.replace(x["hit"], F.lit("  "), F.lit(" "))).alias("words"),
            ).cast(_PLACE),
        )

    return let(F.transform(hits, count_words), of_lengths)


def _resolved(places: Column) -> Column:
    """Places that no other suppresses."""
    keyed = F.transform(places, lambda p: F.struct(
        p["start"].alias("start"), (-p["end"]).alias("minus_end"), p["order"].alias("order"), p.alias("place")
    ))

    def outermost(ordered: Column) -> Column:
        reach = running(F.transform(ordered, lambda p: p["end"]), lambda a, b: F.greatest(a, b), F.lit(-1))
        return let(reach, lambda r: F.filter(ordered, lambda p, i: (i == 0) | (p["end"] > F.get(r, i - 1))))

    def not_beaten(outer: Column) -> Column:
        def stays(p: Column, i: Column) -> Column:
            before, after = F.get(outer, i - 1), F.get(outer, i + 1)
            beaten = ((before["end"] > p["start"]) & (before["order"] < p["order"])) | ((after["start"] < p["end"]) & (after["order"] < p["order"]))
            return ~F.coalesce(beaten, F.lit(False))

        return F.filter(outer, stays)

    return let(let(F.transform(F.array_sort(keyed), lambda x: x["place"]), outermost), not_beaten)


def scan(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with n_words, ``places`` (all that the rules find) and ``detections`` (those that stay).

    A place has its start and end in words, the rule's order, label and confidence, and the words themselves.
    """
    rules = RULES if rules is None else rules
    names = [F.col(f"`{c}`") for c in docs.columns]
    spaced = docs.select(*names, spaced_words(F.col(f"`{text_col}`")).alias("_spaced"))
    keyed = spaced.select(
        *names, "_spaced", F.array_distinct(F.regexp_extract_all("_spaced", F.lit(keyword_pattern(rules)), F.lit(1))).alias("_keywords")
    )
    nothing = F.array().cast(f"array<{_PLACE}>")
    tried = F.filter(_rule_array(rules), lambda r: F.arrays_overlap(r["keywords"], F.col("_keywords")))
    matched = F.transform(
        tried, lambda r: F.struct(r.alias("rule"), F.regexp_extract_all(F.col("_spaced"), r["regex"], F.lit(0)).alias("hits"))
    )
    matched = F.filter(matched, lambda m: F.size(m["hits"]) > 0)
    found = keyed.select(
        *names, "_spaced", count_words(F.col("_spaced")).cast("long").alias("n_words"),
        F.when(F.size("_keywords") > 0, matched).alias("_matched"),
    )
    places = F.flatten(F.transform("_matched", lambda m: _places(F.col("_spaced"), m["rule"], m["hits"])))
    found = found.select(*names, "n_words", F.coalesce(F.when(F.size("_matched") > 0, places), nothing).alias("places"))
    return found.select("*", F.coalesce(F.when(F.size("places") > 0, _resolved(F.col("places"))), nothing).alias("detections"))


def _joined(labels: Column) -> Column:
    return F.concat_ws(",", F.array_sort(F.array_distinct(labels)))


def digest(scanned: DataFrame, keep: list[str], rules: list[Rule] | None = None) -> DataFrame:
    """The columns of the contract from :func:`scan`; the last rules are the base."""
    first_base = len(RULES if rules is None else rules) - BASE
    base = F.filter("places", lambda p: p["order"] >= first_base)
    labels = F.transform(base, lambda p: p["label"])
    return scanned.select(
        *keep,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda p: p["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda p: p["start"])).cast("long").alias("last_word"),
        _joined(labels).alias("base_labels"),
        _joined(F.concat(labels, F.transform("detections", lambda p: p["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda p: p["confidence"])), F.lit(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
