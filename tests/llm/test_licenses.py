"""License rules, their keywords, and the scan against SQL and plain counting."""

import re

import duckdb
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lacuna.llm import licenses
from lacuna.llm.license_rules import BASE, RULES, Rule, words_apart
from lacuna.llm.license_sql import scan_sql
from lacuna.llm.queries import QUERIES

SCHEMA = "doc_id long, text string"
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def run(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    return [tuple(r) for r in licenses.digest(licenses.scan(docs), ["doc_id"]).collect()]


def base(doc_id, text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    at = [
        (i, label) for phrase, label in PHRASES.items() for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in at] or [None]
    return doc_id, len(words), len(at), min(starts), max(starts), ",".join(sorted({x for _, x in at}))


def check(spark, rows):
    found = run(spark, rows)
    assert sorted(map(repr, (r[:6] for r in found))) == sorted(repr(base(*r)) for r in rows)
    frame = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": pd.array([r[1] for r in rows], "string")})
    with duckdb.connect() as c:
        c.register("documents", frame)
        wanted = c.execute(scan_sql()).fetchall()
    key = lambda r: repr([None if x is None or x != x else x for x in r])
    assert sorted(map(key, found)) == sorted(map(key, wanted))
    for r in found:
        assert set(filter(None, r[5].split(","))) <= set(r[6].split(",")) and 0 <= r[7] <= 1
    return {r[0]: r for r in found}


def test_there_are_hundreds_of_rules():
    assert len(RULES) > 250 and len({r.regex for r in RULES}) == len(RULES)
    assert [r.label for r in RULES[-BASE:]] == list(PHRASES.values())


@pytest.mark.parametrize("rule", RULES, ids=lambda r: str(r.order))
def test_every_match_holds_a_keyword(rule):
    @settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(rule.regex, re.ASCII), fullmatch=True))
    def holds(match):
        assert set(rule.keywords) & set(match.split())

    holds()


NAMED = {
    "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3.0-or-later",
    "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "Released under the MIT License.": "mit",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "under the GNU Lesser General Public License v2.1 or later": "lgpl-2.1-or-later",
    "GNU AFFERO GENERAL PUBLIC LICENSE Version 3": "agpl-3.0",
    "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": "cc-by-nc-sa-4.0",
    "the 3-clause BSD license": "bsd-3-clause",
    "Mozilla Public License, v. 2.0": "mpl-2.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met": "bsd",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "All rights reserved.": "proprietary",
    "We drove with Mit to see the open country.": "",
}


def test_named_licenses(spark):
    found = check(spark, list(enumerate(NAMED)))
    assert {text: found[i][6] for i, text in enumerate(NAMED)} == NAMED


def test_edge_cases(spark):
    rows = [
        (1, None), (2, ""), (3, " \x00\x7f~"), (None, "MIT license"), (5, "mit licenſe"), (6, "mitKicense cc by"), (7, "Cc_By cc by"),
        (8, "mit license mit license mit license gnu general public license"), (8, "mit license"), (9, "MIT\n\n-- License 2 apache"),
        (10, "\U0001d40c apache license \U0001d40c cc by nc nd 4 0 license apache license version 2 0 with llvm exceptions"),
        (11, "mit license" * 3), (12, "apache license version 2 0 apache 2 0 apache"),
    ]
    check(spark, rows)


def test_very_long_texts(spark):
    found = check(spark, [(1, "filler " * 40_000 + "cc by " * 3_000 + "mit license, apache license v2 " * 700), (2, "x" * 300_000)])
    assert found[1][2] == 3_000 + 2 * 700


def test_suppression(spark):
    def rule(order, label, regex):
        return Rule(order, label, 0.5, tuple({regex.split()[0]}), words_apart(regex))

    rules = [rule(0, "early", "b c"), rule(1, "late", "a b"), rule(2, "whole", "c d e f"), rule(3, "part", "d e"), rule(4, "twice", "d e")]
    rules += [rule(5 + i, "none", f"zz{i}") for i in range(BASE)]
    docs = spark.createDataFrame([(1, "a b c x d e c d e f")], SCHEMA)
    row = licenses.scan(docs, rules=rules).first()
    assert [(d.label, d.start, d.end, d.words) for d in row.detections] == [("early", 1, 3, "b c"), ("part", 4, 6, "d e"), ("whole", 6, 10, "c d e f")]
    assert len(row.places) == 7


def test_columns_stay_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "MIT License", 7)], "doc_id long, text string, `order.x` int")
    assert licenses.scan(docs).select("`order.x`", "n_words").first() == (7, 2)
    assert run(spark, []) == []


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("gnu general public license apache cc by mit 4 0 version 2 or later nc sa é the under".split()), max_size=25), max_size=12))
def test_random_texts(spark, texts):
    check(spark, [(i, " ".join(t)) for i, t in enumerate(texts)] or [(0, "")])


def test_query(spark):
    found = QUERIES["op13_licenses"].run(spark, "/root/testdata/sf0.001")
    assert found.columns[:8] == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    with duckdb.connect() as c:
        c.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
        assert sorted(map(repr, c.execute(QUERIES["op13_licenses"].sql).fetchall())) == sorted(repr(tuple(r)) for r in found.collect())
