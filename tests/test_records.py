"""Parsing of records, lookups and index pages. All records here are invented."""

import datetime

import pytest
from pyspark.sql import functions as F

from lacuna.functions import ini, intervals, refs
from lacuna.functions import status as st
from lacuna.operators import records as rec
from lacuna.operators import status as status_ops
from lacuna.sources import catalog, index_pages, lookups

FULL = """# -*- coding: utf-8 -*-
[core]
level = language
hid = zzx
name = Ünlü (West)
latitude = 12.75
longitude = -40.5
iso639-3 = zzx
macroareas = 
\tPapunesia
countries = 
\tID
\tTL
links = 
\thttps://example.org/a
\t[Label](https://example.net/x?y=1)
timespan = -0730-01-01/-0210-01-01

[sources]
main = 
\t**hh:s:Mouse:Grammar**:71-77
\t**iso6393:1902-991**

[altnames]
wide (1987) = 
\tName One
lexvo = 
\tName One [en]
\tName One [en]
\tAnder [x-Abc]

[triggers]
lgcode = 
\talpha
\tbeta AND gamma

[identifier]
multi = aa;bb
web = http://example.org/%C3%A9;x

[classification]
family = There is **hh:v:Cat:Comp** of
\tmany words,
\tjoined.
sub = see **hh:v:Cat:Comp**:30 and **hh:h:Broken( ** too
subrefs = 
\t**hh:v:Cat:Comp**
\t**hh:v:Other**

[endangerment]
status = not endangered
source = E1
date = 2031-07-09T03:04:05
comment = Ünlü (zzx-zzx) = 6a* (Vigorous).

[iso_retirement]
remedy = Split into [aaa] X and [bbb] Y
code = zzx
effective = 2017-01-31
reason = split
change_to = 
\tbbb
\taaa

[hh_ethnologue_comment]
comment = 100% missing = yes
comment_type = Missing
ethnologue_versions = E16/E17
isohid = zzx
"""
MINIMAL = "# c\n[core]\nname = Root\nlevel = family\ncountries = \n"


@pytest.fixture(scope="module")
def parsed(spark):
    texts = spark.createDataFrame(
        [
            ("file:/x/tree/root1234/unlu1234/md.ini", FULL),
            ("file:/x/tree/root1234/md.ini", MINIMAL),
            ("file:/x/tree/3dup1234/md.ini", "[core]\r\nname = A\r\nname = B\r\n[core]\r\nname = C\r\n[odd\r\n"),
            ("file:/x/tree/none1234/md.ini", "no section\nkey = value\n"),
        ],
        "path string, text string",
    )
    return catalog.parse_records(texts).cache()


def row(parsed, key):
    return parsed.where(F.col("languoid_id") == key).first()


def test_full_record(parsed):
    r = row(parsed, "unlu1234")
    assert (r.name, r.level, r.hid, r.iso639_3) == ("Ünlü (West)", "language", "zzx", "zzx")
    assert (r.latitude, r.longitude) == (12.75, -40.5)
    assert (r.parent_id, r.top_id, r.depth) == ("root1234", "root1234", 2)
    assert r.countries == ["ID", "TL"]
    assert [tuple(x) for x in r.links] == [
        (None, "https://example.org/a", "example.org"),
        ("Label", "https://example.net/x?y=1", "example.net"),
    ]
    assert tuple(r.timespan) == (-730, -210)
    assert [tuple(x) for x in r.sources] == [
        ("hh", "s:Mouse:Grammar", "71-77"), ("iso6393", "1902-991", None)
    ]
    assert r.altnames["wide (1987)"] == ["Name One"]
    assert r.identifier == {"multi": ["aa", "bb"], "web": ["http://example.org/%C3%A9;x"]}
    assert r.triggers == [["alpha"], ["beta", "gamma"]]
    assert r.classification.family == "There is **hh:v:Cat:Comp** of many words, joined."
    assert r.endangerment.date == datetime.datetime(2031, 7, 9, 3, 4, 5)
    assert r.iso_retirement.effective == datetime.date(2017, 1, 31)
    assert r.iso_retirement.change_to == ["bbb", "aaa"]
    assert r.hh_ethnologue_comment.comment == "100% missing = yes"
    assert r.hh_ethnologue_comment.ethnologue_versions == ["E16", "E17"]


def test_absent_is_null_and_empty_is_empty(parsed):
    r = row(parsed, "root1234")
    assert r.countries == [] and r.macroareas is None
    assert r.parent_id is None and r.endangerment is None and r.altnames is None


def test_first_of_repeated_keys_and_sections_wins(parsed):
    assert row(parsed, "3dup1234").name == "A"


def test_text_without_sections_gives_an_empty_record(parsed):
    assert row(parsed, "none1234").name is None


def test_named_columns_only(spark, parsed):
    texts = spark.createDataFrame([("tree/a/md.ini", MINIMAL)], "path string, text string")
    few = catalog.parse_records(texts, ["name"])
    assert few.columns == ["lineage", "name", "languoid_id", "parent_id", "top_id", "depth"]


def test_altnames_are_deduplicated_and_tagged(parsed):
    rows = {tuple(r)[1:] for r in rec.altnames(parsed.where("languoid_id = 'unlu1234'")).collect()}
    assert rows == {
        ("wide (1987)", "Name One", None), ("lexvo", "Name One", "en"), ("lexvo", "Ander", "x-Abc")
    }
    assert rec.altnames(parsed).count() == 3
    assert sorted(r.name for r in rec.distinct_names(parsed).collect()) == ["Ander", "Name One"]


def test_malformed_reference_is_left_out_and_difference_reported(parsed):
    prose = rec.prose_refs(parsed).collect()
    assert [(r.provider, r.key, r.pages) for r in prose] == [("hh", "v:Cat:Comp", "30")]
    (d,) = rec.ref_differences(parsed).collect()
    assert d.only_prose == [] and d.only_list == ["hh:v:Other"]


def test_url_identifiers_are_decoded(parsed):
    ids = {(r.scheme, r.identifier) for r in rec.identifiers(parsed).collect()}
    assert ids == {("multi", "aa"), ("multi", "bb"), ("web", "http://example.org/é;x")}


def test_trigger_match(spark):
    df = spark.createDataFrame(
        [("Gamma and beta words", [["alpha"], ["beta", "gamma"]]), ("betagamma", [["beta", "gamma"]])],
        "title string, alts array<array<string>>",
    )
    got = df.select(refs.trigger_match(F.col("title"), F.col("alts")).alias("m")).collect()
    assert [r.m for r in got] == [True, False]


@pytest.mark.parametrize(
    ("line", "title", "match"),
    [
        ("NOT with AND brick", "Brick houses", True), ("NOT with AND brick", "brick with stone", False),
        ("low AND mid and stone", "Stone, mid-low", True), ("low AND mid and stone", "stone low", False),
        ("qa'poro", "On Qa'poro", True), ("na-na", "the na-na", True), ("not na-ro AND the", "the na", True),
        ("NOT brick", "stone", False), ("nothing AND brick", "brick", False), ("brick", None, None),
    ],
)
def test_trigger_terms(spark, line, title, match):
    df = spark.createDataFrame([([line], title)], "lines array<string>, title string")
    assert df.select(refs.trigger_match(F.col("title"), refs.triggers(F.col("lines"))).alias("m")).first().m == match


def test_trigger_hits_equal_the_direct_test(spark):
    titles = spark.createDataFrame(
        [(1, "red old gear"), (2, "old ring"), (3, "gear of red"), (4, "")], "id int, title string"
    )
    records = spark.createDataFrame(
        [("a", [["red", "gear"], ["ring"]]), ("b", [["old"]]), ("c", [["blue", "gear"]]), ("d", [["gear", "NOT red"], ["NOT old"]]),
         ("e", [["old", "not ring"]])],
        "languoid_id string, triggers array<array<string>>",
    )
    got = {(r.id, r.languoid_id) for r in rec.trigger_hits(titles, records, "id").collect()}
    direct = titles.crossJoin(records).where(refs.trigger_match(F.col("title"), F.col("triggers")))
    assert got == {(r.id, r.languoid_id) for r in direct.collect()} == {
        (1, "a"), (3, "a"), (2, "a"), (1, "b"), (2, "b"), (1, "e")
    }


@pytest.mark.parametrize(
    "text, span", [("1815-01-01/1815-01-01", (1815, 1815)), ("-0500/0100", (-500, 100)), ("now", None)]
)
def test_timespan(spark, text, span):
    got = spark.createDataFrame([(text,)], "t string").select(intervals.timespan(F.col("t")).alias("s")).first().s
    assert (got and tuple(got)) == span


@pytest.mark.parametrize(
    "comment, clauses",
    [
        ("A (a-a) = 9 (Second language only).", [("A", "9", "9", "Second language only")]),
        ("B (b-b) = 6a* (Vigorous). More text.", [("B", "6a", "6a*", "Vigorous")]),
        (
            "Quor (41-) = Vulnerable; Ressu (7-qqa, qqb) = Severely endangered (perhaps 3 speakers) ['q']",
            [("Quor", None, "Vulnerable", None), ("Ressu", None, "Severely endangered", "perhaps 3 speakers")],
        ),
        ("nothing here", []),
    ],
)
def test_comment_clauses(spark, comment, clauses):
    df = spark.createDataFrame([(comment,)], "c string").select(F.inline(st.comment_clauses(F.col("c"))))
    assert [(r.name, r.grade, r.label, r.remark) for r in df.collect()] == clauses


def test_grades_fall_into_one_status_each(spark):
    grades = spark.createDataFrame([(g,) for g in st.GRADE_ORDER], "grade string")
    statuses = lookups.default_statuses(spark)
    got = {r.grade: r.grade_status for r in status_ops.status_from_grade(grades, statuses).collect()}
    assert len(got) == len(st.GRADE_ORDER)
    assert [got[g] for g in ("0", "6a", "6b", "7", "8a", "8b", "9", "10")] == [
        "not endangered", "not endangered", "threatened", "shifting", "moribund", "nearly extinct",
        "extinct", "extinct",
    ]


def test_lookup_defaults(spark):
    text = "[DEFAULT]\ncurrent = True\nord = 9\nname = \n[a]\nname = X\ncurrent = False\n[b]\nord = 1\n"
    df = spark.createDataFrame([(text,)], "text string")
    rows = lookups.parse_lookup(df, {"name": "string", "ord": "int", "current": "boolean"}).collect()
    assert [tuple(r) for r in rows] == [("a", "X", 9, False), ("b", None, 1, True)]


def test_index_round_trip(spark, parsed):
    built = index_pages.build_index(parsed.where("name IS NOT NULL"))
    entries = index_pages.parse_index_lines(built.select(F.col("line").alias("value")))
    assert {(r.name, r.languoid_id, r.iso639_3) for r in entries.collect()} == {
        ("Ünlü (West)", "unlu1234", "zzx"), ("Root", "root1234", None), ("A", "3dup1234", None)
    }
    assert index_pages.index_problems(entries, parsed).count() == 0
    gone = index_pages.index_problems(entries, parsed.where("depth = 2")).collect()
    assert {(r.languoid_id, r.problem) for r in gone} == {("root1234", "missing"), ("3dup1234", "missing")}


def test_compile_from_files(spark, tmp_path):
    for ids, text in ((["root1234"], MINIMAL), (["root1234", "unlu1234"], FULL)):
        folder = tmp_path.joinpath("tree", *ids)
        folder.mkdir(parents=True, exist_ok=True)
        folder.joinpath("md.ini").write_text(text, encoding="utf-8")
    table = catalog.compile_catalog(spark, str(tmp_path / "tree"), str(tmp_path / "out"))
    assert {(r.languoid_id, r.level, r.name) for r in table.collect()} == {
        ("root1234", "family", "Root"), ("unlu1234", "language", "Ünlü (West)")
    }
    index_pages.write_index(index_pages.build_index(table), str(tmp_path / "index"))
    assert spark.read.text(str(tmp_path / "index")).count() == 2


def test_best_document(spark):
    docs = spark.createDataFrame(
        [("a", "d2", "grammar"), ("a", "d1", "grammar"), ("a", "d0", "grammar_sketch"), ("b", "d9", "unknown")],
        "e string, d string, kind string",
    )
    got = status_ops.best_document(docs, lookups.default_document_types(spark), "e", "d", "kind").collect()
    # A document of unknown kind is better than none.
    assert sorted(tuple(r) for r in got) == [("a", "d1", 1), ("b", "d9", None)]


def test_lookup_files(spark, tmp_path):
    text = "[DEFAULT]\nicon = dot\n\n[press]\nname = Some Press\nplace = Here\n\n[deposit]\nversion = 0.1\nlicense_id = L-1\nkeywords = k\n"
    (tmp_path / "publication.ini").write_text(text)
    got = {r.id: r for r in lookups.read_lookup(spark, str(tmp_path / "publication.ini"), lookups.PUBLICATION).collect()}
    assert (got["press"].name, got["press"].place, got["press"].version) == ("Some Press", "Here", None)
    assert (got["deposit"].license_id, got["deposit"].keywords) == ("L-1", "k")
    (tmp_path / "levels.ini").write_text("[low]\nordinal = 3\ndescription = Lowest\n[top]\nordinal = none\n")
    got = {tuple(r) for r in lookups.read_lookup(spark, str(tmp_path / "levels.ini"), lookups.LEVELS).collect()}
    assert got == {("low", 3, "Lowest"), ("top", None, None)}


def test_index_pages_are_read(spark, tmp_path):
    (tmp_path / "page.md").write_text("# Page\n\n- [Abc [abcd1234][qqq]](tree/root1234/abcd1234/md.ini)\n- [Def [defg1234]](tree/defg1234/md.ini)\n")
    got = [(r.name, r.languoid_id, r.iso639_3, r.lineage) for r in index_pages.read_index(spark, str(tmp_path / "page.md")).collect()]
    assert got == [("Abc", "abcd1234", "qqq", ["root1234", "abcd1234"]), ("Def", "defg1234", None, ["defg1234"])]
    records = spark.createDataFrame(
        [("abcd1234", None, ["root1234", "abcd1234"])], "languoid_id string, name string, lineage array<string>"
    )
    found = index_pages.index_problems(index_pages.read_index(spark, str(tmp_path / "page.md")), records).collect()
    assert {(r.languoid_id, r.problem) for r in found} == {("abcd1234", "name"), ("defg1234", "missing")}


def test_only_the_sections_of_the_columns_are_taken_apart(spark):
    text = FULL + "\n[core]\nname = Second\n"
    df = spark.createDataFrame([("x/tree/a/md.ini", text)], "path string, text string")
    whole = catalog.parse_records(df).first()
    for column in catalog.RECORD_COLUMNS:
        assert catalog.parse_records(df, (column,)).first()[column] == whole[column]
    sections = df.select(ini.parse_ini(F.col("text"), ["core"]).alias("ini")).first()["ini"]
    assert list(sections) == ["core"] and sections["core"]["name"]["inline"] == "Ünlü (West)"


def test_texts_of_one_row_group_are_spread_over_tasks(spark, tmp_path):
    from lacuna.plans import inputs

    rows = spark.range(5000).selectExpr(
        "id AS c_custkey", "concat('C', id) AS c_name", "int(id % 25) AS c_nationkey", "double(id) AS c_acctbal", "'BUILDING' AS c_mktsegment"
    )
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("nation", "region"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    texts = inputs.customer_texts(spark, str(tmp_path))
    sizes = texts.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 5000 and len(sizes) > 1
