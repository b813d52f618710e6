"""URL parsing, rules and templates."""

import duckdb
import pandas as pd
import pytest

from lacuna.llm import urls
from lacuna.llm.queries import QUERIES, URL_RULES
from lacuna.llm.store import Store
from lacuna.llm.url_sql import verdict_sql

SCHEMA = "page_id long, url string"


def run(spark, rows, rules=URL_RULES):
    return urls.judge(spark.createDataFrame(rows, SCHEMA), rules, Store(spark, "urls-test"))


def compare(spark, rows):
    found = [tuple(r) for r in run(spark, rows).collect()]
    pages = pd.DataFrame({"page_id": pd.array([r[0] for r in rows], "Int64"), "url": pd.array([r[1] for r in rows], "string")})
    with duckdb.connect() as c:
        c.register("pages", pages)
        wanted = c.execute(verdict_sql(URL_RULES)).fetchall()
    key = lambda r: [repr(x if not isinstance(x, float) else round(x, 9)) for x in r]
    assert sorted(map(key, found)) == sorted(map(key, wanted))
    return {r[0]: r[1:] for r in found}


def test_edge_cases(spark):
    rows = [
        (1, None), (2, ""), (3, "no host"), (4, "http://ORG"), (5, "http://Org/"), (6, "http://a.example.org/es/1?x=/y"),
        (7, "http://notexample.org/es/"), (8, "http://fr.com/fr/"), (9, "x://com"), (10, "http://É.net/Ä/b#c?d"),
        (11, "http://h.net//a//"), (12, "http://h.net/" + "s/" * 3000), (12, "http://h.net/a b\nc"), (13, "a://b://c/d"),
    ]
    found = compare(spark, rows)
    assert found[1][:3] == ("", "", None)
    assert found[4][:3] == ("org", "", None)
    assert found[5][:4] == ("org", "/", "org/", "allow")
    assert found[6][:4] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert found[7][2] == "org/"
    assert found[13][:2] == ("b:", "//c/d")


def test_templates_of_one_hot_host(spark):
    rows = [(i, f"http://shop.com/{'de' if i % 3 else 'fr'}/item{'abcdefghijklmnopqrst'[i % 20]}/x") for i in range(400)]
    rows += [(1000 + i, f"http://shop.com/de-old/page{i}") for i in range(10)]
    found = compare(spark, rows)
    # Twenty names of items are one wildcard; the bad and the good branch stay apart.
    assert {r[4] for i, r in found.items() if i < 400} == {"/de/*/x", "/fr/*/x"}
    assert [r[5] > 0.9 for i, r in sorted(found.items()) if i < 2] == [False, True]


def test_a_template_is_rejected_by_its_labels(spark):
    rules = [("bad.com", "/x/1", "block"), ("bad.com", "/x/2", "block")]
    rows = [(i, f"http://bad.com/x/{i}") for i in range(100, 300)] + [(i, f"http://good.com/x/{i}") for i in range(300, 400)]
    found = {r.page_id: r for r in run(spark, rows + [(900, "http://bad.com/x/900")], rules).collect()}
    assert (found[900].rule, found[900].verdict) == (None, "block")
    assert found[350].verdict == "allow"


@pytest.mark.parametrize("sections", [5, 7, 8, 12, 50])
def test_a_bad_section_is_told_whatever_the_number_of_sections(spark, sections):
    rules = [("site.net", "/s0/known", "block")] + [("site.net", f"/s{n}/known", "allow") for n in range(1, sections)]
    rules = [(h, p.replace("/s", "/sec").translate(str.maketrans("0123456789", "abcdefghij")), v) for h, p, v in rules]
    rows = []
    for n in range(sections):
        name = f"/sec{n}".translate(str.maketrans("0123456789", "abcdefghij"))
        rows += [(1000 * n + i, f"http://site.net{name}/known{i}") for i in range(30)] + [(1000 * n + 900, f"http://site.net{name}/knew")]
    found = {r.page_id: r.verdict for r in run(spark, rows, rules).collect()}
    assert [found[1000 * n + 900] for n in range(sections)] == ["block"] + ["allow"] * (sections - 1)


def test_mixed_labels_far_down(spark):
    deep = "/".join(["a"] * 10)
    rules = [("deep.net", f"/{deep}/bad/known", "block"), ("deep.net", f"/{deep}/good/known", "allow")]
    rows = [(i, f"http://deep.net/{deep}/{'bad' if i % 2 else 'good'}/known{i}") for i in range(80)]
    rows += [(900, f"http://deep.net/{deep}/bad/new"), (901, f"http://deep.net/{deep}/good/new")]
    found = {r.page_id: r for r in run(spark, rows, rules).collect()}
    assert (found[900].verdict, found[901].verdict) == ("block", "allow")
    assert found[900].template == f"/{deep}/bad/**"


def test_empty_table(spark):
    assert run(spark, []).collect() == []


@pytest.mark.parametrize("rules", [[], [("a", "/", "allow"), ("a", "/", "block")]])
def test_odd_rules(spark, rules):
    assert run(spark, [(1, "http://a/b")], rules).count() == 1


def test_documents_query(spark):
    assert QUERIES["op3_url_templates"].run(spark, "/root/testdata/sf0.001").count() == 50
