"""The digest index: kept, opened again and appended to."""

import hashlib
import re

from lacuna.llm import exact
from lacuna.llm.store import Store

SCHEMA = "doc_id long, text string"


def run(spark, index, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    return {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact.dedup(docs, index, Store(spark, "exact-test")).collect()}


def sha(text):
    return hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", text or "").encode()).hexdigest()


def test_the_index_lasts(spark):
    path = Store(spark, "exact-test").path("index")
    first = run(spark, exact.DigestIndex(spark, path, 4), [(1, "a b"), (2, "a  b"), (3, "c")])
    assert first == {(1, sha("ab")): (2, 2, False), (2, sha("ab")): (2, 2, True), (3, sha("c")): (3, 1, True)}
    again = exact.DigestIndex(spark, path, 4)
    assert again.table.count() == 2
    second = run(spark, again, [(7, "a \t b"), (8, "d"), (9, "D")])
    assert second == {(7, sha("ab")): (2, 1, False), (8, sha("d")): (8, 1, True), (9, sha("D")): (9, 1, True)}
    assert again.table.count() == 4
    # A run that is repeated finds its own rows and adds nothing.
    assert run(spark, exact.DigestIndex(spark, path, 4), [(8, "d"), (9, "D")]) == {
        (8, sha("d")): (8, 1, True), (9, sha("D")): (9, 1, True)
    }
    assert again.table.count() == 4


def test_ties_nulls_and_repeated_rows(spark):
    index, _ = exact.new_index(spark)
    rows = [(5, "xy"), (4, "xy"), (None, "xy"), (1, None), (2, ""), (3, " \n"), (6, "é"), (6, "é"), (None, "z")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = [tuple(r) for r in exact.dedup(docs, index, Store(spark, "exact-test")).collect()]
    assert len(found) == len(rows)
    kept = {(d, h) for d, k, n, keep, h in found if keep}
    # The longest original stays, here the line break and the space.
    assert kept == {(4, sha("xy")), (3, sha("")), (6, sha("é")), (None, sha("z"))}
    assert sorted(n for *_, n, _, h in [(d, k, n, keep, h) for d, k, n, keep, h in found] if h == sha("xy")) == [3, 3, 3]


def test_empty_table_and_other_columns(spark):
    index, store = exact.new_index(spark)
    assert exact.dedup(spark.createDataFrame([], SCHEMA), index, store).count() == 0
    docs = spark.createDataFrame([(1, "a", 2, "x")], "doc_id long, text string, digest int, salt string")
    assert exact.dedup(docs, index, Store(spark, "exact-test")).first().kept
