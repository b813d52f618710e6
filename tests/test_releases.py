"""Differences of releases, and the catalogue that follows a stream, against plain loops."""

import datetime
import random

from lacuna.operators import releases
from lacuna.streaming.catalog_log import VERSION, CatalogLog, read_versions


def made(seed=0, n=300):
    draw, nodes = random.Random(seed), {("a",): "x", ("b",): None}
    while len(nodes) < n:
        nodes[(*draw.choice(list(nodes)), f"i{len(nodes)}")] = draw.choice(["x", "y", None])
    return nodes


def frame(spark, nodes):
    return spark.createDataFrame([(list(p), v) for p, v in nodes.items()], "lineage array<string>, name string")


def diff(spark, old, new):
    sides = [releases.store_digests(frame(spark, x), ["name"]) for x in (old, new)]
    found = releases.compare(*sides)
    return {r.languoid_id: r.change for r in found.changes.collect()}, found.compared


def test_release_diff(spark):
    old = made()
    new, draw = dict(old), random.Random(1)
    for p in draw.sample(sorted(p for p in old if len(p) > 2), 12):
        v = new.pop(p)
        kind = draw.randrange(3)
        if kind == 0:
            new[p] = "changed"
        elif kind == 1:
            new[("b", p[-1])] = v
    new[("c", "fresh")] = "x"
    at = {p[-1]: (p, v) for p, v in old.items()}, {p[-1]: (p, v) for p, v in new.items()}
    wanted = {}
    for i in at[0].keys() | at[1].keys():
        a, b = at[0].get(i), at[1].get(i)
        if a != b:
            wanted[i] = "added" if a is None else "removed" if b is None else "changed" if a[0] == b[0] else "moved"
    assert diff(spark, old, new)[0] == wanted


def test_little_is_read_where_little_changed(spark):
    old = {("r", f"f{i}", f"l{j}x{i}"): "x" for i in range(40) for j in range(50)}
    new = dict(old) | {("r", "f7", "l3x7"): "y"}
    found, compared = diff(spark, old, new)
    assert found == {"l3x7": "changed"} and compared <= 1 + 40 + 50
    assert diff(spark, old, old) == ({}, 1)
    assert diff(spark, {}, {("a",): "x"})[0] == {"a": "added"}


def version(i, text, day):
    return f"file:/t/{i}/md.ini", text, datetime.datetime(2024, 1, day)


BATCHES = [
    [version(1, "one", 5), version(2, "two", 5), version(3, "three", 5)],
    [version(1, "uno", 6), version(2, "old", 4), version(2, "two", 5), version(3, None, 7)],
    [version(3, "late", 6), version(4, "four", 1)],
]
WANTED = {"file:/t/1/md.ini": "uno", "file:/t/2/md.ini": "two", "file:/t/4/md.ini": "four"}


def write(spark, folder, rows):
    spark.createDataFrame(rows, VERSION).coalesce(1).write.mode("append").parquet(folder)


def test_batches_equal_one_batch(spark, tmp_path):
    three, one = CatalogLog(spark, str(tmp_path / "three")), CatalogLog(spark, str(tmp_path / "one"))
    for n, rows in enumerate(BATCHES):
        write(spark, str(tmp_path / "in"), rows)
        three.follow(read_versions(spark, str(tmp_path / "in"), files_per_batch=1), "30 days")
        if n == 1:
            three.snapshot()
    one.follow(read_versions(spark, str(tmp_path / "in")), "30 days")
    for log in (three, one):
        assert {r.path: r.text for r in log.current().collect()} == WANTED
    one.snapshot()
    assert {r.path: r.text for r in one.current().collect()} == WANTED


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    log = CatalogLog(spark, str(tmp_path / "log"))
    assert log.current().count() == 0
    for n, rows in enumerate(BATCHES):
        for _ in range(2):
            log.write_batch(spark.createDataFrame(rows, VERSION), n)
    assert {r.path: r.text for r in log.current().collect()} == WANTED
    assert log.latest().count() == 4
