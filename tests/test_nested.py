"""Nested intervals, spans of any length, sketches, balanced folds and metric intervals against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lacuna.eval.balanced import BalancedSplit
from lacuna.eval.intervals import MetricIntervals, poisson
from lacuna.eval.metrics import compute_binary_metrics
from lacuna.operators import sketches, timespans
from lacuna.operators.nested import NestedTree, with_intervals


def paths(seed=0, n=200):
    draw, nodes = random.Random(seed), [("a",), ("b",)]
    while len(nodes) < n:
        nodes.append((*draw.choice(nodes), f"x{len(nodes)}"))
    return nodes


def frame(spark, nodes):
    return spark.createDataFrame([(p[-1], list(p)) for p in nodes], "languoid_id string, lineage array<string>").repartition(4)


def test_intervals(spark):
    nodes = paths()
    order = {p: i for i, p in enumerate(sorted(nodes))}
    found = {r.languoid_id: (r.enter, r.leave) for r in with_intervals(frame(spark, nodes)).collect()}
    for p in nodes:
        below = [order[q] for q in nodes if q[: len(p)] == p]
        assert found[p[-1]] == (min(below), max(below)) and max(below) - min(below) + 1 == len(below)


def rows_scanned(df):
    """Rows that the plan's scan has put out."""
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().get("numOutputRows").get().value()


def test_a_subtree_reads_few_row_groups(spark):
    nodes = [("root",)] + [("root", f"f{i:02}") for i in range(40)] + [("root", f"f{i:02}", f"l{i:02}{j:04}") for i in range(40) for j in range(500)]
    nested = NestedTree.store(frame(spark, nodes), row_group_bytes=1024)
    below = nested.descendants("f07")
    assert {r.languoid_id for r in below.collect()} == {f"l07{j:04}" for j in range(500)}
    assert 500 <= rows_scanned(below) < len(nodes) / 4
    assert nested.descendants("l070001").count() == 0 and nested.descendants("none").count() == 0
    assert [r.languoid_id for r in nested.ancestors("l070001").orderBy("enter").collect()][0] == "root"


def test_subtree_and_ancestors(spark):
    nodes = paths(1)
    nested = NestedTree.store(frame(spark, nodes))
    for p in random.Random(2).sample(nodes, 3):
        assert {r.languoid_id for r in nested.descendants(p[-1]).collect()} == {q[-1] for q in nodes if q[: len(p)] == p and q != p}
        assert {r.languoid_id for r in nested.ancestors(p[-1]).collect()} == set(p[:-1])


FAR = 2**31


def test_spans_of_any_length(spark):
    draw = random.Random(3)
    spans = [("all", -FAR, FAR - 1), ("first", -FAR, -FAR), ("last", FAR - 1, FAR - 1), ("none", 5, 4), ("twice", 0, 0), ("twice", 0, 0)]
    for i in range(120):
        start, length = draw.randrange(-FAR, FAR), 2 ** draw.randrange(32)
        spans.append((f"i{i}", start, min(FAR - 1, start + length - 1)))
        spans.append((f"s{i}", s := draw.randrange(-40, 40), s + draw.randrange(30)))
    df = spark.createDataFrame(spans, "id string, start_year int, end_year int")
    good = [s for s in spans if s[1] <= s[2]]
    brute = Counter((a[0], b[0]) for a in good for b in good if a[1] <= b[2] and b[1] <= a[2])
    assert Counter(tuple(p) for p in timespans.overlap_pairs(df, df).collect()) == brute


def test_rows_of_a_span_are_bounded(spark):
    df = spark.createDataFrame([(-FAR + 1, FAR - 2), (0, 0), (-5, 1000)], "s int, e int")
    nodes = df.select("s", "e", timespans._nodes(F.col("s"), F.col("e")).alias("n")).collect()
    for r in nodes:
        assert len(r.n) <= 2 * 33
        covered = sorted((x.number << x.size, (x.number + 1) << x.size) for x in r.n)
        assert covered[0][0] == r.s + 2**32 and covered[-1][1] == r.e + 1 + 2**32
        assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


def test_sketches(spark):
    draw = random.Random(4)
    rows = [(list(p), draw.choice([None, *range(3000)])) for p in paths(5, 40) for _ in range(200)]
    df = spark.createDataFrame(rows, "lineage array<string>, v int")
    exact = {tuple(r.prefix): r.n_distinct for r in sketches.exact_by_prefix(df, "v").collect()}
    found = {tuple(r.prefix): r.estimate for r in sketches.distinct_by_prefix(df, "v").collect()}
    brute = {}
    for p, v in rows:
        for i in range(1, len(p) + 1):
            brute.setdefault(tuple(p[:i]), set()).update([v] if v is not None else [])
    assert exact == {p: len(v) for p, v in brute.items()} and found.keys() == exact.keys()
    assert all(abs(found[p] - n) <= 4 * sketches.standard_error(12) * n + 0.5 for p, n in exact.items())


def test_tasks_of_exact_counts_are_as_many_as_the_rows_need(spark, monkeypatch):
    monkeypatch.setattr(sketches, "TASK_ROWS", 100)
    rows = [(["a", f"b{i % 3}", f"c{i % 50}"], i % 4001) for i in range(8000)]
    df = spark.createDataFrame(rows, "lineage array<string>, v int")
    found = sketches.values_by_prefix(df, "v")
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    pairs = {(tuple(p[:i]), v) for p, v in rows for i in (1, 2, 3)}
    assert sum(sizes) == len(pairs) and max(sizes) <= 200  # a task had what 64 MB of narrow rows expand to
    brute = Counter(p for p, _ in pairs)
    assert {tuple(r.prefix): r.n_distinct for r in sketches.exact_by_prefix(df, "v").collect()} == brute
    assert sketches.exact_by_prefix(df.where("v < 0"), "v").count() == 0


def test_balanced_folds(spark):
    draw = random.Random(5)
    cells = [(i, draw.choice(["big"] * 5 + ["a", "b", "c", "d", None])) for i in range(300)]
    split = BalancedSplit(folds=3)
    found = split.assign(spark.createDataFrame(cells, "id int, family string")).collect()
    assert len(found) == 300
    folds = {}
    for r in found:
        assert folds.setdefault(r.family, r.fold) == r.fold
    sizes = Counter(r.fold for r in found)
    assert max(sizes.values()) - min(sizes.get(f, 0) for f in range(3)) <= max(Counter(f for _, f in cells).values())


def test_poisson_draws_have_mean_and_variance_one(spark):
    w = spark.range(100_000).select(poisson((F.col("id") + 0.5) / 100_000).alias("w"))
    mean, variance = w.agg(F.avg("w"), F.var_pop("w")).first()
    assert mean == pytest.approx(1, abs=1e-3) and variance == pytest.approx(1, abs=5e-3)


def test_metric_intervals(spark):
    draw = random.Random(6)
    rows = [(i // 5, int(draw.random() < 0.5), int(draw.random() < 0.5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "entity_id int, gold int, pred int")
    point = compute_binary_metrics(df).first()
    found = {r.metric: (r.low, r.high) for r in MetricIntervals(replicates=60).run(df).collect()}
    for metric, (low, high) in found.items():
        assert low < point[metric] < high and high - low < 0.1
    again = {r.metric: (r.low, r.high) for r in MetricIntervals(replicates=60).run(df.repartition(3)).collect()}
    assert again == found
