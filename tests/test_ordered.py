"""Running values, as-of joins, range frames and isotonic fits against plain loops."""

import random
from collections import defaultdict
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna.eval.isotonic import IsotonicCalibration, pool
from lacuna.operators import ordered

SCHEMA = "k string, t int, id int, v long"


def made(n, hot=0.5, seed=0):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        k = "hot" if draw.random() < hot else draw.choice(["a", "b", None, "z"])
        rows.append((k, draw.choice([None, *range(n // 3)]), i, draw.choice([None, *range(-50, 50)])))
    return rows


def key(x):
    return (x is not None, x if x is not None else 0)


@pytest.mark.parametrize("by", [[], ["k"]])
def test_scan(spark, by):
    rows = made(400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    values = {
        "total": ordered.running_sum(F.col("v")), "most": ordered.running_max(F.col("v")), "least": ordered.running_min(F.col("v")),
        "last": ordered.last_value(F.col("v")), "before": ordered.previous(F.col("v")), "nth": ordered.row_number(),
    }
    found = {r.id: r for r in ordered.scan(df, ["t", "id"], values, by).collect()}
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (key(r[1]), r[2])):
        groups[r[0] if by else 0].append(r)
    assert len(found) == len(rows)
    for group in groups.values():
        seen = []
        for nth, r in enumerate(group, 1):
            f = found[r[2]]
            assert f.before == (group[nth - 2][3] if nth > 1 else None)
            seen += [r[3]] if r[3] is not None else []
            wanted = (sum(seen), max(seen), min(seen), seen[-1]) if seen else (None,) * 4
            assert (f.total, f.most, f.least, f["last"]) == wanted
            assert f.nth == nth
            assert (f.k, f.t, f.v) == (r[0], r[1], r[3])


def test_a_hot_key_is_spread(spark):
    df = spark.range(4000).select(F.lit("one").alias("k"), "id")
    ranged = ordered.in_ranges(df, ["k"], ["id"])
    assert ranged.groupBy("_range").count().agg(F.max("count")).first()[0] < 1500


def test_numbered(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "name string")
    assert {r.name: r.i for r in ordered.numbered(df, ["name"], "i").collect()} == {None: 0, "a": 1, "b": 2, "c": 3}


@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, strict):
    left, right = made(300, seed=1), made(200, seed=2)
    l = spark.createDataFrame(left, SCHEMA)
    r = spark.createDataFrame(right, SCHEMA).withColumnRenamed("t", "u").withColumnRenamed("id", "other").withColumnRenamed("v", "w")
    found = {x.id: x for x in ordered.as_of_join(l, r, ["k"], "t", "u", ["w", "other"], strict, ties=["other"]).collect()}
    assert len(found) == len(left)
    for k, t, i, v in left:
        fits = [x for x in right if None not in (k, t, x[1]) and x[0] == k and (x[1] < t or (x[1] == t and not strict))]
        wanted = max(fits, key=lambda x: (x[1], x[2]), default=(None,) * 4)
        assert (found[i].w, found[i].other) == (wanted[3], wanted[2])
        assert (found[i].k, found[i].t, found[i].v) == (k, t, v)


def test_as_of_without_rows(spark):
    empty, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a", 1, 1, 1)], SCHEMA)
    other = some.select("k", F.col("t").alias("u"), F.col("v").alias("w"))
    assert ordered.as_of_join(empty, other, ["k"], "t", "u", ["w"]).count() == 0
    assert ordered.as_of_join(some, other.limit(0), ["k"], "t", "u", ["w"]).first().w is None


@pytest.mark.parametrize("by", [[], ["k"]])
def test_range_sum(spark, by):
    rows = made(250, seed=3)
    found = {r.id: r.s for r in ordered.range_sum(spark.createDataFrame(rows, SCHEMA), "v", "t", 7, "s", by).collect()}
    for k, t, i, _ in rows:
        near = [x[3] for x in rows if None not in (t, x[1]) and t - 7 <= x[1] <= t and (not by or x[0] == k)]
        known = [v for v in near if v is not None]
        assert (found[i] or 0) == sum(known)


def quadratic(rows):
    """Means that rise, by the formula of the largest over the smallest averages."""
    n = len(rows)
    out = []
    for i in range(n):
        out.append(max(
            min(Fraction(sum(y for _, _, y in rows[a : b + 1]), sum(w for _, w, _ in rows[a : b + 1])) for b in range(i, n))
            for a in range(i + 1)
        ))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 4)), max_size=12))
def test_pool(pairs):
    rows = [(i, n, min(n, y)) for i, (n, y) in enumerate(pairs)]
    blocks = pool((0, 0, x, x, n, y) for x, n, y in rows)
    fitted = [Fraction(b[5], b[4]) for b in blocks for x in range(b[2], b[3] + 1)]
    assert fitted == quadratic(rows)


@pytest.mark.parametrize("kind", ["noise", "falling", "rising", "flat"])
def test_isotonic(spark, kind):
    draw = random.Random(kind)
    rows = []
    for i in range(240):
        p = draw.randrange(60) / 60
        y = {"noise": draw.random() < p, "falling": draw.random() > p, "rising": p > 0.5, "flat": i % 2}[kind]
        rows.append((draw.choice(["a", "b", None]), p, int(y)))
    rows += [("a", None, 1), ("a", 0.5, None), ("b", float("nan"), 1)]
    df = spark.createDataFrame(rows, "g string, probability double, outcome int")
    fitted = IsotonicCalibration(["g"]).fit(df)
    blocks = fitted.table().collect()
    applied = {(r.g, r.probability): r.calibrated for r in fitted.apply(df).where("probability >= 0 AND NOT isnan(probability)").collect()}
    for g in ("a", "b", None):
        seen = defaultdict(lambda: [0, 0])
        for x, p, y in rows:
            if x == g and p is not None and p == p and y is not None:
                seen[p][0] += 1
                seen[p][1] += y
        scores = sorted(seen)
        wanted = quadratic([(p, *seen[p]) for p in scores])
        for p, w in zip(scores, wanted):
            assert applied[g, p] == float(w)
        mine = sorted((b.lo, b.hi, b.n, b.positives) for b in blocks if b.g == g)
        assert [Fraction(b[3], b[2]) for b in mine] == sorted(set(wanted))
        assert sum(b[2] for b in mine) == sum(n for n, _ in seen.values())


def test_isotonic_of_new_scores(spark):
    df = spark.createDataFrame([(0.2, 0), (0.4, 1), (0.6, 1)], "probability double, outcome int")
    fitted = IsotonicCalibration().fit(df)
    new = spark.createDataFrame([(0.0,), (0.3,), (0.9,), (None,)], "probability double")
    assert {r.probability: r.calibrated for r in fitted.apply(new).collect()} == {0.0: 0.0, 0.3: 0.0, 0.9: 1.0, None: None}
    assert fitted.fit(df.limit(0)).table().count() == 0
