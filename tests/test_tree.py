"""Tree, levels, retirement, intervals and distances."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lacuna.functions.geo import haversine_km
from lacuna.operators import geo, levels, retirement, timespans, tree
from lacuna.sources.catalog import with_lineage


def make(spark, rows):
    df = spark.createDataFrame([(p.split("/"), level) for p, level in rows], "lineage array<string>, level string")
    return with_lineage(df)


@pytest.fixture(scope="module")
def records(spark):
    return make(
        spark,
        [("a/b/c", "language"), ("a/b/c/d", "dialect"), ("a/e", "language"), ("x", "language"), ("a/f/g/h", "dialect")],
    ).cache()


def test_nodes_from_paths(records):
    got = {(r.languoid_id, r.depth, r.has_record, r.level) for r in tree.nodes_from_paths(records, "level").collect()}
    assert got == {
        ("a", 1, False, None), ("b", 2, False, None), ("c", 3, True, "language"), ("d", 4, True, "dialect"),
        ("e", 2, True, "language"), ("x", 1, True, "language"), ("f", 2, False, None), ("g", 3, False, None),
        ("h", 4, True, "dialect"),
    }


def test_closure(records):
    got = {(r.ancestor_id, r.distance) for r in tree.ancestors(records, "d").collect()}
    assert got == {("c", 1), ("b", 2), ("a", 3)}
    assert {r.languoid_id for r in tree.descendants(records, "b").collect()} == {"c", "d"}
    assert tree.closure(records).count() == 3 + 4 + 2 + 1 + 4
    assert [r.languoid_id for r in tree.isolates(records).collect()] == ["x"]


@pytest.mark.parametrize(
    "a, b, lca, distance",
    [("a/b/c", "a/b/d", "b", 2), ("a/b", "a/b/c/d", "b", 2), ("a", "a", "a", 0), ("a/b", "x/b", None, 4)],
)
def test_lca(spark, a, b, lca, distance):
    df = spark.createDataFrame([(a.split("/"), b.split("/"))], "a array<string>, b array<string>")
    r = df.select(
        tree.lowest_common_ancestor(F.col("a"), F.col("b")).alias("l"), tree.tree_distance(F.col("a"), F.col("b")).alias("d")
    ).first()
    assert (r.l, r.d) == (lca, distance)


def test_level_violations(spark):
    bad = make(
        spark,
        [("a", "family"), ("a/b", "dialect"), ("c", "dialect"), ("d", "language"), ("d/e", "language"), ("d/f", "family"),
         ("m/n", "dialect")],
    )
    got = {(r.languoid_id, r.rule) for r in levels.level_violations(bad).collect()}
    assert got == {
        ("b", "dialect under family"), ("c", "top-level dialect"), ("e", "language not under family"),
        ("f", "level above its parent"),
    }


def test_infer_levels(spark):
    shown = make(
        spark,
        [
            ("p/q/r", "language"),  # p, q are families
            ("p/s/t", "dialect"),  # s: under a family, with a dialect: language
            ("u/v", "dialect"),  # u: a root with a dialect: language
            ("w/x/y", "dialect"),  # w, x: open (w language and x dialect, or w family and x language)
            ("k", "language"), ("k/l/m", "dialect"),  # l: below a language: dialect
        ],
    )
    nodes = tree.nodes_from_paths(shown, "level")
    got = {r.languoid_id: r.inferred_level for r in levels.infer_levels(nodes).where("level IS NULL").collect()}
    assert got == {"p": "family", "q": "family", "s": "language", "u": "language", "w": None, "x": None, "l": "dialect"}


def test_inference_agrees_with_all_valid_labelings(spark):
    """On random trees a level is inferred if and only if every valid labeling has it."""
    rng = random.Random(3)
    for _ in range(3):
        parent = {0: None}
        for n in range(1, 9):
            parent[n] = rng.randrange(n)

        def valid(lab):
            for n, p in parent.items():
                up = lab[p] if p is not None else None
                if lab[n] == "d" and up in (None, "f"):
                    return False
                if lab[n] == "l" and up not in (None, "f"):
                    return False
                if lab[n] == "f" and up not in (None, "f"):
                    return False
            return True

        labelings = [lab for lab in itertools.product("fld", repeat=len(parent)) if valid(lab)]
        truth = rng.choice(labelings)
        children = set(parent.values())
        hidden = {n for n in parent if n in children and rng.random() < 0.6}
        fits = [lab for lab in labelings if all(lab[n] == truth[n] for n in parent if n not in hidden)]
        names = {"f": "family", "l": "language", "d": "dialect"}
        expect = {
            f"n{n}": names[fits[0][n]] if len({lab[n] for lab in fits}) == 1 else None for n in hidden
        }

        def line(n):
            return [] if n is None else [*line(parent[n]), f"n{n}"]

        df = spark.createDataFrame(
            [(line(n), names[truth[n]]) for n in parent if n not in hidden], "lineage array<string>, level string"
        )
        nodes = tree.nodes_from_paths(with_lineage(df), "level")
        got = {r.languoid_id: r.inferred_level for r in levels.infer_levels(nodes).where("level IS NULL").collect()}
        assert got == expect


def test_resolve_codes(spark):
    changes = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("s", "x"), ("s", "a"), ("n", None), ("m", "n"), ("p", "q"), ("q", "p")],
        "code string, target string",
    )
    got = {tuple(r) for r in retirement.resolve_codes(spark, changes).select("code", "final", "status").collect()}
    assert got >= {("a", "c", "current"), ("b", "c", "current"), ("s", "x", "current"), ("s", "c", "current"),
                   ("n", None, "none"), ("m", "n", "none")}
    assert {(f, s) for c, f, s in got if c in "pq"} == {(None, "cycle")}


def test_resolve_long_chains(spark):
    edges = [(f"c{i:02}", f"c{i + 1:02}") for i in range(50)] + [("in", "c00"), ("in", "x"), ("x", "y"), ("y", "z"), ("z", "x")]
    found = retirement.resolve_codes(spark, spark.createDataFrame(edges, "code string, target string")).collect()
    ends = {(r.code, r.status): (r.final, r.hops) for r in found}
    assert len(ends) == len(found)
    assert all(ends[f"c{i:02}", "current"] == ("c50", 50 - i) for i in range(50))
    assert ends["in", "current"] == ("c50", 51)
    assert {c for c, s in ends if s == "cycle"} == {"in", "x", "y", "z"}


def test_overlaps_against_brute_force(spark):
    rng = random.Random(1)
    spans = [(f"i{n}", s := rng.randrange(-60, 60), s + rng.randrange(0, 30)) for n in range(60)]
    df = spark.createDataFrame(spans, "id string, start_year int, end_year int")
    brute = {(a[0], b[0]) for a in spans for b in spans if a[1] <= b[2] and b[1] <= a[2]}
    pairs = timespans.overlap_pairs(df, df).collect()
    assert len(pairs) == len(brute) and {tuple(p) for p in pairs} == brute
    spans_of = timespans.overlap_spans(df, df).agg(F.sum("n_pairs")).first()[0]
    assert spans_of == len(brute)
    counts = {r.id: r.n_overlaps for r in timespans.overlap_counts(df, df).collect()}
    assert counts == {a[0]: sum(1 for x, _ in brute if x == a[0]) for a in spans}


def test_haversine(spark):
    km = spark.range(1).select(haversine_km(F.lit(14.2584), F.lit(13.1571), F.lit(11.852298), F.lit(13.157959))).first()[0]
    assert km == pytest.approx(267.5467, abs=1e-4)


@pytest.mark.parametrize("k, cube_places", [(1, 64), (4, 3)])
def test_nearest_places_against_brute_force(spark, k, cube_places):
    rng = random.Random(2)
    places = [(f"p{n:03d}", math.degrees(math.asin(rng.uniform(-1, 1))), rng.uniform(-180, 180)) for n in range(80)]
    places += [(f"c{n:03d}", 10 + rng.uniform(0, 0.02), 179.99 + rng.uniform(0, 0.01)) for n in range(40)]
    places += [(f"d{n:03d}", 52.5, 13.4) for n in range(40)]
    places += [("north", 90.0, 0.0), ("n2", 89.9, 170.0), ("n3", 89.9, -10.0), ("date", 10.0, -179.99)]
    places += [(f"far{n}", -60.0 - n / 10, -120.0) for n in range(3)]
    df = spark.createDataFrame(places, "id string, lat double, lon double")

    def km(a, b):
        la, lb = math.radians(a[1]), math.radians(b[1])
        h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return round(2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h))), 6)

    brute = {}
    for a in places:
        near = sorted((km(a, b), b[0]) for b in places if b[0] != a[0])[:k]
        brute[a[0]] = [n for _, n in near]
    got = {}
    for r in sorted(geo.nearest_places(df, df, k, cube_places).collect(), key=lambda r: (r.id, r.rank)):
        got.setdefault(r.id, []).append(r.neighbour_id)
    assert got == brute


def test_pairs_of_a_crowded_cube_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(geo, "TASK_PAIRS", 100)
    cubes = ["cube_level", "cx", "cy", "cz"]
    crowded = spark.range(100).selectExpr("id * 0.1 AS lat", "0.0D AS lon", "16 AS cube_level", "1L AS cx", "2L AS cy", "3L AS cz", "30L AS n")
    lone = spark.range(5).selectExpr("id * 0.1 AS lat", "0.0D AS lon", "3 AS cube_level", "id AS cx", "0L AS cy", "0L AS cz", "1L AS n")
    spots = spark.range(30).selectExpr("id", "16 AS cube_level", "1L AS cx", "2L AS cy", "3L AS cz")
    spots = spots.unionByName(spark.range(5).selectExpr("id", "3 AS cube_level", "id AS cx", "0L AS cy", "0L AS cz"))
    asking, held = geo._dealt(crowded.unionByName(lone), spots, cubes)
    joined = asking.join(held.hint("merge"), [*cubes, "part"])
    rows = joined.select("lat", "id", "cube_level", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == len({(r.lat, r.id, r.cube_level) for r in rows}) == 3005
    tasks = Counter(r.task for r in rows)
    assert len(tasks) > 10 and max(tasks.values()) <= 1000  # one task had all of a cube's


def test_nearest_places_dealt_to_many_tasks_are_the_same(spark, monkeypatch):
    rng = random.Random(7)
    places = [(n, 10 + rng.uniform(0, 0.02), 20 + rng.uniform(0, 0.02)) for n in range(120)]
    df = spark.createDataFrame(places, "id long, lat double, lon double")
    whole = sorted(map(tuple, geo.nearest_places(df, df, 3).collect()))
    monkeypatch.setattr(geo, "TASK_PAIRS", 40)
    assert sorted(map(tuple, geo.nearest_places(df, df, 3).collect())) == whole and len(whole) == 360


def test_nearest_with_fewer_places_than_asked(spark):
    two = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 1.0), ("z", None, None)], "id string, lat double, lon double")
    assert {(r.id, r.neighbour_id) for r in geo.nearest_places(two, two, 5).collect()} == {("a", "b"), ("b", "a")}


def test_overlap_totals_make_no_pairs(spark):
    edge = 2**31 - 1
    spans = [(1, 0, edge), (2, -edge - 1, edge), (3, 5, 5), (4, 9, 3), (5, -7, -6), (6, edge, edge), (7, 2000, 5000)]
    df = spark.createDataFrame(spans, "id long, start_year int, end_year int")
    found = timespans.overlap_totals(df, df, "id")
    brute = {
        (i, sum(s <= f and r <= e for _, r, f in spans if r <= f), sum(j for j, r, f in spans if r <= f and s <= f and r <= e))
        for i, s, e in spans if s <= e
    }
    assert {(r.id, r.n_overlaps, r.total) for r in found.collect()} == brute
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
