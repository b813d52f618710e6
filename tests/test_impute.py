"""Imputers on small matrices with known answers."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lacuna.impute import (
    KNNImputer,
    MeanImputer,
    PromptingImputer,
    RandomImputer,
    SoftImputeImputer,
)
from lacuna.impute import neighbours
from lacuna.impute.common import feature_index, fill
from lacuna.impute.neighbours import nearest_in_block
from lacuna.impute.prompts import ICLPrompt, KGPrompt
from lacuna.impute.prompting import parse_reply
from lacuna.kb import KnowledgeBase

CELL = "entity_id string, feature string, value double"


def matrix(spark, rows):
    """{entity: "10?.."} with one character per feature."""
    cells = [
        (e, f"f{i}", None if ch == "?" else float(ch)) for e, line in rows.items() for i, ch in enumerate(line)
    ]
    return spark.createDataFrame(cells, CELL)


def unknown(cells):
    return cells.where("value IS NULL").select("entity_id", "feature")


def answers(df, column="score"):
    return {(r.entity_id, r.feature): r[column] for r in df.collect()}


def random_rows(seed, n, m, known=0.7):
    rng = random.Random(seed)
    return {
        f"e{i:03d}": "".join(rng.choice("01") if rng.random() < known else "?" for _ in range(m)) for i in range(n)
    }


def brute_knn(rows, k, scale=1_000_000):
    out = {}
    for e, a in rows.items():
        for f, ch in enumerate(a):
            if ch != "?":
                continue
            near = []
            for o, b in rows.items():
                both = [(x, y) for x, y in zip(a, b) if x != "?" and y != "?"]
                if o != e and both and b[f] != "?":
                    near.append((scale * sum(x != y for x, y in both) // len(both), o, int(b[f])))
            near.sort()
            if near:
                out[e, f"f{f}"] = sum(v for *_, v in near[:k]) / len(near[:k])
    return out


def test_mean_and_its_fallbacks(spark):
    cells = matrix(spark, {"a": "11?", "b": "10?", "c": "???"})
    got = answers(MeanImputer().impute(cells, unknown(cells)))
    assert got["c", "f0"] == 1.0 and got["c", "f1"] == 0.5
    assert got["a", "f2"] == got["c", "f2"] == 0.75  # nothing known: mean of all known cells
    nothing = matrix(spark, {"a": "??"})
    assert set(answers(MeanImputer().impute(nothing, unknown(nothing))).values()) == {0.5}


def test_random_is_repeatable_and_partition_independent(spark):
    cells = matrix(spark, random_rows(1, 20, 6))
    targets = unknown(cells)
    one = answers(RandomImputer("s").impute(cells, targets))
    two = answers(RandomImputer("s").impute(cells, targets.repartition(7)))
    assert one == two and all(0 <= s < 1 for s in one.values())
    assert one != answers(RandomImputer("t").impute(cells, targets))


@pytest.mark.parametrize("k, blocks", [(1, 256), (3, 256), (3, 5), (50, 9)])
def test_knn_against_brute_force(spark, k, blocks):
    rows = random_rows(4, 40, 9)
    rows.update({f"copy{i}": rows["e001"] for i in range(12)})  # a hot pattern
    rows["void"] = "?" * 9  # nothing known: mean
    cells = matrix(spark, rows)
    targets = unknown(cells)
    got = answers(KNNImputer(k=k, min_block_rows=blocks, block_bytes=8 * 9 * blocks).impute(cells, targets))
    expect = brute_knn(rows, k)
    mean = answers(MeanImputer().impute(cells, targets))
    assert set(got) == {(r.entity_id, r.feature) for r in targets.collect()}
    for cell, score in got.items():
        assert score == pytest.approx(expect.get(cell, mean[cell])), cell


def test_knn_shortlist_falls_back_to_all_rows():
    """A feature that few rows know is still found among all rows."""
    rng = np.random.default_rng(0)
    block = rng.integers(0, 2, (500, 6)).astype(np.float64)
    block[:, 5] = np.nan
    block[490:, 5] = 1.0
    query = np.array([[0, 0, 0, 0, 0, np.nan]], dtype=np.float64)
    need = np.isnan(query)
    found = [x for x in nearest_in_block(query, need, block, 3, 100) if len(x[0])]
    rows = np.concatenate([x[3] for x in found])
    best = sorted(range(490, 500), key=lambda r: (100 * block[r, :5].sum() // 5, r))[:3]
    assert sorted(rows) == sorted(best)


def test_knn_with_numeric_ids_and_real_values(spark):
    cells = spark.createDataFrame(
        [(1, "a", 0.0), (1, "b", 0.2), (2, "a", 0.1), (2, "b", 0.3), (2, "c", 0.9), (10, "a", 0.9), (10, "c", 0.1)],
        "entity_id long, feature string, value double",
    )
    targets = spark.createDataFrame([(1, "c")], "entity_id long, feature string")
    assert answers(KNNImputer(k=1).impute(cells, targets))[1, "c"] == 0.9


def test_no_imputer_looks_at_held_out_values(spark):
    """Changing a target's value changes no prediction."""
    rows = random_rows(9, 25, 6, known=0.8)
    base = matrix(spark, rows)
    targets = unknown(base)
    with_values = base.withColumn("value", F.when(F.col("value").isNull(), 1.0).otherwise(F.col("value")))
    known = with_values.join(targets, ["entity_id", "feature"], "left_anti")
    for imputer in (MeanImputer(), KNNImputer(k=2), SoftImputeImputer(penalty=1.0)):
        assert answers(imputer.impute(base, targets)) == pytest.approx(answers(imputer.impute(known, targets)))


def test_predictions_do_not_depend_on_partitions(spark):
    cells = matrix(spark, random_rows(5, 30, 8))
    targets = unknown(cells)
    shuffled = cells.repartition(11).sortWithinPartitions(F.desc("value"))
    for imputer in (MeanImputer(), KNNImputer(k=3)):
        assert answers(imputer.impute(cells, targets)) == answers(imputer.impute(shuffled, targets.repartition(5)))


def masked(spark, x, held):
    return spark.createDataFrame(
        [(f"e{i}", f"f{j}", None if held[i, j] else float(x[i, j])) for i, j in np.ndindex(*x.shape)], CELL
    )


def dense_soft_impute(x, held, penalty, tolerance):
    z = np.where(held, 0.0, x)
    while True:
        u, s, vt = np.linalg.svd(z, full_matrices=False)
        now = np.where(held, (u * np.maximum(s - penalty, 0)) @ vt, x)
        if ((now - z) ** 2).sum() < tolerance * (z**2).sum():
            return now
        z = now


@pytest.mark.parametrize(("rank", "first_rank", "every"), [(6, 1, 3), (1, 16, 10)])
def test_soft_impute_equals_dense_iteration(spark, rank, first_rank, every):
    """Whatever the rank it starts with, and however often the state is stored."""
    rng = np.random.default_rng(rank)
    x = rng.standard_normal((40, rank)) @ rng.standard_normal((rank, 12))
    held = rng.random(x.shape) < 0.08
    z = dense_soft_impute(x, held, 3.0, 1e-12)
    imputer = SoftImputeImputer(penalty=3.0, tolerance=1e-10, center=False, checkpoint_every=every, first_rank=first_rank)
    cells = masked(spark, x, held)
    got = {(r.entity_id, r.feature): r.value for r in imputer.complete(cells, unknown(cells)).collect()}
    assert got == pytest.approx({(f"e{i}", f"f{j}"): z[i, j] for i, j in zip(*np.nonzero(held))}, abs=1e-2)


def test_soft_impute_says_that_it_does_not_converge(spark):
    x = np.random.default_rng(2).random((8, 4))
    cells = masked(spark, x, x < 0.4)
    with pytest.raises(RuntimeError):
        SoftImputeImputer(penalty=0.1, tolerance=0.0, most_rounds=3).impute(cells, unknown(cells))


def test_knn_is_exact_for_real_and_large_values(spark):
    rows = [("q", 0.0, 0.0, None), ("a", 0.1, 5e6, 0.1), ("b", 0.1, 0.0, 0.10000000001), ("c", 9e9, 0.0, 0.7), ("d", 0.2, 1.0, 0.4)]
    cells = spark.createDataFrame([(e, f"f{i}", v) for e, *vs in rows for i, v in enumerate(vs)], CELL)
    (found,) = [KNNImputer(k=4).neighbour_examples(cells, unknown(cells)).orderBy("rank").collect()]
    assert [(r.neighbour_id, r.value) for r in found] == [("b", 0.10000000001), ("d", 0.4), ("a", 0.1), ("c", 0.7)]
    assert all(r.distance >= 0 for r in found)


def test_feature_index_has_no_bound(spark):
    cells = spark.range(120_000).select(F.lit("e").alias("entity_id"), F.col("id").cast("string").alias("feature"))
    index, n = feature_index(cells, cells)
    assert n == 120_000
    assert index.where("i = 0").first().feature == "0" and index.agg(F.count_distinct("i")).first()[0] == n


def test_fill_never_changes_known_cells(spark):
    cells = matrix(spark, {"a": "1?", "b": "01"})
    kb = KnowledgeBase(cells)
    wrong = cells.select("entity_id", "feature", F.lit(0).alias("pred"))
    got = {(r.entity_id, r.feature): (r.value, r.imputed) for r in fill(kb, wrong).collect()}
    assert got == {("a", "f0"): (1.0, False), ("a", "f1"): (0.0, True), ("b", "f0"): (0.0, False), ("b", "f1"): (1.0, False)}


def test_knowledge_base_access(spark):
    kb = KnowledgeBase(matrix(spark, {"a": "1?", "b": "01", "c": "??"}))
    assert kb.features() == ["f0", "f1"]
    assert {tuple(r) for r in kb.missing().collect()} == {("a", "f1"), ("c", "f0"), ("c", "f1")}
    assert {tuple(r) for r in kb.wide().collect()} == {("a", 1.0, None), ("b", 0.0, 1.0), ("c", None, None)}
    wide = spark.createDataFrame([("a", 1, None), ("b", 0, 1)], "id string, f0 int, f1 int")
    assert KnowledgeBase.from_wide(wide, "id", ["f0", "f1"]).cells.count() == 3
    two = spark.createDataFrame([("a", "f", 0.0), ("a", "f", 1.0)], CELL)
    assert KnowledgeBase.from_sources(two, "union").cells.first().value == 1.0
    assert KnowledgeBase.from_sources(two, "average").cells.first().value == 0.5


def test_store_and_read_back(spark, tmp_path):
    kb = KnowledgeBase(matrix(spark, {"a": "1?", "b": "01"}))
    kb.write(str(tmp_path / "kb"))
    again = KnowledgeBase.from_parquet(spark, str(tmp_path / "kb"))
    assert sorted(map(tuple, again.known().collect())) == sorted(map(tuple, kb.known().collect()))


def test_in_context_prompt(spark):
    cells = matrix(spark, {"a": "1?", "b": "01", "c": "10"})
    examples = spark.createDataFrame(
        [("f1", 2, "c", 0.0), ("f1", 1, "b", 1.0), ("f1", 3, "z", 1.0)],
        "feature string, rank int, neighbour_id string, value double",
    )
    (r,) = ICLPrompt(k=2).build(unknown(cells), examples).collect()
    assert r.prompt.splitlines()[:5] == ["Feature: f1", "Known values:", "- b: 1", "- c: 0", "What is the value for a?"]
    (r,) = ICLPrompt().build(unknown(cells), examples.where("rank > 9")).collect()
    assert r.prompt.splitlines()[:2] == ["Feature: f1", "What is the value for a?"]


def test_graph_prompt_leaves_out_unknown_facts(spark):
    cells = matrix(spark, {"a": "?", "b": "1", "c": "0", "d": "1"})
    facts = KGPrompt().facts_of(
        spark.createDataFrame(
            [("a", "F", "Name", ["F", "a"], ["Area"], 1.0, 2.0), ("b", "F", None, ["F", "b"], None, None, None),
             ("c", "F", None, ["F", "c"], None, None, None), ("d", "G", None, ["G", "d"], None, None, None)],
            "languoid_id string, top_id string, name string, lineage array<string>, macroareas array<string>,"
            "latitude double, longitude double",
        )
    )
    (r,) = KGPrompt().build(unknown(cells), cells, facts).collect()
    assert r.prompt.splitlines()[:7] == [
        "Entity: Name", "- lineage: F > a", "- area: Area", "- place: 1.00, 2.00", "Feature: f0",
        "- relatives with 1: 1", "- relatives with 0: 1",
    ]
    (r,) = KGPrompt().build(unknown(cells), cells, facts.where("entity_id <> 'a'")).collect()
    assert r.prompt.splitlines()[:2] == ["Entity: a", "Feature: f0"]


def test_unreadable_replies_stay_visible(spark):
    class Echo:
        def complete(self, prompts):
            return list(prompts)

    prompts = spark.createDataFrame(
        [("a", "f", 'Sure: {"value": 1, "confidence": "High"} ok'), ("b", "f", "I do not know"),
         ("c", "f", '{"value": 0, "confidence": "medium"}'), ("d", "f", '{"value": 1, "confidence": "huge"}')],
        "entity_id string, feature string, prompt string",
    )
    got = {r.entity_id: (r.score, r.pred) for r in PromptingImputer(Echo(), batch_size=2).impute(prompts).collect()}
    assert got == {"a": (0.95, 1), "b": (None, None), "c": (0.25, 0), "d": (None, None)}


def test_reply_parser(spark):
    r = spark.createDataFrame([('x {"value": 1} y',)], "r string").select(parse_reply(F.col("r")).alias("a")).first().a
    assert (r.value, r.confidence) == (1, None)


def test_dense_blocks_equal_sparse_sums(monkeypatch):
    from lacuna.impute import softimpute

    rng = np.random.default_rng(4)
    known = rng.random((30, 9)) < 0.8
    known[3] = False
    x = rng.standard_normal(known.shape)
    batch = pd.DataFrame({"i": [np.flatnonzero(k) for k in known], "v": [r[k] for r, k in zip(x, known, strict=True)]})
    a, v, b, w, q = (rng.standard_normal((n, r)) for n, r in ((30, 2), (9, 2), (30, 3), (9, 3), (9, 4)))
    monkeypatch.setattr(softimpute, "_DENSE_CELLS", 40)
    dense, sparse = softimpute._Rows(batch, 9), softimpute._Rows(batch, 10_000)
    assert len(dense.dense) == 8 and not sparse.dense
    assert np.allclose(dense.times(a, v, q), sparse.times(a, v, q))
    sums = np.zeros((2, 9, 4))
    for rows, out in zip((dense, sparse), sums, strict=True):
        rows.transposed(a, v, rows.times(a, v, q), out)
    assert np.allclose(*sums)
    assert np.allclose(dense.moved(a, v, b, w), sparse.moved(a, v, b, w))


def test_knn_tasks_hold_one_pair_of_blocks_on_average(spark):
    n, blocks = 320, 20
    cells = spark.range(n).selectExpr("id AS entity_id", "explode(sequence(0, 3)) AS f").selectExpr(
        "entity_id", "string(f) AS feature", "if(f = entity_id % 4, null, double(entity_id * (f + 1)))  AS value"
    )
    imputer = KNNImputer(k=2, block_bytes=n // blocks * 8 * 4, min_block_rows=1)
    ranked, _ = imputer.neighbours(cells, cells.where("value IS NULL"))
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert f"{blocks * blocks}" in [x.rsplit(", ", 1)[-1].strip() for x in plan.splitlines() if "RepartitionByExpression" in x]


@pytest.mark.parametrize("seed", range(4))
def test_the_search_by_tiles_finds_the_nearest_of_all(monkeypatch, seed):
    """Over bits, with ties, rare features, features that no row knows and rows with nothing in common."""
    monkeypatch.setattr(neighbours, "_TILE_ROWS", 64)
    rng = np.random.default_rng(seed)
    n, n_features, k, scale = 1500, 11, 3, 1000
    known = rng.random((n, n_features)) < np.array([0.8] * 6 + [0.3, 0.1, 0.01, 0.001, 0.0])
    ones = known & (rng.random((n, n_features)) < 0.4)
    data = np.hstack([np.packbits(known, axis=1), np.packbits(ones, axis=1)])
    rows = neighbours._Rows(data, n_features, True)
    mine, need = np.arange(0, n, 30), ~known[::30]
    search = neighbours._Search(rows.part(mine), need, rows, k, scale)
    search.run()
    assert np.isfinite(search.bound).mean() > 0.9
    got = {}
    for row, feature, distance, place, value in search.answers():
        for r, f, d, p, v in zip(row.tolist(), feature.tolist(), distance.tolist(), place.tolist(), value.tolist(), strict=True):
            got.setdefault((r, f), []).append((d, p, v))
    expect = {}
    for r, q in enumerate(mine):
        common = (known[q] & known).sum(axis=1)
        squares = ((ones[q] != ones) & known[q] & known).sum(axis=1)
        distance = np.where(common > 0, squares * scale // np.maximum(common, 1), -1)
        for f in np.flatnonzero(need[r]):
            at = np.flatnonzero(known[:, f] & (common > 0))
            at = at[np.lexsort((at, distance[at]))][:k]
            if len(at):
                expect[r, int(f)] = [(float(distance[p]), int(p), float(ones[p, f])) for p in at]
    assert got == expect


def test_knn_compares_few_rows_one_by_one(monkeypatch):
    """Once a query has a bound, only rows below it leave the product of matrices."""
    counted, whole = [], neighbours._Rows.distances
    monkeypatch.setattr(neighbours._Rows, "distances", lambda self, other, scale: counted.append(len(self.data)) or whole(self, other, scale))
    rng = np.random.default_rng(3)
    known = rng.random((20_000, 32)) < 0.8
    data = np.hstack([np.packbits(known, axis=1), np.packbits(known & (rng.random(known.shape) < 0.5), axis=1)])
    rows = neighbours._Rows(data, 32, True)
    search = neighbours._Search(rows.part(slice(0, 50)), ~known[:50], rows, 5, 1_000_000)
    search.run()
    assert np.isfinite(search.bound).all() and sum(counted) < 50 * len(data) / 50


@pytest.mark.parametrize(("values", "sections"), [("f % 2", 1), ("f + 0.5", 10)])
def test_knn_tasks_give_k_rows_of_a_section_for_each_cell(spark, values, sections):
    """Not of each block, and blocks of bits are few to a section."""
    n, k = 320, 2
    cells = spark.range(n).selectExpr("id AS entity_id", "explode(sequence(0, 3)) AS f").selectExpr(
        "entity_id", "string(f) AS feature", f"if(f = entity_id % 4, null, double({values}) + entity_id * {int(sections > 1)}) AS value"
    )
    found, _ = KNNImputer(k=k, block_bytes=n // 10 * 8 * 4, min_block_rows=1)._found(cells, cells.where("value IS NULL"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("collect_list(near" in plan) == (sections > 1)
    near = found.groupBy("pattern_id", "feature").agg(F.count("*").alias("n"), F.max(F.size("near")).alias("size")).collect()
    assert near and all(r.n == 1 and r.size <= k for r in near)


def test_a_small_feature_index_needs_no_shuffle_of_the_cells(spark):
    cells = matrix(spark, {"a": "1?", "b": "01"})
    index, _ = feature_index(cells, cells)
    assert "BroadcastHashJoin" in cells.join(index, "feature")._jdf.queryExecution().executedPlan().toString()
