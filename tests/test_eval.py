"""Splits, metrics, calibration and breakdowns."""

import pytest
from pyspark.sql import functions as F

from lacuna.eval import (
    Calibration,
    Evaluator,
    FamilyAreaAnalysis,
    FeatureErrorAnalysis,
    GoldItem,
    ResourceSplitAnalysis,
    Split,
    compute_binary_metrics,
    confidence_label_to_probability,
    expected_calibration_error,
)
from lacuna.eval.metrics import reliability


def pairs(spark, rows):
    return spark.createDataFrame(rows, "gold int, pred int")


def test_metrics_by_hand(spark):
    r = compute_binary_metrics(pairs(spark, [(1, 1), (1, 1), (0, 1), (1, 0), (0, 0), (None, 1), (1, None)])).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.n) == (2, 1, 1, 1, 5)
    assert (r.accuracy, r.precision, r.recall, r.f1) == pytest.approx((3 / 5, 2 / 3, 2 / 3, 2 / 3))


@pytest.mark.parametrize("rows", [[(0, 0)], []])
def test_zero_denominators_give_zero(spark, rows):
    r = compute_binary_metrics(pairs(spark, rows)).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0) and r.n == len(rows)


def scored(spark, rows):
    return spark.createDataFrame(rows, "probability double, outcome int")


def test_edges_of_bins(spark):
    got = reliability(scored(spark, [(0.0, 0), (1.0, 1), (0.1, 0), (0.95, 1), (None, 1)])).collect()
    assert {(r.bin, r.n) for r in got} == {(0, 1), (1, 1), (9, 2)}


def test_calibration_error(spark):
    perfect = scored(spark, [(1.0, 1), (0.0, 0), (0.5, 1), (0.5, 0)])
    assert expected_calibration_error(perfect).first().ece == 0.0
    off = scored(spark, [(0.9, 0), (0.9, 0), (0.2, 1), (0.2, 0)])
    assert expected_calibration_error(off).first().ece == pytest.approx(0.5 * 0.9 + 0.5 * 0.3)


def test_calibration_uses_the_predicted_side(spark):
    df = spark.createDataFrame([(0, 0, 0.2), (1, 0, 0.2), (1, 1, 0.8)], "gold int, pred int, score double")
    (r,) = Calibration().table(df).collect()
    assert (r.bin, r.n, r.accuracy) == (8, 3, pytest.approx(2 / 3)) and r.mean_probability == pytest.approx(0.8)


def test_confidence_words(spark):
    words = spark.createDataFrame([("High",), (" low ",), ("sure",), (None,)], "w string")
    got = [r.p for r in words.select(confidence_label_to_probability(F.col("w")).alias("p")).collect()]
    assert got == [0.95, 0.55, None, None]
    other = words.select(confidence_label_to_probability(F.col("w"), {"sure": 1.0}).alias("p")).collect()
    assert [r.p for r in other] == [None, None, 1.0, None]


def test_split_is_a_partition_and_repeatable(spark):
    cells = spark.range(2000).select(
        (F.col("id") % 50).cast("string").alias("entity_id"), F.col("id").cast("string").alias("feature"), F.lit(1.0).alias("value")
    )
    split = Split(folds=4, test_folds=(1,), seed="x")
    train, test = split.train(cells), split.test(cells)
    assert train.count() + test.count() == 2000 and Split.leaks(train, test).count() == 0
    assert 400 < test.count() < 600
    again = split.test(cells.repartition(13))
    assert {r.feature for r in again.collect()} == {r.feature for r in test.collect()}
    whole = Split(folds=4, test_folds=(0, 1), unit=("entity_id",))
    assert Split.leaks(whole.train(cells), whole.test(cells), ("entity_id",)).count() == 0


@pytest.fixture
def evaluated(spark):
    gold = GoldItem.frame(
        spark, [GoldItem(e, f, g) for e, f, g in (("a", "x", 1), ("a", "y", 0), ("b", "x", 1), ("c", "y", 0), ("c", "x", 0))]
    )
    predictions = spark.createDataFrame(
        [("m", "a", "x", 0.9, 1), ("m", "a", "y", 0.8, 1), ("m", "b", "x", 0.4, 0), ("m", "c", "y", 0.1, 0), ("m", "q", "x", 1.0, 1)],
        "imputer string, entity_id string, feature string, score double, pred int",
    )
    return Evaluator(gold), predictions


def test_evaluator(evaluated):
    evaluator, predictions = evaluated
    (r,) = evaluator.metrics(predictions).collect()
    assert (r.imputer, r.tp, r.fp, r.fn, r.tn) == ("m", 1, 1, 1, 1)
    assert [(r.entity_id, r.feature) for r in evaluator.unanswered(predictions).collect()] == [("c", "x")]
    assert evaluator.calibration(predictions).first().n == 4
    assert len(evaluator.compare([predictions, predictions.withColumn("imputer", F.lit("n"))]).collect()) == 2


def test_resource_split(spark, evaluated):
    evaluator, predictions = evaluated
    coverage = spark.createDataFrame([("a", 10), ("c", 2)], "entity_id string, n_known long")
    got = {r.resource: r.n for r in ResourceSplitAnalysis(5).run(evaluator.scored(predictions), coverage).collect()}
    assert got == {"high": 2, "low": 2, "all": 4}


def test_family_and_area(spark, evaluated):
    evaluator, predictions = evaluated
    groups = spark.createDataFrame(
        [("a", "F", "N"), ("b", "F", "S"), ("c", None, "N")], "entity_id string, family string, area string"
    )
    got = {(r.grain, r.family, r.area): r.n for r in FamilyAreaAnalysis().run(evaluator.scored(predictions), groups).collect()}
    assert got == {
        ("family and area", "F", "N"): 2, ("family and area", "F", "S"): 1, ("family and area", None, "N"): 1,
        ("family", "F", None): 3, ("family", None, None): 1, ("area", None, "N"): 3, ("area", None, "S"): 1,
        ("all", None, None): 4,
    }


def test_feature_errors(evaluated):
    evaluator, predictions = evaluated
    got = [(r.feature, r.n_errors, r.error_rate) for r in FeatureErrorAnalysis().run(evaluator.scored(predictions)).collect()]
    assert got == [("x", 1, 0.5), ("y", 1, 0.5)]
    assert len(FeatureErrorAnalysis(k=1).run(evaluator.scored(predictions)).collect()) == 1
