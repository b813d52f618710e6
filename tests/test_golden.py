"""Counts of a full catalogue. Runs only if CATALOG_TREE names the record tree of one."""

import os

import pytest
from pyspark.sql import functions as F

from lacuna.operators import levels, records as rec, status, tree
from lacuna.sources import catalog, lookups

TREE = os.environ.get("CATALOG_TREE")
pytestmark = pytest.mark.skipif(not TREE, reason="CATALOG_TREE is not set")


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("catalog")
    return catalog.compile_catalog(spark, TREE, str(out / "records"))


def test_levels_and_tree(records):
    counts = {r.level: r["count"] for r in records.groupBy("level").count().collect()}
    assert counts == {"family": 4734, "language": 1787, "dialect": 13429}
    nodes = tree.nodes_from_paths(records, "level").cache()
    assert (nodes.count(), nodes.where("NOT has_record").count(), nodes.where("depth = 1").count()) == (22893, 2943, 299)
    assert tree.closure(records).count() == 161206
    assert tree.isolates(records).count() == 5
    assert levels.level_violations(records).count() == 0
    inferred = levels.infer_levels(nodes)
    found = inferred.where("level IS NULL").groupBy("inferred_level").count()
    assert {r.inferred_level: r["count"] for r in found.collect()} == {
        "language": 2821, "family": 62, "dialect": 14, None: 46
    }
    completed = inferred.where("inferred_level IS NOT NULL").select(
        "languoid_id", "parent_id", F.col("inferred_level").alias("level")
    )
    assert levels.level_violations(completed).count() == 0


def test_nested_values(records):
    assert rec.altnames(records).count() == 21457
    assert rec.ref_differences(records).count() == 18
    keys = F.flatten(F.array_compact(F.array("sources", "classification.subrefs", "classification.familyrefs")))
    refs = records.select(F.explode(keys).alias("r")).select("r.provider", "r.key").distinct()
    assert refs.count() == 7103
    codes = rec.id_crosswalk(records).groupBy("scheme").agg(F.countDistinct("identifier").alias("n"))
    assert codes.agg(F.max("n")).first()[0] == 8858
    areas = records.select(F.explode("macroareas").alias("area")).groupBy("area").count()
    assert {r["count"] for r in areas.collect()} == {5427, 4676, 3421, 732, 628, 318}


def test_statuses(spark, records):
    statuses = lookups.default_statuses(spark)
    named = records.where("endangerment IS NOT NULL").select("languoid_id", "endangerment.status")
    counts = status.status_lookup(named, statuses).groupBy("status_id").count().collect()
    assert {r.status_id: r["count"] for r in counts} == {
        "safe": 660, "extinct": 415, "vulnerable": 357, "definite": 204, "severe": 73, "critical": 50
    }
    graded = rec.status_comments(records).where("grade IS NOT NULL")
    assert graded.count() == 1457 and status.status_disagreements(graded, statuses).count() == 0
    reasons = records.where("iso_retirement IS NOT NULL").groupBy("iso_retirement.reason").count()
    assert {r.reason: r["count"] for r in reasons.collect()} == {
        "merge": 73, "non-existent": 52, "split": 19, "duplicate": 18, "change": 1
    }
