"""Tables of a run: what is held while one is written."""

import pyarrow as pa

from lacuna.llm.store import WRITING, Store


def test_batches_for_python_are_bounded_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    docs = spark.range(400, numPartitions=1).selectExpr("id", "repeat('x', 100000) AS text")
    found = [r.n for r in Store(spark, "store-test").keep(docs.mapInArrow(sizes, "n long"), "sizes").collect()]
    assert sum(found) >= 40_000_000 and max(found) < 6_000_000


def test_settings_are_put_back(spark):
    before = {k: spark.conf.get(k, None) for k in WRITING}
    Store(spark, "store-test").keep(spark.range(10), "table")
    assert {k: spark.conf.get(k, None) for k in WRITING} == before


def test_shuffles_behind_a_written_table_go(spark):
    status = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    store = Store(spark, "store-test")

    def shuffles():
        return status.shuffleStatuses().size()

    before = shuffles()
    kept = store.keep(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().repartition(5, "count"), "counts")
    assert kept.count() == 7
    assert shuffles() <= before + 1  # that of the count
