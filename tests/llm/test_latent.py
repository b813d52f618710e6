"""Benchmark passages in documents, against a search for every item in every text."""

import random

import numpy as np
import pandas as pd
import pytest

from lacuna.llm import latent
from lacuna.llm.store import Store

DATA = "/root/testdata/sf0.001"


def leaks(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = latent.with_leaks(d, b, Store(spark, "leaks-test")).collect()
    assert len(rows) == len(docs)
    return {(r.doc_id, leak.item_id) for r in rows for leak in r.leaks}


def plain(text):
    return " ".join((text or "").lower().split())


def test_like_a_search_for_every_item(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")[["doc_id", "text"]]
    items = pd.read_parquet(f"{DATA}/benchmark.parquet")[["item_id", "text"]]
    docs, items = list(docs.itertuples(index=False, name=None)), list(items.itertuples(index=False, name=None))
    whole = {(d, i) for d, t in docs for i, x in items if plain(x) in plain(t)}
    assert whole
    assert leaks(spark, docs, items) >= whole


def prose(rng, n):
    return [rng.choice("abcdefghijklmnopqrst") * rng.randint(1, 3) + str(rng.randint(0, 400)) for _ in range(n)]


def test_paraphrases_but_not_likenesses(spark):
    rng = random.Random(1)
    items = [(i, " ".join(prose(rng, 30))) for i in range(20)]
    docs, wanted = [], set()
    for i, (item, text) in enumerate(items):
        words = text.split()
        for j in rng.sample(range(25), 5):  # 5 of 30 words differ
            words[j] = "other" + str(j)
        docs.append((i, " ".join(prose(rng, 200) + words + prose(rng, 100))))
        wanted.add((i, item))
        half = text.split()[:12]
        docs.append((100 + i, " ".join(prose(rng, 90) + half + prose(rng, 90))))
    docs.append((300, " ".join(prose(rng, 30_000) + items[3][1].upper().split() + prose(rng, 10))))
    wanted.add((300, 3))
    docs += [(400, None), (401, ""), (402, " \n"), (403, items[5][1]), (403, items[5][1]), (None, "x")]
    assert leaks(spark, docs, items + [(99, None), (98, " ")]) == wanted | {(403, 5)}


def test_without_items_or_documents(spark):
    assert leaks(spark, [(1, "a b c")], []) == set()
    assert leaks(spark, [], [(1, "a b c")]) == set()


def test_extra_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "x", 2)], "doc_id long, text string, leaks string, cells int")
    items = spark.createDataFrame([(7, "b c d e f g")], "item_id long, text string")
    row = latent.with_leaks(docs, items, Store(spark, "leaks-test")).first()
    assert (row.cells, [leak.item_id for leak in row.leaks]) == (2, [7])


@pytest.mark.parametrize("seed", range(5))
def test_common_subsequence(seed):
    rng = random.Random(seed)
    a, b = [rng.randint(0, 6) for _ in range(70)], [rng.randint(0, 6) for _ in range(90)]
    best = np.zeros((71, 91), int)
    for i in range(70):
        for j in range(90):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
    assert latent.common_subsequence(a, b) == best[70, 90]


def test_product_with_the_rows_is_the_dense_one(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(prose(rng, 300))) for i in range(30)], "doc_id long, text string")
    items = next(latent._blocks(spark.createDataFrame([(1, " ".join(prose(rng, 60)))], "item_id long, text string")))
    vocabulary = spark.sparkContext.broadcast(items.vocabulary)
    rows = latent._passage_words(docs, vocabulary)
    total, df = latent._frequencies(rows, len(items.vocabulary))
    assert total == 30 * 13
    weights = np.linspace(1, 2, len(df)).astype(np.float32)
    dense = []
    for texts in docs.toPandas()["text"]:
        words = texts.split()
        for at in range(0, len(words), 24):
            passage = latent._items(pd.DataFrame({"item_id": [0], "text": [" ".join(words[at : at + 24])]})).vocabulary
            dense.append(np.isin(items.vocabulary, passage) * weights)
    dense = np.array(dense)
    assert (df == (dense > 0).sum(0)).all()
    dense = dense[(dense > 0).sum(1) > 1]
    x = np.random.default_rng(0).standard_normal((len(df), 7)).astype(np.float32)
    shared = spark.sparkContext.broadcast(weights)
    got = latent._multiply(latent._rare_only(rows, shared), shared, x)
    np.testing.assert_allclose(got, dense.T @ (dense @ x), rtol=1e-4, atol=1e-3)


def test_the_drivers_matrices_are_few(spark):
    """Without the passages as dense rows, and without a matrix for each term of a product."""
    import tracemalloc

    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randint(0, 9000)}" for _ in range(40)) for _ in range(400)]
    items = latent._items(pd.DataFrame({"item_id": range(400), "text": texts}))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    store = Store(spark, "latent-memory")
    tracemalloc.start()
    space = latent.fit(docs, items, store)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    basis = 8 * len(items.vocabulary) * (space.vectors.shape[1] + latent.OVERSAMPLING)
    assert most < 5 * basis


def test_unit_rows_are_the_dense_ones():
    rng = np.random.default_rng(1)
    weights = rng.random(50).astype(np.float32)
    passages = [rng.permutation(50)[:n] for n in (1, 5, 24)]
    for p, (at, w) in zip(passages, latent._unit_rows(passages, weights), strict=True):
        dense = np.zeros(50)
        dense[p] = weights[p]
        assert np.allclose(dense[at], w * np.linalg.norm(dense)) and set(at) == set(np.flatnonzero(dense))


def test_sums_are_fetched_by_few_jobs(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randint(0, 900)}" for _ in range(40)) for _ in range(40)]
    items = latent._items(pd.DataFrame({"item_id": range(40), "text": texts}))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    tracker, jobs = spark.sparkContext.statusTracker(), []
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        jobs = set(tracker.getJobIdsForGroup())
        latent.fit(docs, items, Store(spark, "latent-jobs"))
        assert len(set(tracker.getJobIdsForGroup()) - jobs) < 60
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
