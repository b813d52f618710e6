"""Training order: the permutation, and round trips through the shards."""

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lacuna.llm import training_order
from lacuna.llm.queries import QUERIES
from lacuna.llm.store import Store

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 65_537])
def test_the_permutation_is_one(n):
    slots = training_order.permute(np.arange(n), n, 7)
    assert sorted(slots.tolist()) == list(range(n))
    if n >= 1000:
        assert (slots != training_order.permute(np.arange(n), n, 8)).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.1


def check(spark, rows, **sizes):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order, layout, folder = training_order.write_shards(docs, PATH, Store(spark, "order-test"), **sizes)
    told = {r.slot: r for r in order.collect()}
    back = training_order.read_shards(spark, folder, layout).collect()
    assert sorted(r.slot for r in back) == list(range(len(told))) and len(back) == len(told)
    by_sequence = sorted((told[r.slot].sequence_id, r) for r in back)
    stream = []
    for sequence, (number, r) in enumerate(by_sequence):
        t = told[r.slot]
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert (number, len(ids), ids[t.n_tokens :]) == (sequence, layout.seq_len, [0] * (len(ids) - t.n_tokens))
        assert (r.shard, r.byte_offset) == (r.slot // layout.slots, r.slot % layout.slots * layout.stride)
        stream += ids[: t.n_tokens]
    whole = Tokenizer.from_file(PATH)
    wanted = sorted([*whole.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows)
    found, text = [], []
    for i in stream:
        text.append(i)
        if i == 1:
            found.append(text)
            text = []
    assert sorted(found) == wanted and not text
    return told, layout, folder


def test_edge_cases(spark):
    long = " ".join(f"word{i * i}" for i in range(8000))
    told, layout, folder = check(
        spark, [(1, None), (2, ""), (3, long), (4, "same"), (4, "same"), (None, "x y")] + [(i, "some few words") for i in range(50)],
        seq_len=32, slots=7,
    )
    assert sum(3 in t.doc_ids for t in told.values()) > 100
    rest = training_order.read_shards(spark, folder, layout, from_slot=100).collect()
    assert sorted(r.slot for r in rest) == list(range(100, len(told)))


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    order, _, _ = training_order.write_shards(docs, PATH, Store(spark, "order-test"))
    assert order.collect() == []


def test_documents(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")[["doc_id", "text"]]
    check(spark, list(docs.itertuples(index=False, name=None)), seq_len=2048, slots=8)
    rows = QUERIES["op5_training_order"].run(spark, "/root/testdata/sf0.001").collect()
    assert {d for r in rows for d in r.doc_ids} == set(docs["doc_id"])


def test_the_table_of_slots_is_read_without_ids(spark):
    docs = spark.createDataFrame([(i, "some words " * i) for i in range(20)], "doc_id long, text string")
    order, _, _ = training_order.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), Store(spark, "order-test"), seq_len=16, slots=4)
    assert "packed" not in order._jdf.queryExecution().executedPlan().toString()
    slots = sorted(r.slot for r in order.collect())
    assert slots == list(range(len(slots))) and len(slots) > 4
