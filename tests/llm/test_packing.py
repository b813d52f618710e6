"""Packing: exact round trips, and the curve."""

import random

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lacuna.llm import tokens
from lacuna.llm.packing import hilbert_keys, pack
from lacuna.llm.store import Store
from lacuna.llm.tokens import PieceTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def whole(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, found, seq_len):
    """Pieces tile the documents and the sequences."""
    by_text = sorted((doc if doc is not None else -1, tuple(whole(text))) for doc, text in rows)
    found = sorted(found, key=lambda r: (r.sequence_id, r.offset))
    at, docs, open_ = 0, [], {}
    for r in found:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert (r.sequence_id * seq_len + r.offset, len(ids)) == (at, r.length)
        assert r.offset + r.length <= seq_len
        at += r.length
        held = open_.setdefault(r.doc_id, [])
        assert len(held) == r.start
        held += ids
        if len(held) == r.doc_tokens:
            docs.append((r.doc_id if r.doc_id is not None else -1, tuple(open_.pop(r.doc_id))))
    assert not open_
    assert sorted(docs) == by_text


def run(spark, rows, seq_len=16):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, pack(docs, PATH, Store(spark, "pack-test"), seq_len=seq_len).collect(), seq_len)


def test_round_trip_of_documents(spark):
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")[["doc_id", "text"]]
    run(spark, list(docs.itertuples(index=False, name=None)), 2048)


def test_edge_cases(spark):
    long = " ".join(f"word{i * i}" for i in range(20_000))
    run(spark, [(1, None), (2, ""), (3, " "), (4, long), (5, "same"), (5, "same"), (6, "same"), (None, "x y")])


def test_sequences_that_end_with_a_document(spark):
    run(spark, [(i, "a b c") for i in range(8)], 4)


def test_empty_table_and_extra_columns(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH, Store(spark, "pack-test")).collect() == []
    docs = spark.createDataFrame([(1, "a", 5, "x")], "doc_id long, text string, key int, row_no string")
    assert pack(docs, PATH, Store(spark, "pack-test")).count() == 1


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_the_curve_visits_every_point_by_single_steps(dimensions, bits):
    side = 1 << bits
    points = np.stack(np.meshgrid(*[np.arange(side)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    keys = hilbert_keys(points, bits)
    assert sorted(keys.tolist()) == list(range(side**dimensions))
    steps = np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


ODD = ["a", "B", "'s", "don't", " ", "  ", "\n", "\t", " ", " ", "é", "é", "́", "!!", ".", "9", "12", "<|endoftext|>", "<|ENDOFTEXT|>", "Word", "ño", "ÑO", "it's", "'", "a.,b", "(x)", "ª", "ß", "İ", "Σ", "🙂"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD), max_size=12).map("".join), max_size=4))
def test_pieces_are_the_whole(texts):
    found = PieceTokenizer(PATH).ids(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [whole(t)[:-1] for t in texts]


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 10)
    rng = random.Random(0)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 5) for _ in range(40)) for _ in range(20)]
    tokenizer = PieceTokenizer(PATH)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in tokenizer.ids(texts)] == [whole(t)[:-1] for t in texts]
    assert len(tokenizer.known) <= 10
