"""The recurrent model's gradients and probabilities, and scores against counts."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from lacuna.llm import gru, lm
from lacuna.llm.queries import QUERIES
from lacuna.llm.store import Store

DATA = "/root/testdata/sf0.001"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def base_scores(rows, training):
    counts = Counter(t for _, text in training for t in tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    for doc, text in rows:
        words = tokens(text)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        yield doc, len(words), sum(counts[w] > 0 for w in words), total, base


def test_documents_against_counts(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet")[["doc_id", "text"]]
    rows = list(docs.itertuples(index=False, name=None))
    training = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10]
    found = {r.doc_id: r for r in QUERIES["op10_lm_scores"].run(spark, DATA).collect()}
    assert len(found) == len(rows)
    for doc, n, known, total, base in base_scores(rows, training):
        r = found[doc]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.held_out == (zlib.crc32(str(doc).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(base, rel=1e-12)
        assert -1e9 < r.score < 0


def corpus(n, seed):
    """Texts of two kinds; the kind shows in the first words and tells the rest."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["red", "blue"])
        words = [f"{kind}{rng.randint(0, 15)}" for _ in range(rng.randint(20, 60))]
        out.append((i, " ".join(words)))
    return out


def scored(spark, rows, training):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return lm.score_texts(docs, spark.createDataFrame(training, "doc_id long, text string"), Store(spark, "lm-test")).collect()


def test_held_out_texts_are_likelier_than_by_single_words(spark, monkeypatch):
    monkeypatch.setattr(lm, "TRAIN_SHARE", 1.0)
    found = scored(spark, corpus(100, 1), corpus(2000, 2))
    n = sum(r.n_tokens for r in found)
    assert sum(r.score for r in found) / n > sum(r.base_score for r in found) / n + 0.15


def test_all_training_texts_reach_the_weights(spark):
    """At the share that queries use."""
    training = corpus(2000, 5)
    found = scored(spark, corpus(100, 6), training)
    n = sum(r.n_tokens for r in found)
    assert sum(r.score for r in found) / n > sum(r.base_score for r in found) / n + 0.15
    docs = spark.createDataFrame(training, "doc_id long, text string")
    store = Store(spark, "lm-all")
    lm.train(docs, lm._vocabulary(lm.count_words(docs)), store)
    read = spark.read.parquet(store.path("training")).collect()
    assert len(read) == 2000 and sum(len(r.ids) for r in read) // 4 == sum(len(t.split()) + 1 for _, t in training)


def test_words_beyond_the_local_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "LOCAL_COUNTS", 12)
    monkeypatch.setattr(lm, "WORDS", 5)
    rows, training = corpus(30, 3) + [(99, "never seen words " * 5)], corpus(200, 4)
    found = {r.doc_id: r for r in scored(spark, rows, training)}
    for doc, n, known, _, base in base_scores(rows, training):
        assert (found[doc].n_tokens, found[doc].n_known) == (n, known)
        assert found[doc].base_score == pytest.approx(base, rel=1e-12)


def test_edge_cases(spark):
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (5, "a"), (5, "a"), (None, "a b")]
    found = scored(spark, rows, rows)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in found) == [(0, 3), (1, 1), (2, 1), (3, 1), (4, 30_001), (5, 2), (5, 2)]
    assert scored(spark, [], []) == []
    (alone,) = scored(spark, [(1, "a")], [])
    assert (alone.n_known, alone.train_tokens) == (0, 0)
    assert alone.base_score == alone.score == 0  # one unknown word that holds all probability


def model(words=100, seed=0):
    rng = np.random.default_rng(seed)
    p = gru.initial(rng.integers(1, 50, words), 30.0)
    return {k: (v + rng.standard_normal(v.shape) * 0.3 * (v > -1e8)).astype(np.float64) for k, v in p.items()}


def test_probabilities_sum_to_one():
    p = model()
    h = np.random.default_rng(1).standard_normal((1, gru.HIDDEN))
    total = sum(np.exp(gru.log_probabilities(p, h, np.array([t]), 100))[0] for t in range(101))
    assert total == pytest.approx(1, abs=1e-6)


def test_gradients_are_differences(monkeypatch):
    p, rng = model(), np.random.default_rng(2)
    goal, before = rng.integers(0, 101, (6, 3)), rng.integers(0, 102, (6, 3))
    fresh, used = rng.random((6, 3)) < 0.2, rng.random((6, 3)) < 0.9
    h0 = rng.standard_normal((3, gru.HIDDEN))
    _, g, _ = gru.gradients(p, before, goal, fresh, used, h0, 100)

    def loss(q):
        hidden, _, _ = gru.states(q, q["embedding"] @ q["input"] + q["bias"], before, fresh, h0.astype(np.float32), False)
        logs = gru.log_probabilities(q, hidden.reshape(-1, gru.HIDDEN).astype(np.float64), goal.reshape(-1), 100)
        return -(logs * used.reshape(-1)).sum() / used.sum()

    for k in p:
        way = rng.standard_normal(p[k].shape) * (p[k] > -1e8)
        up, down = ({**p, k: p[k] + s * 1e-2 * way} for s in (1, -1))
        assert (g[k] * way).sum() == pytest.approx((loss(up) - loss(down)) / 2e-2, rel=0.03, abs=2e-3), k


def test_scores_are_those_of_texts_alone():
    p = {k: v.astype(np.float32) for k, v in model().items()}
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 101, n).astype(np.int32) for n in (1, 300, 2, 77, 5, 1, 130)]
    together = gru.score(p, 100, texts, lanes=3, steps=7)
    alone = [gru.score(p, 100, [t])[0] for t in texts]
    np.testing.assert_allclose(together, alone, rtol=1e-5)


def test_a_very_long_text_among_short_ones_takes_memory_once():
    p = {k: v.astype(np.float32) for k, v in model().items()}
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 101, n).astype(np.int32) for n in [60_000] + [30] * 255]
    tracemalloc.start()
    together = gru.score(p, 100, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20_000_000  # a grid of 256 lanes has 60,000 x 256 cells
    np.testing.assert_allclose(together[:2], gru.score(p, 100, texts[:2]), rtol=1e-5)


def test_few_lanes_have_long_windows(monkeypatch):
    p, rng = model(), np.random.default_rng(8)
    texts = [rng.integers(0, 100, n).astype(np.int32) for n in (20_000, *[100] * 50)]
    alone = [gru.score(p, 100, [t])[0] for t in texts]
    widths, whole = [], gru.log_probabilities
    monkeypatch.setattr(gru, "log_probabilities", lambda p, h, *rest: widths.append(len(h)) or whole(p, h, *rest))
    np.testing.assert_allclose(gru.score(p, 100, texts), alone, rtol=1e-5)
    assert sum(widths) == 25_000 and max(widths) <= gru.WINDOW and len(widths) < 20  # one for each 32 words of the long text


def test_few_texts_still_make_many_steps(monkeypatch):
    """A pass narrows its windows before it makes few of them."""
    seen = []
    texts = [np.arange(50, dtype=np.int32)] * 1000
    trainer = gru.Trainer(gru.initial(np.ones(100), 1.0), 100)
    monkeypatch.setattr(trainer, "_step", lambda g, rows: seen.append(1))
    trainer.learn(texts)
    assert len(seen) >= 96


def test_large_logits_are_shifted_before_they_are_raised():
    """Only classes whose logits are bounded go without it; both ways give the same."""
    p = gru.initial(np.arange(200, 0, -1), 50.0)
    rng = np.random.default_rng(3)
    p["word"] = rng.standard_normal(p["word"].shape).astype(np.float32)
    h = rng.uniform(-1, 1, (500, gru.HIDDEN)).astype(np.float32)
    target = rng.integers(0, 201, 500).astype(np.int32)
    assert gru._bounded(p["word"], p["word_bias"]).all()
    plain = gru.log_probabilities(p, h, target, 200)
    q = dict(p, class_bias=p["class_bias"] + np.float32(500), word_bias=p["word_bias"] + np.float32(500))
    assert not gru._bounded(q["word"], q["word_bias"]).any()
    assert np.allclose(gru.log_probabilities(q, h, target, 200), plain, atol=1e-3)


def test_words_whose_hashes_begin_alike_are_told_apart():
    top = [((7 << 42) + i - (1 << 62), 100 - i) for i in range(40)] + [(5, 1), (-1, 1)]
    v = lm.Vocabulary(top, 10_000, 100)
    hashes = np.array([w for w, _ in top] + [(7 << 42) + 99 - (1 << 62), 6, -2], np.int64).view(np.uint64)
    ids, counts = v.look_up(hashes)
    assert ids.tolist() == [*range(42), 42, 42, 42]
    assert counts.tolist() == [n for _, n in top] + [-1, -1, -1]


def test_pieces_hold_all_rows_of_all_classes():
    cuts = [(0, 0, 1300), (2, 1300, 1310), (3, 1310, 1536), (7, 1536, 2000)]
    pieces = list(gru._pieces(cuts))
    assert [(s.start, s.stop) for s, _ in pieces] == [(0, 512), (512, 1024), (1024, 1536), (1536, 2000)]
    rows = [(c, row) for _, piece in pieces for i, c, s, e in piece for row in range(s, e) if cuts[i][0] == c]
    assert rows == [(c, row) for c, s, e in cuts for row in range(s, e)] and list(gru._pieces([])) == []


def test_logits_are_held_in_strips():
    """A window's logits, of all its words at once, would take more than the bound by themselves."""
    p, rng = gru.initial(np.arange(4096, 0, -1), 50.0), np.random.default_rng(6)
    h = rng.uniform(-1, 1, (50_000, gru.HIDDEN)).astype(np.float32)
    target = rng.integers(0, 4097, len(h)).astype(np.int32)
    tracemalloc.start()
    whole = gru.log_probabilities(p, h, target, 4096)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(h) * 80
    parts = [gru.log_probabilities(p, h[i : i + 300], target[i : i + 300], 4096) for i in range(0, 3000, 300)]
    np.testing.assert_allclose(whole[:3000], np.concatenate(parts), atol=1e-4)
