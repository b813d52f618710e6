"""Rank-one updates, and whitening against a dense decomposition."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lacuna.llm import whitening
from lacuna.llm.queries import QUERIES
from lacuna.llm.spectrum import Spectrum
from lacuna.llm.store import Store

SCHEMA = "vec_id long, embedding array<double>"


def scatter(x):
    c = x - x.mean(0)
    return c.T @ c


def check(s, x):
    wanted = scatter(x)
    scale = max(np.abs(wanted).max(), 1e-300)
    assert s.n == len(x)
    assert np.abs(s.vectors.T @ s.vectors - np.eye(x.shape[1])).max() < 1e-12
    assert np.abs((s.vectors * s.values) @ s.vectors.T - wanted).max() < 1e-11 * scale


def made(x, block):
    s = Spectrum(x.shape[1])
    for at in range(0, len(x), block):
        s.add_rows(x[at : at + block])
    return s


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 12), st.integers(2, 40), st.integers(0, 10**6), st.sampled_from([1, 7, 64]))
def test_updates_by_row_and_by_block(dims, n, seed, block):
    x = np.random.default_rng(seed).normal(size=(n, dims)) * 100
    check(made(x, block), x)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=4, max_size=4), min_size=2, max_size=30))
def test_ties_and_repeated_rows_are_deflated(rows):
    x = np.array(rows, dtype=float)
    check(made(x, 1), x)


def test_scales_far_apart():
    x = np.random.default_rng(1).normal(size=(300, 9)) * 10.0 ** np.arange(-4, 5)
    check(made(x, 1), x)


def test_combined_spectra():
    x = np.random.default_rng(2).normal(size=(500, 16)) + 50
    parts = [made(x[a : a + 90], 32) for a in range(0, 500, 90)]
    total = Spectrum(16)
    for s in parts:
        total.add(s)
    check(total, x)


def run(spark, rows, components=8):
    df = spark.createDataFrame(rows, SCHEMA)
    return [r.asDict() for r in whitening.whiten(df, "vec_id", "embedding", Store(spark, "whiten-test"), components).collect()]


def dense(vectors, components=8):
    x = np.floor(np.array(vectors, dtype=float) * 1024) + 100000
    c = x - x.mean(0)
    e, q = np.linalg.eigh(c.T @ c / len(x))
    return x.astype(object), e[::-1], (c @ q[:, ::-1])[:, :components] / np.sqrt(e[::-1][:components])


@pytest.mark.parametrize("fan_in", [2, 16])
def test_against_dense(spark, monkeypatch, fan_in):
    monkeypatch.setattr(whitening, "FAN_IN", fan_in)
    vectors = np.random.default_rng(3).normal(size=(400, 12)) * np.linspace(1, 3, 12)
    found = run(spark, [(i, [float(v) for v in x]) for i, x in enumerate(vectors)])
    x, e, wanted = dense(vectors)
    assert len(found) == 400 * 8
    sums = x.sum(0)
    for c in range(1, 9):
        rows = sorted((r for r in found if r["component"] == c), key=lambda r: r["vec_id"])
        got = np.array([r["whitened"] for r in rows])
        sign = np.sign(got @ wanted[:, c - 1])
        assert np.abs(sign * got - wanted[:, c - 1]).max() < 1e-9
        assert abs(rows[0]["explained"] - e[c - 1] / e.sum()) < 1e-12
        assert [r["deviation"] for r in rows] == [sum((400 * v - s) ** 2 for v, s in zip(row, sums)) for row in x]
    assert {r["n"] for r in found} == {400}
    assert found[0]["identity_error"] < 1e-9


def test_dropped_and_repeated_rows(spark):
    rows = [
        (1, None), (2, [1.0, None]), (3, [math.nan, 0.0]), (4, [math.inf, 0.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]),
        (None, [0.5, 0.25]), (7, [0.125]), (8, []),
    ]
    found = run(spark, rows)
    assert sorted((r["vec_id"] or 0, r["component"]) for r in found) == sorted((i, c) for i in (5, 5, 0, 7, 8) for c in (1, 2))
    x, _, wanted = dense([[1, 2], [1, 2], [0.5, 0.25], [0.125, 0], [0, 0]])
    first = {r["vec_id"]: r for r in found if r["component"] == 1}
    for at, i in ((0, 5), (2, None), (3, 7), (4, 8)):
        assert abs(abs(first[i]["whitened"]) - abs(wanted[at, 0])) < 1e-9
        assert first[i]["deviation"] == sum((5 * v - s) ** 2 for v, s in zip(x[at], x.sum(0)))


def test_no_variance(spark):
    found = run(spark, [(i, [1.0, float(i)]) for i in range(4)])
    second = [r for r in found if r["component"] == 2]
    assert all(r["whitened"] is None and r["explained"] < 1e-12 for r in second)
    assert found[0]["identity_error"] < 1e-9
    assert all(r["whitened"] is None and r["deviation"] == 0 for r in run(spark, [(1, [2.0, 3.0])]))


def test_beyond_a_long(spark):
    found = run(spark, [(1, [1e300]), (2, [1e9]), (3, [-1e9])])
    assert found[0]["deviation"] is None
    far = [(1 << 62) + 100000, 1024 * 10**9 + 100000, -1024 * 10**9 + 100000]
    exact = {r["vec_id"]: r["deviation_exact"] for r in found}
    wanted = [(3 * x - sum(far)) ** 2 for x in far]
    assert [exact[i] if exact[i] is None else int(exact[i]) for i in (1, 2, 3)] == [v if v < 10**38 else None for v in wanted]


def test_empty_tables_and_other_columns(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [])]) == []
    df = spark.createDataFrame([(1, [1.0], 2, 3), (2, [2.0], 2, 3)], "vec_id long, embedding array<float>, n int, vector int")
    assert len(whitening.whiten(df, "vec_id", "embedding", Store(spark, "whiten-test")).collect()) == 2


def test_query(spark):
    found = QUERIES["op11_whitening"].run(spark, "/root/testdata/sf0.001")
    assert found.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert found.count() == 500 * 8
    assert found.first()["identity_error"] < 1e-9
