"""Words, near pairs and forms against a plain search."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lacuna.llm import spelling
from lacuna.llm.queries import QUERIES, table
from lacuna.llm.store import Store

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}


def brute_near(words):
    """Near words by what is left of both after one place is taken out, told by place or not."""
    near = {w: set() for w in words}
    same, shorter = {}, {}
    for w in words:
        for i in range(len(w)):
            same.setdefault((i, w[:i], w[i + 1 :]), []).append(w)
            shorter.setdefault(w[:i] + w[i + 1 :], []).append(w)
    for group in same.values():
        for a in group:
            near[a].update(b for b in group if b != a)
    for w in words:
        for longer in shorter.get(w, []):
            near[w].add(longer)
            near[longer].add(w)
    return near


def brute(rows):
    words = brute_words(rows)
    near = brute_near(words)
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            if words[best] >= 5 * words[w]:
                form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.add((w, f, root, n, len(near[w]), words[f] if f else None))
    return out


def run(spark, rows):
    docs = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, SCHEMA)
    return [tuple(r) for r in spelling.variants(docs, Store(spark, "spelling-test")).collect()]


def same(spark, rows):
    found = run(spark, rows)
    assert len(found) == len(set(found))
    assert set(found) == brute(rows)
    return {r[0]: r for r in found}


def test_chain_of_forms(spark):
    text = "Colour " * 700 + "coloure " * 130 + "coloures " * 24 + "colur " * 9 + "colvur " * 5 + "co-lour collours"
    found = same(spark, [(1, text), (2, None), (3, ""), (4, "short " * 9)])
    assert found["coloures"][1:3] == ("coloure", "colour")


def test_ties_go_to_the_first_in_code_point_order(spark):
    found = same(spark, [(1, "zebras " * 50 + "zebrat " * 50 + "zebraé " * 50 + "zebra× " * 50 + "zebrax " * 6)])
    assert found["zebrax"][1] == "zebras"


@pytest.mark.parametrize("n", [700])
def test_damage_by_id_and_null_ids(spark, n):
    rows = [(i if i % 7 else None, "Äpfelmus straßen ÉTUDES naïveté strassen straßem") for i in range(n)]
    found = same(spark, rows + rows[:50])
    assert "straßen" in found


def test_random_words_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_WORDS", 5)
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abé"), size=rng.integers(6, 9))) for _ in range(400)]
    text = " ".join(w for w in words for _ in range(int(rng.integers(5, 40))))
    found = same(spark, [(1, text)])
    assert sum(r[4] for r in found.values()) > 300


def test_more_groups_of_letters_lose_nothing(spark, monkeypatch):
    docs = [(1, " ".join(f"{a}{b}abab" for a in "abcdefgh" for b in "ijklmnop" for _ in range(6)))]
    monkeypatch.setattr(spelling, "letter_groups", lambda words: list("abcdefgh") + ["ijkl", "mnop"])
    same(spark, docs)


def test_very_long_words(spark):
    long = "ab" * 30_000
    same(spark, [(1, " ".join([long] * 26 + [long + "c"] * 5 + ["x" + long[1:]] * 5 + [long[:-2] + "ba"] * 5))])


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=7), st.text("abc", min_size=1, max_size=8))
def test_one_edit(a, b):
    if not len(a) <= len(b) <= len(a) + 1:
        return
    one = np.array([0])
    wanted = (
        sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b) else any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
    )
    ca, cb = spelling._codes([a]), spelling._codes([b])
    assert bool(spelling.one_edit(ca, cb, one, one)[0]) == wanted
    if wanted:
        assert len(spelling.close_pairs(ca, cb)[0]) == 1


def test_empty_tables_and_other_columns(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None)]) == []
    docs = spark.createDataFrame([(1, "lengthy " * 6, "a", 2)], "doc_id long, text string, word string, n int")
    assert run(spark, docs) == [("lengthy", None, "lengthy", 6, 0, None)]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    found = QUERIES["op12_spelling"].run(spark, folder)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    assert {tuple(r) for r in found.collect()} == brute(rows)
