"""Spelling variants: words one edit apart, found by Gram matrices of letter counts.

Two words one edit apart have letter counts whose squared distance is at most two: a replaced letter
takes one from a count and adds one to another, an inserted one adds one. So words are put in blocks
by how many of their letters fall into each of a few groups of letters. One edit leads from such a key to
keys that differ by one in one group (the length too, then) or by one up and one down. Blocks of such
keys meet once, and within a pair of blocks a matrix product of the letter counts gives all
squared distances. Pairs at most two apart are then verified letter by letter. No rows of
pairs are made; a pair of blocks returns what its words' near words sum up to.

The groups are balanced by how often letters occur, and there are more of them the more words
there are, so that the work for a word grows slowly. A key with many words is split
into blocks of bounded size.

Words are the maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased, where every run whose hash
is divisible by DAMAGE has lost one letter (planted misspellings), of at least six code points and with five occurrences.

Defined cases: a null text has no words; a null id counts as an empty one in the hash; repeated rows count as often as
they are there. Of near words with equal counts the first in code-point order is the form. Words of any length are
compared whole. Without words the result is empty. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.store import Store

LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, DAMAGE, DOMINATES = 6, 5, 199, 5
BLOCK_WORDS, BLOCK_LETTERS, CHECKED_LETTERS = 512, 1 << 16, 1 << 21
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(docs: DataFrame) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text)."""
    # A shorter run gives no word of enough letters, damaged or not.
    runs = F.regexp_extract_all("text", F.lit(f"({LETTERS}{{{LEAST_LENGTH},}})"), F.lit(1))
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    words = words.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    hashed = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    gap = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.substring("run", F.lit(1), gap), F.substring("run", gap + 2, F.length("run")))
    word = F.when(F.col("h") % DAMAGE == 0, damaged).otherwise(F.col("run")).alias("word")
    counts = hashed.select(word).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def letter_groups(words: DataFrame) -> list[str]:
    """Letters in groups of about equal frequency; 90 letters at most."""
    n = words.count()
    groups = min(16, max(2, math.ceil(1.5 * math.log2(max(n, 1) / 50_000)))) if n else 2
    counts = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count().collect()
    found, load = [""] * groups, [0] * groups
    for letter, count in sorted(map(tuple, counts), key=lambda x: (-x[1], x[0])):
        least = load.index(min(load))
        found[least] += letter
        load[least] += count
    return found


def _key(counts: list[Column]) -> Column:
    return F.concat_ws(",", *counts)


def blocks(words: DataFrame, groups: list[str]) -> DataFrame:
    """(key, block, counts, words, ns): words with equal counts of each group, a bounded number at a time."""
    counts = [F.length("word") - F.length(F.translate("word", g, "")) if g else F.lit(0) for g in groups]
    keyed = words.select("word", "n", F.array(*counts).alias("counts"), F.length("word").alias("length"))
    keyed = keyed.withColumn("key", _key([F.col("counts")[i] for i in range(len(groups))]))
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.lit(BLOCK_LETTERS) / F.col("length"))))
    sizes = keyed.groupBy("key", "length").agg(F.count("*").alias("size"))
    sizes = sizes.select("key", F.ceil(F.col("size") / most).cast("int").alias("split"))
    block = F.pmod(F.xxhash64("word"), F.col("split")).cast("int").alias("block")
    return keyed.join(sizes, "key").groupBy("key", block).agg(
        F.first("counts").alias("counts"), F.collect_list("word").alias("words"), F.collect_list("n").alias("ns")
    )


def block_pairs(found: DataFrame, groups: int) -> DataFrame:
    """Pairs of blocks between which one edit can lead, each once."""
    counts = [F.col("counts")[i] for i in range(groups)]

    def moved(up: int, down: int | None) -> Column:
        return _key([c + 1 if i == up else c - 1 if i == down else c for i, c in enumerate(counts)])

    steps = [_key(counts)]
    steps += [moved(i, None) for i in range(groups)]
    steps += [F.when(counts[j] > 0, moved(i, j)) for i in range(groups) for j in range(i + 1, groups)]
    left = found.select(
        F.col("key").alias("from"), F.col("block").alias("from_block"), F.col("words").alias("a"), F.col("ns").alias("an"),
        F.explode(F.array(*steps)).alias("key"),
    )
    pairs = left.join(found.select("key", "block", F.col("words").alias("b"), F.col("ns").alias("bn")), "key")
    pairs = pairs.where((F.col("from") != F.col("key")) | (F.col("from_block") <= F.col("block")))
    same = (F.col("from") == F.col("key")) & (F.col("from_block") == F.col("block"))
    return pairs.select("a", "an", "b", "bn", same.alias("same"))


def _codes(words: list[str]) -> np.ndarray:
    """Code points, a row for each word; all have the same length."""
    return np.array(words, dtype=f"<U{len(words[0])}").view(np.uint32).reshape(len(words), -1)


def _letter_counts(codes: np.ndarray) -> np.ndarray:
    rows, length = codes.shape
    flat = np.bincount((np.arange(rows)[:, None] * 256 + codes).reshape(-1), minlength=rows * 256)
    # Sums of squares of counts are exact in 24 bits up to this length.
    return flat.reshape(rows, 256).astype(np.float32 if length < 2048 else np.float64)


def close_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of rows of codes whose letter counts are at most two apart, squared."""
    x, y = _letter_counts(a), _letter_counts(b)
    used = np.flatnonzero(x.any(0) | y.any(0))
    x, y = x[:, used], y[:, used]
    apart = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    return np.nonzero(apart <= 2.5)


def one_edit(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i of ``a`` and j of ``b`` are exactly one edit apart; ``b`` is as long or one longer."""
    out = np.zeros(len(i), dtype=bool)
    length = a.shape[1]
    step = max(1, CHECKED_LETTERS // length)
    for at in range(0, len(i), step):
        x, y = a[i[at : at + step]], b[j[at : at + step]]
        if b.shape[1] == length:
            out[at : at + step] = (x != y).sum(1) == 1
        else:
            # A common beginning and a common end that meet.
            begins = np.minimum.accumulate(x == y[:, :-1], axis=1).sum(1)
            ends = np.minimum.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(1)
            out[at : at + step] = begins + ends >= length
    return out


def _sums(words: np.ndarray, mine: np.ndarray, others: np.ndarray, counts: np.ndarray, rows: list) -> None:
    """For each word with near ones: how many, and the one with the largest count, ties by code points."""
    order = np.argsort(mine, kind="stable")
    starts = np.flatnonzero(np.diff(mine[order], prepend=-1))
    for group in np.split(order, starts[1:]):
        n, word = min((-int(counts[g]), others[g]) for g in group)
        rows.append((words[mine[group[0]]], len(group), -n, word))


def _compare(batches):
    for batch in batches:
        rows: list = []
        columns = [batch.column(c) for c in ("a", "an", "b", "bn", "same")]
        for a, an, b, bn, same in zip(*columns):
            wa, wb = a.as_py(), b.as_py()
            ca, cb = _codes(wa), _codes(wb)
            i, j = close_pairs(ca, cb)
            if bool(same.as_py()):
                i, j = i[i < j], j[i < j]
            good = one_edit(ca, cb, i, j)
            i, j = i[good], j[good]
            if len(i):
                na, nb = an.values.to_numpy(), bn.values.to_numpy()
                _sums(wa, i, [wb[x] for x in j], nb[j], rows)
                _sums(wb, j, [wa[x] for x in i], na[i], rows)
        if rows:
            word, n, best_n, best = zip(*rows)
            yield pa.RecordBatch.from_pydict({
                "word": pa.array(word), "n_near": pa.array(n, pa.int64()), "best_n": pa.array(best_n, pa.int64()), "best": pa.array(best),
            })


def near_words(words: DataFrame, store: Store) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have one near them."""
    groups = letter_groups(words)
    found = store.keep(blocks(words, groups), "blocks")
    parts = block_pairs(found, len(groups)).mapInArrow(_compare, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    sums = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return sums.select("word", "n_near", F.col("best.best").alias("best"), (-F.col("best.minus")).alias("best_n"))


def roots(forms: DataFrame, store: Store) -> DataFrame:
    """(word, root): where the forms of ``forms`` (word, form) lead. Each round doubles the steps taken.

    Counts grow along a chain by a factor, so its length, and with it the number of rounds, is bounded.
    """
    now, n = store.keep(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        if now.join(onward, "root", "left_semi").isEmpty():
            return now
        n += 1
        now = store.keep(
            now.join(onward, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), f"roots-{n}"
        )
        store.drop(f"roots-{n - 1}")


def variants(docs: DataFrame, store: Store) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs`` (doc_id, text)."""
    words = store.keep(words_of(docs), "words")
    near = store.keep(words.join(near_words(words, store), "word"), "near")
    has_form = F.col("best_n") >= DOMINATES * F.col("n")
    near = near.select(
        "word", "n_near", F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n")
    )
    found = words.join(near, "word", "left").join(roots(near.where("form IS NOT NULL"), store), "word", "left")
    return found.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )
