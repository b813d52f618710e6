"""Benchmark passages in documents, found in a latent space and confirmed word by word.

The words of the benchmark items are the features. Document passages (24 words,
disjoint) and item passages are TF-IDF rows; features in more than ``COMMON`` of all document
passages are left out, but for the rarest few of each item passage. A randomised
SVD by subspace iteration gives the latent space: every pass multiplies the rows, where they lie, with a
features-by-rank matrix, and only sums of that shape leave the tasks. Item passages weigh in
total as much as all documents, so that the space keeps the directions asked about.

Windows of 48 words (two passages) that hold three features or more and whose latent cosine to an item passage is at least
``COSINE`` are candidates. Around each the longest common subsequence with the whole item is taken,
and the item's last words, where its answer stands, are looked for in one piece. An item
is in a document if the subsequence has 80 % of its words, or 60 % and the answer.

Items are handled in blocks of bounded size: a block of the stated query set meets all
rows, whatever the number of items.

Defined cases: null and empty texts, of documents or items, match nothing; of repeated item
ids each row counts; without items nothing is found. Words are lower-cased, in all scripts, and compared
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.store import Store
from lacuna.llm.words import hash_words, small_batches

PASSAGE = 24
COMMON = 0.001
RAREST = 6
TOGETHER = 3
"""Features that a window must hold at least, or as many as the item passage with the fewest."""
RANK = 512
OVERSAMPLING = 10
COSINE = 0.45
BLOCK_WORDS = 20_000
ANSWER = 5
ENOUGH, WITH_ANSWER = 0.8, 0.6
_TOKENS_AT_ONCE = 4096
FETCHES = 8


@dataclass
class Items:
    """A block of benchmark items: their words as hashes, the features, and the passages as lists of features."""

    ids: list
    words: list[np.ndarray]
    vocabulary: np.ndarray
    passages: list[np.ndarray]
    item_of_passage: np.ndarray


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return hash_words(pc.utf8_lower(column))


def _items(rows: pd.DataFrame) -> Items:
    hashes, bounds = _hashed(pa.array(rows["text"], pa.string(), from_pandas=True))
    words = [hashes[bounds[i] : bounds[i + 1]] for i in range(len(rows))]
    vocabulary = np.unique(hashes)
    passages, owner = [], []
    for i, w in enumerate(words):
        last = max(0, len(w) - PASSAGE)
        for at in sorted({*range(0, last + 1, PASSAGE), last}) if len(w) else []:
            passages.append(np.searchsorted(vocabulary, np.unique(w[at : at + PASSAGE])))
            owner.append(i)
    return Items(rows["item_id"].tolist(), words, vocabulary, passages, np.array(owner, np.int64))


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    rows = benchmark.where(F.trim("text") != "").select("item_id", "text")
    total = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toPandas()
        items = _items(part.sort_values(["item_id", "text"]))
        if items.passages:
            yield items


class _Lookup:
    """Places of hashes in a sorted vocabulary, -1 if absent."""

    def __init__(self, vocabulary: np.ndarray):
        self.vocabulary = vocabulary
        self.present = np.zeros(1 << 20, bool)
        self.present[vocabulary >> np.uint64(44)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the known hashes among ``hashes``, their features)."""
        maybe = np.flatnonzero(self.present[hashes >> np.uint64(44)])
        found = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        known = self.vocabulary[found] == hashes[maybe]
        return maybe[known], found[known]


def _cells(bounds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The passage of each word, numbered through a batch so that texts are two numbers apart."""
    counts = -(-np.diff(bounds) // PASSAGE) + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    row = np.searchsorted(bounds, at, side="right") - 1
    return first[row] + (at - bounds[row]) // PASSAGE


def _passage_words(docs: DataFrame, vocabulary) -> DataFrame:
    """Features of each small batch of documents: (passages, cells, features), the latter two in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(vocabulary.value)
        for batch in small_batches(batches):
            hashes, bounds = _hashed(batch.column("text"))
            at, feature = lookup(hashes)
            # A word counts once in a passage.
            pairs = np.unique(_cells(bounds, at) * len(vocabulary.value) + feature)
            cells, features = np.divmod(pairs, len(vocabulary.value))
            steps = np.diff(cells, prepend=0).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int((-(-np.diff(bounds) // PASSAGE)).sum())]),
                    pa.array([steps.tobytes()], pa.binary()),
                    pa.array([features.astype(np.uint32).tobytes()], pa.binary()),
                ],
                names=["passages", "cells", "features"],
            )

    return docs.select("text").mapInArrow(run, "passages long, cells binary, features binary")


def _unpack(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for cells, features in zip(batch.column("cells").to_pylist(), batch.column("features").to_pylist(), strict=True):
        yield np.cumsum(np.frombuffer(cells, np.uint32).astype(np.int64)), np.frombuffer(features, np.uint32)


def _frequencies(found: DataFrame, features: int) -> tuple[int, np.ndarray]:
    """How many passages there are, and how many hold each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(features, np.int64)
        for batch in batches:
            for _, f in _unpack(batch):
                counts += np.bincount(f, minlength=features)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["feature", "n"])

    total = found.agg(F.sum("passages")).first()[0] or 0
    out = np.zeros(features, np.int64)
    for feature, n in found.mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n")).collect():
        out[feature] = n
    return total, out


def _rare_only(found: DataFrame, weights) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = weights.value > 0
        for batch in batches:
            cells, features = [], []
            for c, f in _unpack(batch):
                mine = use[f]
                c, f = c[mine], f[mine]
                # A passage with one feature tells nothing of features together; the diagonal adds it.
                _, place, n = np.unique(c, return_inverse=True, return_counts=True)
                c, f = c[n[place] > 1], f[n[place] > 1]
                cells.append(np.diff(c, prepend=0).astype(np.uint32).tobytes())
                features.append(f.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells, pa.binary()), pa.array(features, pa.binary())], names=["cells", "features"]
            )

    return found.mapInArrow(run, "cells binary, features binary")


def _sums(rows: np.ndarray, values: np.ndarray, of: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``values[i] * matrix[of[i]]`` over equal, adjacent ``rows``; and where each begins."""
    first = np.flatnonzero(np.diff(rows, prepend=rows[0] - 1))
    return np.add.reduceat(values[:, None] * matrix[of], first, axis=0), first


def _whole_rows(cells: np.ndarray) -> Iterator[slice]:
    """Pieces of bounded size that end where a passage ends; a passage has 24 features at most."""
    at = 0
    while at < len(cells):
        stop = min(len(cells), at + _TOKENS_AT_ONCE)
        while stop < len(cells) and cells[stop] == cells[stop - 1]:
            stop += 1
        yield slice(at, stop)
        at = stop


def _multiply(rare: DataFrame, weights, matrix: np.ndarray) -> np.ndarray:
    """A'A times ``matrix``, for the rows A of ``rare``."""
    context = rare.sparkSession.sparkContext
    shared = context.broadcast(matrix)
    width = matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, w = shared.value, weights.value
        total, touched = np.zeros_like(m), np.zeros(len(m), bool)
        for batch in batches:
            for cells, features in _unpack(batch):
                for s in _whole_rows(cells):
                    c, f = cells[s], features[s]
                    latent, first = _sums(c, w[f], f, m)
                    row = np.repeat(np.arange(len(first)), np.diff(first, append=len(c)))
                    order = np.argsort(f, kind="stable")
                    sums, starts = _sums(f[order].astype(np.int64), w[f[order]], row[order], latent)
                    total[f[order][starts]] += sums
                touched[features] = True
        some = np.flatnonzero(touched)
        for at in range(0, len(some), 1000):
            part = some[at : at + 1000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), pa.array([total[i].tobytes() for i in part], pa.binary())], names=["feature", "row"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            for feature, row in zip(batch.column("feature").to_pylist(), batch.column("row").to_pylist(), strict=True):
                row = np.frombuffer(row, np.float32)
                total[feature] = total[feature] + row if feature in total else row
        for feature, row in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([feature]), pa.array([row.tobytes()], pa.binary())], names=["feature", "row"])

    kind = "feature long, row binary"
    out = np.zeros((len(matrix), width))
    # Bounded by the features of a block, whatever the number of documents. Each partition that is fetched is a job of the driver's.
    sums = rare.mapInArrow(run, kind).repartition("feature").mapInArrow(add, kind).repartition(FETCHES)
    for r in sums.toLocalIterator():
        out[r["feature"]] = np.frombuffer(r["row"], np.float32)
    shared.destroy()  # the driver's own copy as well
    return out


@dataclass
class LatentSpace:
    """Weights of the features (0: left out), their latent vectors, and the unit vectors of the item passages."""

    weights: np.ndarray
    vectors: np.ndarray
    queries: np.ndarray
    together: int


def fit(docs: DataFrame, items: Items, store: Store) -> LatentSpace:
    """The latent space of the documents' and the items' passages."""
    context = docs.sparkSession.sparkContext
    features = len(items.vocabulary)
    words = context.broadcast(items.vocabulary)
    found = store.keep(_passage_words(docs, words), "features")
    words.destroy()
    total, df = _frequencies(found, features)
    weights = np.log((2 + total) / (1 + df))
    kept = df <= COMMON * total
    for p in items.passages:
        kept[p[np.argsort(df[p], kind="stable")[:RAREST]]] = True
    weights = np.where(kept, weights, 0).astype(np.float32)
    shared = context.broadcast(weights)
    rare = store.keep(_rare_only(found, shared), "rare")
    store.drop("features")

    asked = _unit_rows(items.passages, weights)
    diagonal = df * weights.astype(float) ** 2
    energy = max(1.0, diagonal.sum()) / len(asked)
    rank = min(RANK, features, max(64, len(asked)))
    basis = np.random.default_rng(7).standard_normal((features, min(features, rank + OVERSAMPLING)))

    def times(x: np.ndarray) -> np.ndarray:
        out = _multiply(rare, shared, x.astype(np.float32))
        # Passages with one feature are on the diagonal only; the others' share of it is in ``out``.
        for at, cell in enumerate(singles):
            out[at] += cell * x[at]
        for p, w in asked:
            out[p] += energy * w[:, None] * (w @ x[p])
        return out

    singles = diagonal - _diagonal(rare, shared)
    basis, _ = np.linalg.qr(times(basis))
    image = times(basis)
    values, turn = np.linalg.eigh(basis.T @ image)
    vectors = (basis @ turn[:, np.argsort(-values)[:rank]]).astype(np.float32)
    shared.destroy()
    queries = np.stack([w.astype(np.float32) @ vectors[p] for p, w in asked])
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)
    together = min(TOGETHER, *[int((weights[p] > 0).sum()) for p in items.passages])
    return LatentSpace(weights, vectors, queries, together)


def _unit_rows(passages: list[np.ndarray], weights: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, weights scaled to length 1) of each item passage."""
    rows = [(p, weights[p].astype(float)) for p in passages]
    return [(p, w / max(np.linalg.norm(w), 1e-12)) for p, w in rows]


def _diagonal(rare: DataFrame, weights) -> np.ndarray:
    _, n = _frequencies(rare.select(F.lit(0).alias("passages"), "cells", "features"), len(weights.value))
    return n * weights.value.astype(float) ** 2


def common_subsequence(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, all words of the item at once in the bits of a number."""
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    open_ = full
    for w in text:
        hit = open_ & places.get(w, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(item) - open_.bit_count()


def _in_one_piece(part: np.ndarray, text: np.ndarray) -> bool:
    if len(text) < len(part):
        return False
    at = np.arange(len(text) - len(part) + 1)
    hit = np.ones(len(at), bool)
    for j, w in enumerate(part):
        hit &= text[at + j] == w
    return bool(hit.any())


def _candidates(hashes, bounds, lookup, space) -> Iterator[tuple[int, int, int]]:
    """(row, first word of a window, item passage) of the windows near to an item passage."""
    at, feature = lookup(hashes)
    mine = space.weights[feature] > 0
    at, feature = at[mine], feature[mine]
    if not len(at):
        return
    all_cells = _cells(bounds, at)
    pairs, keep = np.unique(all_cells * len(space.weights) + feature, return_index=True)
    cells, feature, at = all_cells[keep], feature[keep], at[keep]
    row = np.searchsorted(bounds, at, side="right") - 1
    start = bounds[row] + (at - bounds[row]) // PASSAGE * PASSAGE
    for s in _whole_rows(cells):
        # The passage before the first and after the last of a piece belong to its windows too.
        low, high = np.searchsorted(cells, cells[s][0] - 1), np.searchsorted(cells, cells[s][-1] + 1, side="right")
        c, f = cells[low:high], feature[low:high]
        first = np.flatnonzero(np.diff(c, prepend=c[0] - 1))
        n = np.diff(first, append=len(c))
        follows = np.diff(c[first], append=c[-1] + 2) == 1
        # A window is a passage with the next one; where the next or the one before has no feature, it is alone.
        both = np.flatnonzero(follows & (n + np.append(n[1:], 0) >= space.together))
        alone = np.flatnonzero(~(follows & np.insert(follows[:-1], 0, False)) & (n >= space.together))
        if not len(both) + len(alone):
            continue
        latent, _ = _sums(c, space.weights[f], f, space.vectors)
        window = np.concatenate([latent[both] + latent[both + 1], latent[alone]])
        at_cell = first[np.concatenate([both, alone])]
        begin, own = start[low:high][at_cell], row[low:high][at_cell]
        window /= np.maximum(np.linalg.norm(window, axis=1, keepdims=True), 1e-12)
        i, q = np.nonzero(window @ space.queries.T >= COSINE)
        yield from zip(own[i].tolist(), begin[i].tolist(), q.tolist(), strict=True)


def _leaks(column: pa.Array, items: Items, lookup: _Lookup, space: LatentSpace) -> list[list[dict]]:
    hashes, bounds = _hashed(column)
    places: dict[tuple[int, int], set[int]] = {}
    for row, begin, passage in _candidates(hashes, bounds, lookup, space):
        places.setdefault((row, int(items.item_of_passage[passage])), set()).add(begin)
    out: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
    for (row, item), begins in sorted(places.items()):
        words = items.words[item]
        asked, best = words.tolist(), None
        for begin in sorted(begins):
            low = max(bounds[row], begin - len(words))
            high = min(bounds[row + 1], begin + 2 * PASSAGE + len(words))
            near = hashes[low:high]
            matched = common_subsequence(asked, near.tolist())
            ratio = matched / len(words)
            if ratio >= WITH_ANSWER:
                answer = _in_one_piece(words[-ANSWER:], near)
                if (ratio >= ENOUGH or answer) and (best is None or matched > best["matched_words"]):
                    best = {
                        "item_id": items.ids[item], "matched_words": matched, "item_words": len(words),
                        "ratio": ratio, "answer": answer, "near_word": int(begin - bounds[row]),
                    }
        if best:
            out[row].append(best)
    return out


LEAKS = "array<struct<item_id: bigint, matched_words: bigint, item_words: bigint, ratio: double, answer: boolean, near_word: bigint>>"


def with_leaks(docs: DataFrame, benchmark: DataFrame, store: Store) -> DataFrame:
    """``docs`` with ``leaks``: the benchmark items that each text holds. A column of that name is replaced."""
    columns = [c for c in docs.columns if c != "leaks"]
    found = docs.select(*[F.col(f"`{c}`") for c in columns], F.array().cast(LEAKS).alias("leaks"))
    for n, items in enumerate(_blocks(benchmark)):
        space = fit(docs, items, Store(store.spark, f"latent-{n}"))
        shared = docs.sparkSession.sparkContext.broadcast((items, space))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, space = shared.value
            lookup = _Lookup(items.vocabulary)
            for batch in small_batches(batches):
                leaks = _leaks(batch.column("text"), items, lookup, space)
                old = batch.column("leaks").to_pylist()
                at = batch.schema.get_field_index("leaks")
                new = pa.array([a + b for a, b in zip(old, leaks, strict=True)], batch.schema.field(at).type)
                yield batch.set_column(at, batch.schema.field(at), new)

        found = found.mapInArrow(run, found.schema)
    return found
