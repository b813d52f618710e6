"""Scores of whole texts under a recurrent language model trained on the corpus.

Words are counted over all training texts. The ``WORDS`` most frequent, the end of a text among them, are
words of the recurrent model (see gru.py); all others share one class, in which a word has its
smoothed share of the counts, so the model is a distribution over all words.

Training reads all training texts, each once, so it grows with the corpus (``TRAIN_SHARE`` is for trials on
fewer, chosen by the hash of their id). Workers go through their part of it in each of ``ROUNDS`` rounds
and start each from the mean of their parameters; sums are made on the executors.

Counts of the ``LOCAL_COUNTS`` most frequent words go to every worker; those of all other words
are joined to the words of the texts that need them.

Defined cases: null and empty texts are their end alone. A null id is in no held-out set. Rows with equal
ids are separate documents. Without training texts all counts are 0 and all words equally likely.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm import gru
from lacuna.llm.store import Store
from lacuna.llm.words import hash_words, small_batches, stream

WORDS = 4096
LOCAL_COUNTS = 1 << 17
TRAIN_SHARE = 1.0
ROUNDS = 2
WORKER_TOKENS = 2_000_000
"""Tokens that a worker reads, about, in all rounds; there are as many workers as that takes."""
END = int(stream(99, 1)[0])
"""Stands for the end of a text, beside the hashes of words."""
_MERGE_AT = 1_500_000
_TEXTS_TOKENS = 1_500_000
_LEARN_TOKENS = WORKER_TOKENS // ROUNDS * 3 // 2
"""A worker's part of a round is about two thirds of that: a small rest of it would be learned in narrow windows, which cost more a word."""


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word, as a hash, occurs in the texts; an end for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, texts = [], 0, 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words = np.concatenate([w for w, _ in held])
            counts = np.concatenate([n for _, n in held])
            order = np.argsort(words)
            words, counts = words[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            return words[first], np.add.reduceat(counts, first)

        def out(words: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(words), 100_000):
                s = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(words[s])), pa.array(counts[s])], names=["word", "n"])

        for batch in small_batches(batches):
            words, n = np.unique(hash_words(batch.column("text"))[0], return_counts=True)
            held.append((words, n))
            size += len(words)
            texts += batch.num_rows
            if size > _MERGE_AT:
                held = [merged()]
                size = len(held[0][0])
                if size > _MERGE_AT // 2:  # bounded memory: pass on what is there
                    yield from out(*held[0])
                    held, size = [], 0
        if texts:
            held.append((np.array([END], np.uint64), np.array([texts])))
            yield from out(*merged())

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The model's words in rank order, and the counts of the most frequent words; both by sorted hash."""

    def __init__(self, top: list[tuple[int, int]], total: int, distinct: int):
        hashes = np.array([w for w, _ in top], np.int64).view(np.uint64)
        counts = np.array([n for _, n in top], np.int64)
        self.total, self.distinct = total, distinct
        self.ranked = counts[:WORDS]
        self.words = len(self.ranked)
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.ids = np.where(order < self.words, order, self.words).astype(np.int32)
        # For each start of 22 bits the number of the first hash that has it, -1 without one.
        starts, first, sizes = np.unique(self.hashes >> np.uint64(42), return_index=True, return_counts=True)
        self.slots = np.full(1 << 22, -1, np.int32)
        self.slots[starts] = first
        self.most_in_slot = int(sizes.max(initial=0))
        # What is left for the words that the model does not know.
        self.others = int(total - self.ranked.sum())
        self.other_words = int(distinct - self.words)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the model, counts; -1 where the count is not here)."""
        ids, counts = np.full(len(hashes), self.words, np.int32), np.full(len(hashes), -1, np.int64)
        first = self.slots[hashes >> np.uint64(42)]
        maybe = np.flatnonzero(first >= 0)
        at = first[maybe]
        for _ in range(self.most_in_slot):
            known = self.hashes[at] == hashes[maybe]
            ids[maybe[known]], counts[maybe[known]] = self.ids[at[known]], self.counts[at[known]]
            # Those after it, as long as there are any.
            other = ~known & (at + 1 < len(self.hashes))
            maybe, at = maybe[other], at[other] + 1
            if not len(maybe):
                break
        return ids, counts

    def texts(self, column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """For each text the ids, the counts and the hashes of its words and its end."""
        hashes, bounds = hash_words(column)
        ends = bounds[1:]
        hashes = np.insert(hashes, ends, np.uint64(END))
        ids, counts = self.look_up(hashes)
        cuts = (ends + np.arange(1, len(ends) + 1))[:-1]
        return np.split(ids, cuts), np.split(counts, cuts), np.split(hashes, cuts)


def _vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    top = counts.orderBy(F.desc("n"), "word").limit(LOCAL_COUNTS).toPandas()
    return Vocabulary(list(zip(top["word"].tolist(), top["n"].tolist(), strict=True)), total or 0, distinct)


def _parts(p: gru.Parameters) -> Iterator[tuple[int, bytes]]:
    flat = np.concatenate([p[k].reshape(-1) for k in sorted(p)])
    for i, x in enumerate(np.array_split(flat, 64)):
        yield i, x.astype(np.float32).tobytes()


def _whole(flat: np.ndarray, like: gru.Parameters) -> gru.Parameters:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def train(docs: DataFrame, vocabulary: Vocabulary, store: Store) -> gru.Parameters:
    """Parameters after ``ROUNDS`` rounds, each over another part of the chosen texts."""
    context = store.spark.sparkContext
    shared = context.broadcast(vocabulary)
    lot = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), "text")), F.lit(1 << 20))
    chosen = docs.where(lot < int(TRAIN_SHARE * (1 << 20)))
    p = gru.initial(vocabulary.ranked, vocabulary.others + 0.1 * vocabulary.other_words)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids = [x.tobytes() for x in shared.value.texts(batch.column("text"))[0]]
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(ids, pa.binary())], names=["place", "ids"])

    place = F.xxhash64("doc_id", F.lit("worker"))
    texts = store.keep(chosen.select("text", place.alias("place")).mapInArrow(read, "place long, ids binary"), "training")

    tokens = texts.agg(F.sum(F.length("ids"))).first()[0] or 0
    workers = -(-tokens // (4 * WORKER_TOKENS)) or 1

    def learn(start) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trainer = gru.Trainer(start.value, shared.value.words)
            seen, held, size = 0, [], 0
            for batch in batches:
                for x in batch.column("ids").to_pylist():
                    held.append(np.frombuffer(x, np.int32))
                    size += len(held[-1])
                    if size > _LEARN_TOKENS:
                        trainer.learn(held)
                        seen, held, size = seen + size, [], 0
            if held:
                trainer.learn(held)
            seen += size
            if seen:
                parts = list(_parts(trainer.p))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([i for i, _ in parts], pa.int32()),
                        pa.array([float(seen)] * len(parts)),
                        pa.array([x for _, x in parts], pa.binary()),
                    ],
                    names=["part", "weight", "numbers"],
                )

        return run

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for part, weight, x in zip(*[batch.column(c).to_pylist() for c in ("part", "weight", "numbers")], strict=True):
                x = np.frombuffer(x, np.float32).astype(np.float64) * weight
                held = sums.setdefault(part, [0.0, 0.0])
                held[0] += weight
                held[1] = held[1] + x
        for part, (weight, x) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([weight]), pa.array([(x / weight).astype(np.float32).tobytes()], pa.binary())],
                names=["part", "weight", "numbers"],
            )

    kind = "part int, weight double, numbers binary"
    for r in range(ROUNDS):
        mine = texts.where(F.pmod(F.shiftright("place", 20), F.lit(ROUNDS)) == r)
        # The order of the texts is the same on every run.
        dealt = mine.repartition(workers, "place").sortWithinPartitions("place", "ids").select("ids")
        means = dealt.mapInArrow(learn(context.broadcast(p)), kind).repartition(8, "part").mapInArrow(mean, kind).collect()
        if means:
            flat = np.concatenate([np.frombuffer(x["numbers"], np.float32) for x in sorted(means, key=lambda x: x["part"])])
            p = _whole(flat, p)
    return p


def _scored(docs: DataFrame, vocabulary: Vocabulary, p: gru.Parameters) -> DataFrame:
    """Per row: what the worker can tell, and the words whose counts it does not have."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, p))
    names = ["row_no", "doc_id", "n_tokens", "n_here", "base_here", "others", "others_here", "model", "elsewhere"]

    def score(held: list) -> pa.RecordBatch:
        v, parameters = shared.value
        rows, ids, counts, hashes = zip(*held, strict=True)
        model = gru.score(parameters, v.words, list(ids)) / np.log(10)
        logs = [np.log10(c[c >= 0] + 0.1) for c in counts]
        others = [np.log10(c[(c >= 0) & (i == v.words)] + 0.1) for c, i in zip(counts, ids, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r for r, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.int64()),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array([int((c > 0).sum()) for c in counts], pa.int64()),
                pa.array([float(x.sum()) for x in logs]),
                pa.array([int((i == v.words).sum()) for i in ids], pa.int64()),
                pa.array([float(x.sum()) for x in others]),
                pa.array(model),
                pa.array([_signed(h[c < 0]) for h, c in zip(hashes, counts, strict=True)], pa.list_(pa.int64())),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in small_batches(batches):
            rows = zip(batch.column("row_no").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)
            new = list(zip(rows, *shared.value[0].texts(batch.column("text")), strict=True))
            held += new
            size += sum(len(x[1]) for x in new)
            if size > _TEXTS_TOKENS:
                yield score(held)
                held, size = [], 0
        if held:
            yield score(held)

    schema = (
        "row_no long, doc_id long, n_tokens long, n_here long, base_here double, others long, "
        "others_here double, model double, elsewhere array<long>"
    )
    return docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "text").mapInArrow(run, schema)


def score_texts(docs: DataFrame, training: DataFrame, store: Store) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``, by ``training``.

    Both have the columns doc_id and text. Scores are log10 probabilities of the whole text with its end:
    base_score by single smoothed words, score by the recurrent model.
    """
    counts = store.keep(count_words(training), "counts")
    vocabulary = _vocabulary(counts)
    p = train(training, vocabulary, store)
    rows = store.keep(_scored(docs, vocabulary, p), "scored")
    far = rows.select("row_no", F.explode("elsewhere").alias("word"))
    n = F.coalesce("n", F.lit(0))
    by_row = (
        far.join(counts, "word", "left").groupBy("row_no")
        .agg(F.sum(F.log10(n + 0.1)).alias("far"), F.sum((n > 0).cast("long")).alias("far_known"))
    )
    total, distinct = vocabulary.total, vocabulary.distinct
    base = float(np.log10(total + 0.1 * (distinct + 1)))
    other = float(np.log10(vocabulary.others + 0.1 * (vocabulary.other_words + 1)))
    far_logs = F.coalesce("far", F.lit(0.0))
    return rows.drop("elsewhere").join(by_row, "row_no", "left").select(
        "doc_id", "n_tokens",
        (F.col("n_here") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_here") + far_logs - F.col("n_tokens") * base).alias("base_score"),
        (F.col("model") + F.col("others_here") + far_logs - F.col("others") * other).alias("score"),
    )
