"""Language of a text by the nearest of several centroids per language.

Vectors are hashed character n-grams (bytes of letters, n = 1 to 3) with
weights ``log(1 + count) * idf``, scaled to length 1. The idf covers all training
rows. The centroids come from spherical k-means within each language, on at most
about ``sample_rows`` training rows in all, chosen by the hash of their text.

A text is rejected by its distance: each language has a least cosine for texts of each size (letters, by
powers of two), ``MARGIN`` times what all but the lowest hundredth of its own sampled rows of about that size reach,
and never less than ``reject_below``; where it has few such rows, those of all languages count.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and
rejected; so is every text if there is nothing to learn from. Of equally near
centroids the one of the alphabetically first language wins. Training rows
without text or language teach nothing. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm.words import small_batches, text_bytes

UNKNOWN = "und"
BUCKETS = 4096
SIZES, MARGIN, LEAST_ROWS = 40, 0.5, 20
_ROWS = 64

_LETTER = np.zeros(256, dtype=np.uint32)
for _b in range(ord("a"), ord("z") + 1):
    _LETTER[_b] = _b
for _b in range(ord("A"), ord("Z") + 1):
    _LETTER[_b] = _b + 32
_LETTER[128:] = np.arange(128, 256)


def _counts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Counts of the hashed n-grams of each row; a row's long text is handled in blocks."""
    rows, total = len(ends), np.zeros((len(ends), BUCKETS), np.float32)
    begin = np.concatenate([[0], ends[:-1]])
    for at in range(0, len(data), 1 << 20):
        stop = min(len(data), at + (1 << 20))
        low = max(0, at - 2)
        a = _LETTER[data[low:stop]]
        row = np.searchsorted(ends, np.arange(low, stop), side="right")
        place = np.arange(low, stop) - begin[row]
        row, place = row[at - low :], place[at - low :]
        c0 = a[at - low :]
        c1 = np.concatenate([np.zeros(2, np.uint32), a])[at - low + 1 :][: len(c0)]
        c2 = np.concatenate([np.zeros(2, np.uint32), a])[at - low :][: len(c0)]
        c1 = np.where(place >= 1, c1, 0)
        c2 = np.where(place >= 2, c2, 0)
        base = row.astype(np.int64) * BUCKETS
        some = c0 > 0
        two = c1 * 256 + c0
        three = two + c2 * 65536
        for grams, use, salt in ((c0, some, 1), (two, some | (c1 > 0), 2), (three, some & (c1 > 0), 3)):
            hashed = ((grams[use] + np.uint32(salt << 24)) * np.uint32(2654435769)) >> np.uint32(20)
            total += np.bincount(base[use] + hashed, minlength=rows * BUCKETS).reshape(rows, BUCKETS)
    return total


def _vectors(column: pa.Array, idf: np.ndarray | None) -> np.ndarray:
    data, ends = text_bytes(column)
    counts = _counts(data, ends)
    if idf is None:
        return counts
    weights = np.log1p(counts) * idf
    return weights / np.maximum(np.linalg.norm(weights, axis=1, keepdims=True), 1e-12)


def _sizes(column: pa.Array) -> np.ndarray:
    """The power of two of the number of letters of each row."""
    data, ends = text_bytes(column)
    so_far = np.concatenate([[0], np.cumsum(_LETTER[data] > 0)])
    letters = np.diff(so_far[np.concatenate([[0], ends])])
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(int), SIZES - 1)


def _floors(scores: np.ndarray, sizes: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """The least cosine of each size; sizes below those of which there are rows enough take what holds otherwise.

    Longer texts come nearer to their centroid, so no size asks for more than a larger one.
    """
    found = np.full(SIZES, np.inf)
    for size in range(SIZES):
        near = np.sort(scores[np.abs(sizes - size) <= 1])
        if len(near) >= LEAST_ROWS:
            found[size] = MARGIN * float(near[len(near) // 100])
    known = np.flatnonzero(np.isfinite(found))
    if not len(known):
        return otherwise
    found = np.minimum.accumulate(found[::-1])[::-1]
    found[known[-1] :] = found[known[-1]]
    found[: known[0]] = np.minimum(otherwise[: known[0]], found[known[0]])
    return np.maximum(found, otherwise.min())


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _k_means(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from rows far from the ones chosen before."""
    chosen = [0]
    nearest = vectors @ vectors[0]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centres = vectors[chosen]
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        sums = np.stack([vectors[own == j].sum(axis=0) if (own == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


@dataclass(frozen=True)
class CentroidModel:
    """Centroids (rows of length 1), the language of each, the idf, and the cosine by size below which each rejects a text."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray

    def predict(self, docs: DataFrame) -> DataFrame:
        """``docs`` with lang_pred, score (cosine, 0 to 1) and rejected."""
        model, columns = self, docs.columns
        keep = [c for c in columns if c not in ("lang_pred", "score", "rejected")]
        # Within the step columns go by number, so that any name will do.
        places = [f"column_{i}" for i in range(len(keep))]
        text, flag = places[keep.index("text")], "letters"
        inner = docs.select(
            *[F.col(f"`{c}`").alias(p) for c, p in zip(keep, places)], has_letter(F.col("text")).alias(flag)
        )
        schema = docs.select(*[F.col(f"`{c}`") for c in keep]).schema
        for name, kind in (("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")):
            schema = schema.add(name, kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for small in small_batches(batches, text):
                for at in range(0, small.num_rows, _ROWS):
                    batch = small.slice(at, _ROWS)
                    letters = batch.column(flag).to_numpy(zero_copy_only=False).astype(bool)
                    if model.languages:
                        near = _vectors(batch.column(text), model.idf) @ model.centroids.T
                        best = np.argmax(near, axis=1)
                        score = np.clip(near[np.arange(len(best)), best].astype(float), 0, 1)
                        names = np.array(model.languages, dtype=object)[best]
                        low = score < model.floors[best, _sizes(batch.column(text))]
                    else:
                        letters = np.zeros(batch.num_rows, bool)
                        score, names = np.zeros(batch.num_rows), np.full(batch.num_rows, UNKNOWN, object)
                        low = ~letters
                    names = np.where(letters, names, UNKNOWN)
                    score = np.where(letters, score, 0.0)
                    arrays = [batch.column(p) for p in places]
                    arrays += [pa.array(names, pa.string()), pa.array(score), pa.array(~letters | low)]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "lang_pred", "score", "rejected"])

        return inner.mapInArrow(run, schema)


def fit(
    training: DataFrame, *, per_language: int = 4, sample_rows: int = 4000, reject_below: float = 0.1
) -> CentroidModel:
    """Learn from the columns text and lang of ``training``.

    ``sample_rows`` bounds the rows that the k-means of all languages together gets, in a task for each
    language, about ``sample_rows * 16`` KB; a language's share is chosen by the hash of the text.
    """
    rows = training.where(F.col("lang").isNotNull() & has_letter(F.col("text"))).select("text", "lang")

    def documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(BUCKETS, np.int64), 0
        for small in small_batches(batches):
            for at in range(0, small.num_rows, _ROWS):
                batch = small.slice(at, _ROWS)
                found += (_vectors(batch.column("text"), None) > 0).sum(axis=0)
                n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(-1, BUCKETS)), pa.array(np.concatenate([[n], found]))], names=["bucket", "n"]
            )

    # One row for each bucket, and the number of rows under -1.
    with_bucket = dict(
        rows.select("text").mapInArrow(documents_with, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()
    )
    total = with_bucket.get(-1, 0)
    idf = np.log((1 + total) / (1 + np.array([with_bucket.get(b, 0) for b in range(BUCKETS)]))) + 1
    idf = idf.astype(np.float32)
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return CentroidModel([], np.zeros((0, BUCKETS), np.float32), idf, np.zeros((0, SIZES)))
    share = max(1, sample_rows // len(sizes))
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    wanted = F.lit(False)
    for lang, n in sizes.items():
        wanted = wanted | ((F.col("lang") == lang) & (place < int(min(1.0, 1.2 * share / n + 20 / n) * (1 << 30))))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for small in small_batches(batches):
            for at in range(0, small.num_rows, _ROWS):
                batch = small.slice(at, _ROWS)
                v = _vectors(batch.column("text"), idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("lang"), batch.column("place"), pa.array(_sizes(batch.column("text")), pa.int32()),
                        pa.array([x.tobytes() for x in v], pa.binary()),
                    ],
                    names=["lang", "place", "size", "vector"],
                )

    def centres_of(group: pa.Table) -> pa.Table:
        """The centroids of a language, and the best cosine and the size of each of its rows."""
        keys = list(zip(group["place"].to_pylist(), group["vector"].to_pylist(), strict=True))
        first = sorted(range(len(keys)), key=keys.__getitem__)[:share]
        unit = np.stack([np.frombuffer(keys[i][1], np.float16) for i in first]).astype(np.float32)
        centres = _k_means(unit, per_language)
        reached, size = (unit @ centres.T).max(axis=1), group["size"].to_numpy()[first].astype(np.int32)
        columns = [group["lang"][:1].combine_chunks(), *[pa.array([x.tobytes()], pa.binary()) for x in (centres, reached, size)]]
        return pa.table(columns, names=["lang", "centres", "reached", "size"])

    # The driver gets a row for each language, without the vectors.
    learned = (
        rows.where(wanted).select("text", "lang", place.alias("place"))
        .mapInArrow(vectors, "lang string, place long, size int, vector binary")
        .groupBy("lang").applyInArrow(centres_of, "lang string, centres binary, reached binary, size binary").collect()
    )
    languages, centroids, reached = [], [], []
    for r in sorted(learned, key=lambda r: r["lang"]):
        centres = np.frombuffer(r["centres"], np.float32).reshape(-1, BUCKETS)
        languages += [r["lang"]] * len(centres)
        centroids.append(centres)
        reached += [(np.frombuffer(r["reached"], np.float32), np.frombuffer(r["size"], np.int32))] * len(centres)
    of_all = _floors(*(np.concatenate(x) for x in zip(*reached)), np.full(SIZES, reject_below))
    floors = [_floors(scores, sizes, of_all) for scores, sizes in reached]
    return CentroidModel(languages, np.concatenate(centroids).astype(np.float32), idf, np.stack(floors))


def crc_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents that are not held out."""
    return docs.where(F.coalesce(crc_remainder(F.col("doc_id"), 4) != 2, F.lit(True)))
