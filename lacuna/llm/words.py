"""Words of whole texts as 64-bit hashes, computed on the bytes of an Arrow column.

A word is ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. Both rules touch ASCII
only, so they can be applied to UTF-8 bytes. The hash of a word is a sum of
random numbers by byte, each times an odd random number by its place, mixed at
the end: equal words have equal hashes in every process, and two given words
collide with a probability of about 2^-63.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_PLACES = 1 << 16
BLOCK_BYTES = 1 << 19
"""Bytes handled at once, which bounds the memory whatever the length of a text."""


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n repeatable random 64-bit numbers."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix(steps + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03))


def _byte_numbers() -> np.ndarray:
    numbers = stream(1, 256)
    for a in range(ord("A"), ord("Z") + 1):
        numbers[a] = numbers[a + 32]
    numbers[list(SPACES)] = 0
    return numbers


_BYTE = _byte_numbers()
_PLACE = stream(2, _PLACES) | np.uint64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True


def _block(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words in ``data``; a word also ends at each of ``cuts``."""
    space = _IS_SPACE[data]
    first = ~space
    after = np.empty(len(data), dtype=bool)
    after[0] = True
    after[1:] = space[:-1]
    after[cuts] = True
    first &= after
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    begin = starts[0]
    lengths = np.diff(starts, append=len(data))
    place = np.arange(len(data) - begin, dtype=np.int32) - np.repeat((starts - begin).astype(np.int32), lengths)
    np.bitwise_and(place, _PLACES - 1, out=place)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_BYTE[data[begin:]] * _PLACE[place], starts - begin)
    return mix(sums), starts


def hash_bytes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of concatenated texts, and how many words lie before each text's end."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        stop = min(len(data), at + BLOCK_BYTES)
        while stop < len(data):  # not within a word
            rest = np.flatnonzero(_IS_SPACE[data[stop : stop + BLOCK_BYTES]])
            if len(rest):
                stop += int(rest[0])
                break
            stop = min(len(data), stop + BLOCK_BYTES)
        inner = ends[np.searchsorted(ends, at) : np.searchsorted(ends, stop)]
        h, s = _block(data[at:stop], inner - at)
        hashes.append(h)
        starts.append(s + at)
        at = stop
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), ends)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the end of each row; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    if raw is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column), np.int64)
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def hash_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, bounds): row i has the words ``hashes[bounds[i]:bounds[i + 1]]``."""
    data, ends = text_bytes(column)
    hashes, counts = hash_bytes(data, ends)
    return hashes, np.concatenate([[0], counts]).astype(np.int64)


def small_batches(
    batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 * BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have at most ``most`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words by row, in the order of the text, and their bounds.

    A row with fewer than k words has its whole sequence as its one run; one without words has none.
    """
    counts = np.diff(bounds)
    runs = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(runs)]).astype(np.int64)
    row = np.repeat(np.arange(len(counts)), runs)
    first = np.arange(out_bounds[-1]) - out_bounds[row] + bounds[row]
    width = np.minimum(counts[row], k)
    factors = stream(3, k) | np.uint64(1)
    total = mix(width.astype(np.uint64))
    padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
    with np.errstate(over="ignore"):
        for j in range(k):
            total += np.where(width > j, padded[first + j] * factors[j], np.uint64(0))
    return mix(total), out_bounds
