"""Passages that documents share, exactly or nearly, by chains of common seeds.

Seeds are runs of six words, the least by hash of every ``WINDOW`` runs in a row, so any 13 words in common have a seed
in common. Each seed's occurrences are linked to its first, not to each other. Seeds that no span found covers are
then taken in pairs that stand near each other: they are linked to the first document that has such a pair, so
parts of a passage that stand in other documents before, one here and one there, hide nothing. Then equal runs of ``min_words`` words that are
in none of the spans found are linked to the first document with the same run, so no equal passage is missed
because its seeds stand in other documents before. The links of two documents are chained in order:
a link adds its words and pays for the words between it and the one before, and a Fenwick tree over the
places in the other document finds the best one before. Chains are aligned word by word: spread
to both sides over single changed words as long as that gains, then the longest common subsequence of both spans. A chain that is not similar enough
as a whole is taken apart: its longest part between two blocks of equal words that is, then what is left on both sides of it.

Documents with equal words are one class and compared once; of a class all but one are reported as copies of that one.

Result: doc_id, start, end (words, the end excluded), ref_doc_id, ref_start, ref_end, matched (words in common), similarity (twice
matched by the words of both spans). Spans of ``min_words`` or more on both sides, with a similarity of 0.75 or more.
A passage in many documents is reported for all but one of them, each with the first one that has it as ref.

Defined cases: null and empty texts share nothing. Texts under six words are their own only seed. Rows with equal ids
are separate documents. Repeats within one document are not reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.latent import common_subsequence
from lacuna.llm.store import Store
from lacuna.llm.words import hash_words, mix, shingles, small_batches, stream

SEED = 6
WINDOW = 8
GAP_COST = 0.05
DROP = 6.0
"""How far the score of a passage's end may fall, four changed words, before what is behind them is left out."""
FAR = 12
"""A seed makes pairs with those of so many after it that stand first in another document, or elsewhere."""
MOVED = 10
"""Words by which two seeds are nearer to each other, or farther, than where they stand first."""
APART = 60
"""Words between the seeds of a pair at most."""
SALTS = 16
TEXT_BYTES = 4 << 20
"""Bytes of texts that are unpacked and hashed at once."""


def _seeds(runs: np.ndarray) -> np.ndarray:
    """Places of the least run of each window, or of all if they are fewer."""
    if len(runs) <= WINDOW:
        return np.array([int(runs.argmin())]) if len(runs) else np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(runs, WINDOW)
    return np.unique(np.arange(len(windows)) + windows.argmin(axis=1))


def _read(docs: DataFrame) -> DataFrame:
    """(row_no, doc_id, key, n_words, packed, seeds, places)."""
    names = ["row_no", "doc_id", "key", "n_words", "packed", "seeds", "places"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in small_batches(batches):
            hashes, bounds = hash_words(batch.column("text"))
            runs, run_bounds = shingles(hashes, bounds, SEED)
            keys, seeds, places = [], [], []
            for i in range(batch.num_rows):
                words = hashes[bounds[i] : bounds[i + 1]]
                with np.errstate(over="ignore"):
                    order = np.arange(1, len(words) + 1, dtype=np.uint64)
                    sums = [mix(words + order).sum(dtype=np.uint64), mix(words ^ mix(order)).sum(dtype=np.uint64)]
                keys.append(np.array(sums, np.uint64).tobytes())
                own = runs[run_bounds[i] : run_bounds[i + 1]]
                at = _seeds(own)
                seeds.append(own[at].view(np.int64))
                places.append(at.astype(np.int32))
            texts = [packer.compress((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_no"), batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(np.diff(bounds)),
                    pa.array(texts, pa.binary()), pa.array(seeds, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())),
                ],
                names=names,
            )

    schema = "row_no long, doc_id long, key binary, n_words long, packed binary, seeds array<long>, places array<int>"
    return docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "text").mapInArrow(run, schema)


def _together(*columns: list[bytes]) -> Iterator[slice]:
    """Rows whose packed texts have ``TEXT_BYTES`` at most when unpacked, or one row."""
    size = begin = 0
    for i, packed in enumerate(zip(*columns, strict=True)):
        new = sum(zstandard.get_frame_parameters(x).content_size for x in packed)
        if i > begin and size + new > TEXT_BYTES:
            yield slice(begin, i)
            size, begin = 0, i
        size += new
    if columns[0]:
        yield slice(begin, len(columns[0]))


def _words_of(packed: list[bytes], opener: zstandard.ZstdDecompressor) -> list[np.ndarray]:
    """The words of each packed text; equal ones are unpacked once, and all hashed at once."""
    distinct = list(dict.fromkeys(packed))
    words, bounds = hash_words(pa.array([opener.decompress(x) for x in distinct], pa.binary()).cast(pa.string()))
    found = {x: words[bounds[i] : bounds[i + 1]] for i, x in enumerate(distinct)}
    return [found[x] for x in packed]


def linked(places: list[int], ref_places: list[int]) -> list[list[int]]:
    """The links, as numbers in order, of the chains of two links or more.

    Links come in order of their place. A link's score is that of the best link before it in both documents less
    the cost of the words between, plus its own words; if that is less than its own words it begins a chain.
    """
    ranks = {r: n + 1 for n, r in enumerate(sorted(set(ref_places)))}
    # best[n]: the best (score + cost of all words before) of links up to that rank, in the manner of a Fenwick tree.
    best: list[tuple[float, int]] = [(-np.inf, -1)] * (len(ranks) + 1)
    score, before, waiting = [0.0] * len(places), [-1] * len(places), []
    for i, (x, y) in enumerate(zip(places, ref_places, strict=True)):
        if i and places[i - 1] < x:  # links at one place do not follow each other
            for j in waiting:
                value, n = (score[j] + GAP_COST * (places[j] + ref_places[j]), j), ranks[ref_places[j]]
                while n < len(best):
                    best[n] = max(best[n], value)
                    n += n & -n
            waiting = []
        top, n = (-np.inf, -1), ranks[y] - 1
        while n:
            top = max(top, best[n])
            n -= n & -n
        score[i] = SEED
        if top[1] >= 0:
            j = top[1]
            new = min(SEED, x - places[j], y - ref_places[j])
            # Words within seeds cost nothing.
            joined = top[0] - GAP_COST * max(0, x + y - 2 * SEED) + new if x - places[j] >= SEED else score[j] + new
            if joined > SEED:
                score[i], before[i] = joined, j
        waiting.append(i)
    used, found = [False] * len(places), []
    for i in sorted(range(len(places)), key=lambda i: -score[i]):
        at, chain = i, []
        while at >= 0 and not used[at]:
            used[at] = True
            chain.append(at)
            at = before[at]
        if len(chain) > 1:
            found.append(chain[::-1])
    return found


def chains(places: list[int], ref_places: list[int]) -> list[tuple[int, int, int, int]]:
    """(start, end, ref_start, ref_end) of the chains of two links or more, the ends excluded."""
    return [(places[c[0]], places[c[-1]] + SEED, ref_places[c[0]], ref_places[c[-1]] + SEED) for c in linked(places, ref_places)]


def _matched(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; the words that both begin with, and then those they end with, are part of one."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    first = int(other[0]) if len(other) else n
    a, b = a[first:], b[first:]
    n -= first
    if not n:
        return first
    other = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
    last = n - 1 - int(other[-1]) if len(other) else n
    return first + last + common_subsequence(a[: len(a) - last].tolist(), b[: len(b) - last].tolist())


def _may_hold_a_run(places: np.ndarray, left: np.ndarray, windows: int) -> bool:
    """Whether as many windows in a row can have their least run, a seed, among the places left."""
    out = np.flatnonzero(~np.isin(places, left))
    first, last = np.append(0, out + 1), np.append(out, len(places)) - 1
    some = first <= last
    # A seed is the least of windows that hold it: from WINDOW - 1 before it on, up to its own place.
    return bool((places[last[some]] - places[first[some]] + WINDOW >= windows).any())


def _reach(a: np.ndarray, b: np.ndarray, similar: float) -> int:
    """How many words of both from the first on are worth adding, word against word."""
    best, at, size, n = 0.0, 0, 0.0, 0
    while n < len(a) and n < len(b) and size > best - DROP:
        k = min(len(a), len(b), n + 64)
        for same in (a[n:k] == b[n:k]).tolist():
            n += 1
            size += 2 * (same - similar)
            if size > best:
                best, at = size, n
            elif size <= best - DROP:
                break
    return at


def _blocks(places: list[int], ref_places: list[int], a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, ref_start, words) of a chain's runs of equal words, as long as they are, in order and apart."""
    blocks: list[tuple[int, int, int]] = []
    for x, y in zip(places, ref_places, strict=True):
        floor, ref_floor = (blocks[-1][0] + blocks[-1][2], blocks[-1][1] + blocks[-1][2]) if blocks else (0, 0)
        end, ref_end = min(x + SEED, len(a)), min(y + SEED, len(b))
        # A link within the block before is part of it, or shifted against it and of no more use.
        shift = max(floor - x, ref_floor - y, 0)
        x, y = x + shift, y + shift
        if x >= end or y >= ref_end:
            continue
        while x > floor and y > ref_floor and a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
        n = min(end - x, ref_end - y)
        while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
            n += 1
        if blocks and x == floor and y == ref_floor:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + n)
        else:
            blocks.append((x, y, n))
    return blocks


def similar_parts(blocks: list[tuple[int, int, int]], a: np.ndarray, b: np.ndarray, min_words: int, similar: float) -> list[tuple[int, int]]:
    """(first, last) of the parts of a chain's blocks that are similar enough: the longest, then those on both sides of it.

    A part is similar if twice its matched words less ``similar`` times the words of both sides is not negative. That
    adds up over blocks and the words between them, so the longest such part lies between two prefix sums.
    """
    begin, end, size = [], [], 0.0
    for i, (x, y, n) in enumerate(blocks):
        if i:
            px, py = blocks[i - 1][0] + blocks[i - 1][2], blocks[i - 1][1] + blocks[i - 1][2]
            matched = _matched(a[px:x], b[py:y]) if x > px and y > py else 0
            size += 2 * matched - similar * (x - px + y - py)
        begin.append(size)
        size += 2 * n * (1 - similar)
        end.append(size)
    found, open_ = [], [(0, len(blocks))]
    while open_:
        lo, hi = open_.pop()
        # Only a begin below all before it can begin the longest part, only an end above all after it can end it.
        lows: list[int] = []
        for i in range(lo, hi):
            if not lows or begin[i] < begin[lows[-1]]:
                lows.append(i)
        best, top, j = (0, -1, -1), -np.inf, hi - 1
        while j >= lo and lows:
            if end[j] > top:
                top = end[j]
                # The lows fall: whichever this end reaches from the first on, no earlier end need look at again.
                while lows and begin[lows[-1]] <= end[j] + 1e-9:
                    i = lows.pop()
                    if i <= j:
                        words = sum(blocks[j][k] + blocks[j][2] - blocks[i][k] for k in (0, 1))
                        best = max(best, (words, i, j))
            j -= 1
        words, i, j = best
        if words < 2 * min_words:
            continue
        found.append((i, j))
        open_ += [(lo, i), (j + 1, hi)]
    return found


def _chained(matches: DataFrame) -> DataFrame:
    """(row_no, ref, places, ref_places) of the chains of all pairs of documents."""
    names = ["row_no", "ref", "places", "ref_places"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close(part: pa.Table) -> pa.RecordBatch:
            doc, ref = part["row_no"].to_numpy(), part["ref"].to_numpy()
            place, ref_place = part["place"].to_pylist(), part["ref_place"].to_pylist()
            edges = np.flatnonzero((np.diff(doc) != 0) | (np.diff(ref) != 0)) + 1
            rows = []
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(doc)], strict=True):
                if e - s > 1:
                    for c in linked(place[s:e], ref_place[s:e]):
                        if place[s + c[-1]] > place[s + c[0]]:
                            rows.append((doc[s], ref[s], [place[s + i] for i in c], [ref_place[s + i] for i in c]))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*held, batch])
            doc, ref = whole["row_no"].to_numpy(), whole["ref"].to_numpy()
            other = np.flatnonzero((doc != doc[-1]) | (ref != ref[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield close(whole.slice(0, cut))
            held = whole.slice(cut).to_batches()
        if held:
            yield close(pa.Table.from_batches(held))

    dealt = matches.repartition("row_no", "ref").sortWithinPartitions("row_no", "ref", "place", "ref_place")
    return dealt.mapInArrow(run, "row_no long, ref long, places array<int>, ref_places array<int>")


def _left(seeds: DataFrame, rows: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """Those of ``seeds`` (row_no, seed, place, ...) whose runs of ``min_words`` words do not all lie in one span of their document."""
    spans = found.groupBy("row_no").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = rows.join(spans, "row_no").select("row_no", "n_words", "spans")
    return seeds.join(spans, "row_no", "left").where(
        "spans is null or not exists(spans, s -> s.start <= greatest(0, place - {0}) and s.end >= least(n_words, place + {1}))"
        .format(min_words - SEED, min_words)
    ).select(*seeds.columns)


def _of_two(seeds: DataFrame) -> DataFrame:
    """Those of ``seeds`` that two documents or more have."""
    dealt = seeds.repartition("seed")
    common = dealt.groupBy("seed").agg(F.min("row_no").alias("a"), F.max("row_no").alias("b")).where("a < b").select("seed")
    return dealt.join(common, "seed")


def _beyond(live: DataFrame) -> DataFrame:
    """(row_no, ref, place, ref_place): seeds that are left, linked to the first document that has them near others as here.

    Of two seeds that stand first in one document, as far from each other as here, the links were chained before.
    """
    after = Window.partitionBy("row_no").orderBy("place", "seed").rowsBetween(1, FAR)
    others = F.collect_list(F.struct("seed", "place", "ref", "ref_place")).over(after)
    paired = live.withColumn("others", others).withColumn("other", F.explode("others"))
    apart = F.col("other.place") - F.col("place")
    moved = F.abs(F.col("other.ref_place") - F.col("ref_place") - apart) > MOVED
    # Rows are narrow here: seeds are looked up again by their places.
    paired = paired.where(((F.col("ref") != F.col("other.ref")) | moved) & (apart <= SEED + APART)).select(
        F.xxhash64("seed", "other.seed").alias("key"), "row_no", "place", F.col("other.place").alias("other_place")
    )
    # A line that a document repeats counts once.
    once = paired.groupBy("row_no", "key").agg(F.min("place").alias("place"), F.min("other_place").alias("other_place"))
    dealt = once.repartition("key")
    heads = dealt.groupBy("key").agg(F.min("row_no").alias("head"), F.max("row_no").alias("last")).where("last > head")
    linked = dealt.join(heads.select("key", "head"), "key").where("row_no <> head")
    linked = linked.select("row_no", "head", F.explode(F.array("place", "other_place")).alias("place"))
    linked = linked.join(live.select("row_no", "place", "seed"), ["row_no", "place"])
    linked = linked.groupBy("row_no", "seed").agg(F.min("head").alias("ref"))
    linked = linked.join(live.select("row_no", "seed", "place"), ["row_no", "seed"])
    places = live.groupBy(F.col("row_no").alias("ref"), "seed").agg(F.min("place").alias("ref_place"))
    return linked.join(places, ["ref", "seed"]).select("row_no", "ref", "place", "ref_place")


def _exact(rows: DataFrame, live: DataFrame, min_words: int, store: Store) -> DataFrame:
    """(row_no, ref, places, ref_places) of equal runs of ``min_words`` words that no span found holds whole.

    A run's seeds are those of the windows within it, whatever stands around it. Of ``live``, seeds that are left, those that
    fewer than two documents have are of no use. Runs with all their seeds left are
    compared whole, so each is linked to the first document that has it.
    """
    left = _of_two(live).groupBy("row_no").agg(F.collect_list("place").alias("left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        within = min_words - SEED - WINDOW + 2  # windows of seeds in a run
        factors = stream(5, min_words) | np.uint64(1)

        def texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            """(row_no, words, places left) of the rows that may hold a run."""
            left = [x.values.to_numpy() for x in batch.column("left")]
            places = [x.values.to_numpy() for x in batch.column("places")]
            mine = [i for i in range(batch.num_rows) if within <= 0 or _may_hold_a_run(places[i], left[i], within)]
            chosen = batch.select(["row_no", "packed"]).take(pa.array(mine, pa.int64()))
            rows, packed = chosen.column(0).to_pylist(), chosen.column(1).to_pylist()
            for s in _together(packed):
                yield from zip(rows[s], _words_of(packed[s], opener), [left[i] for i in mine[s]], strict=True)

        for batch in batches:
            for row, words, left in texts(batch):
                starts = np.arange(max(0, len(words) - min_words + 1))
                if within > 0 and len(starts):
                    runs = shingles(words, np.array([0, len(words)]), SEED)[0]
                    windows = np.lib.stride_tricks.sliding_window_view(runs, WINDOW)
                    least = np.arange(len(windows)) + windows.argmin(axis=1)
                    other = np.cumsum(np.concatenate([[0], ~np.isin(least, left)]))
                    starts = starts[other[starts + within] == other[starts]]
                for at in range(0, len(starts), 50_000):
                    part = starts[at : at + 50_000]
                    sums = np.zeros(len(part), np.uint64)
                    with np.errstate(over="ignore"):
                        for j in range(min_words):
                            sums += words[part + j] * factors[j]
                    key = mix(sums)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), row)), pa.array(part), pa.array(key.view(np.int64))],
                        names=["row_no", "place", "key"],
                    )

    keys = rows.select("row_no", "packed", "places").join(left, "row_no").mapInArrow(run, "row_no long, place long, key long")
    keys = store.keep(keys, "runs")
    store.drop("still")
    heads = (
        keys.groupBy("key").agg(F.min(F.struct("row_no", "place")).alias("head"), F.max("row_no").alias("last"))
        .where("last > head.row_no").select("key", F.col("head.row_no").alias("ref"), F.col("head.place").alias("ref_place"))
    )
    links = keys.join(heads, "key").where("row_no <> ref").withColumn("shift", F.col("place") - F.col("ref_place"))
    by = Window.partitionBy("row_no", "ref", "shift").orderBy("place")
    stretch = links.withColumn("stretch", F.col("place") - F.row_number().over(by)).groupBy("row_no", "ref", "shift", "stretch")
    ends = stretch.agg(F.min("place").alias("s"), (F.max("place") + min_words - SEED).alias("e"))
    return ends.select(
        "row_no", "ref", F.array(F.col("s").cast("int"), F.col("e").cast("int")).alias("places"),
        F.array((F.col("s") - F.col("shift")).cast("int"), (F.col("e") - F.col("shift")).cast("int")).alias("ref_places"),
    )


def _aligned(pairs: DataFrame, min_words: int, similar: float) -> DataFrame:
    names = ["row_no", "doc_id", "start", "end", "ref_doc_id", "ref_start", "ref_end", "matched", "similarity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()

        def pairs_of(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
            packed, ref_packed = batch.column("packed").to_pylist(), batch.column("ref_packed").to_pylist()
            rest = batch.select([c for c in batch.schema.names if c not in ("packed", "ref_packed")])
            for s in _together(packed, ref_packed):
                n = s.stop - s.start
                words = _words_of(packed[s] + ref_packed[s], opener)
                yield from zip(rest.slice(s.start, n).to_pylist(), words[:n], words[n:], strict=True)

        for batch in batches:
            rows = []
            for r, a, b in pairs_of(batch):
                x, y = r["places"], r["ref_places"]
                s, e, rs, re = x[0], min(x[-1] + SEED, len(a)), y[0], min(y[-1] + SEED, len(b))
                n = _reach(a[:s][::-1], b[:rs][::-1], similar)
                s, rs = s - n, rs - n
                n = _reach(a[e:], b[re:], similar)
                e, re = e + n, re + n
                spans = [(s, e, rs, re)] if min(e - s, re - rs) >= min_words else []
                whole = True
                while spans:
                    s, e, rs, re = spans.pop()
                    matched = _matched(a[s:e], b[rs:re])
                    if (share := 2 * matched / (e - s + re - rs)) >= similar:
                        rows.append((r["row_no"], r["doc_id"], s, e, r["ref_doc_id"], rs, re, matched, share))
                    elif whole:
                        blocks = _blocks(x, y, a, b)
                        for i, j in similar_parts(blocks, a, b, min_words, similar):
                            (s, rs, _), (e, re, n) = blocks[i], blocks[j]
                            if min(e + n - s, re + n - rs) >= min_words:
                                spans.append((s, e + n, rs, re + n))
                    whole = False
            if rows:
                kinds = [pa.int64()] * 8 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return pairs.mapInArrow(run, ", ".join(f"`{n}` {'double' if n == 'similarity' else 'long'}" for n in names))


def shared_passages(docs: DataFrame, store: Store, *, min_words: int = 50, similar: float = 0.75) -> DataFrame:
    """Passages of ``docs`` (doc_id, text) that an earlier document has too; see above for the columns."""
    rows = store.keep(_read(docs), "rows")
    first = F.min(F.struct("doc_id", "row_no")).alias("first")
    classes = rows.groupBy("key").agg(first, F.count("*").alias("n")).select("key", "first.*", "n")
    classes = store.keep(classes.withColumnsRenamed({"doc_id": "ref_doc_id", "row_no": "ref"}), "classes")
    reps = rows.join(classes.select(F.col("ref").alias("row_no")), "row_no", "left_semi")
    seeds = reps.select("row_no", F.explode(F.arrays_zip("seeds", "places")).alias("s"))
    seeds = store.keep(seeds.select("row_no", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place")), "seeds")
    # Dealt once, for the first of each seed and for the links to it.
    dealt = seeds.repartition("seed")
    heads = (
        dealt.groupBy("seed").agg(F.min(F.struct("row_no", "place")).alias("head"), F.max("row_no").alias("last"))
        .where("last > head.row_no").select("seed", F.col("head.row_no").alias("ref"), F.col("head.place").alias("ref_place"))
    )
    shared = store.keep(dealt.join(heads, "seed"), "shared")
    store.drop("seeds")
    matches = shared.where("row_no <> ref").select("row_no", "ref", "place", "ref_place")
    found = store.keep(_chained(matches), "chains")
    texts = rows.select("row_no", "doc_id", "packed")
    refs = rows.select(F.col("row_no").alias("ref"), F.col("doc_id").alias("ref_doc_id"), F.col("packed").alias("ref_packed"))
    near = store.keep(_aligned(found.join(texts, "row_no").join(refs, "ref"), min_words, similar), "near")
    store.drop("chains")
    if min_words >= SEED:
        live = _left(shared.select("row_no", "seed", "place", "ref", "ref_place"), reps, near, min_words)
        live = store.keep(live, "left")
        store.drop("shared")
        live = store.keep(_of_two(live), "live")
        store.drop("left")
        found = store.keep(_chained(_beyond(live)), "chains-beyond")
        beyond = store.keep(_aligned(found.join(texts, "row_no").join(refs, "ref"), min_words, similar), "beyond")
        still = store.keep(_left(live.select("row_no", "seed", "place"), reps, beyond, min_words), "still")
        store.drop("live")
        store.drop("chains-beyond")
        near = near.unionByName(beyond)
        rest = _exact(reps, still, min_words, store)
        # Kept, as texts come to Python in batches of bounded bytes then.
        near = near.unionByName(store.keep(_aligned(rest.join(texts, "row_no").join(refs, "ref"), min_words, similar), "equal"))

    # A class may hold a third of all rows: each row looks in one of several copies of it.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    many = classes.where("n > 1").select("key", "ref", "ref_doc_id", salts)
    salt = F.pmod(F.xxhash64("row_no"), F.lit(SALTS)).cast("int").alias("salt")
    copies = (
        rows.where(F.col("n_words") >= max(1, min_words)).select("row_no", "doc_id", "key", "n_words", salt)
        .join(many, ["key", "salt"]).where("row_no <> ref")
    )
    zero, n = F.lit(0).cast("long"), F.col("n_words")
    whole = copies.select(
        "doc_id", zero.alias("start"), n.alias("end"), "ref_doc_id", zero.alias("ref_start"), n.alias("ref_end"),
        n.alias("matched"), F.lit(1.0).alias("similarity"),
    )
    return near.distinct().drop("row_no").unionByName(whole)
