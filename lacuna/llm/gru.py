"""A gated recurrent language model with a class-factored softmax, in numpy.

Word ids are ranks: 0 for the most frequent. Word i is in class i // CLASS at place i % CLASS; id ``words``
stands for every other word, which is a class of its own. The input of a step is the word before, the
start of a text has id ``words + 1``. With all weights at zero but the biases the model is the unigram model.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

CLASS = 64
HIDDEN = 24
WINDOW = 1 << 14
"""Words that a window of scoring takes, about."""
Parameters = dict[str, np.ndarray]


def initial(counts: np.ndarray, others: float) -> Parameters:
    """Parameters for words with these counts (in rank order) and a count of all other words."""
    classes = -(-len(counts) // CLASS)
    rng = np.random.default_rng(5)
    padded = np.zeros(classes * CLASS)
    padded[: len(counts)] = counts + 0.1
    by_class = padded.reshape(classes, CLASS)
    with np.errstate(divide="ignore"):
        place = np.log(by_class / np.maximum(by_class.sum(1, keepdims=True), 1e-30))
    weight = np.append(by_class.sum(1), others + 0.1)

    def small(*shape: int) -> np.ndarray:
        return rng.standard_normal(shape).astype(np.float32) / np.float32(np.sqrt(HIDDEN))

    return {
        "embedding": small(len(counts) + 2, HIDDEN),
        "input": small(HIDDEN, 3 * HIDDEN),
        "bias": np.zeros(3 * HIDDEN, np.float32),
        "gates": small(HIDDEN, 2 * HIDDEN),
        "candidate": small(HIDDEN, HIDDEN),
        "class": np.zeros((HIDDEN, classes + 1), np.float32),
        "class_bias": np.log(weight / weight.sum()).astype(np.float32),
        "word": np.zeros((classes, HIDDEN, CLASS), np.float32),
        # Places without a word have no probability.
        "word_bias": np.maximum(place, -1e9).astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


SAFE = 60.0
"""Logits up to this size, either sign, have exponentials whose sums a float holds."""


def _bounded(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Whether no hidden state, all of which lie in -1 to 1, makes the greatest logit leave -SAFE to SAFE; by class."""
    sizes = np.abs(weights).sum(axis=-2)
    return ((sizes + bias).max(axis=-1) < SAFE) & ((bias - sizes).max(axis=-1) > -SAFE)


STRIP = 512
"""Words whose logits are handled at once, so that they stay in a core's cache."""


def _strips(n: int) -> Iterator[slice]:
    return (slice(at, min(n, at + STRIP)) for at in range(0, n, STRIP))


def _exponentials(x: np.ndarray, chosen: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log softmax at one place of each row, sums, where those places are in all of ``x``); leaves the exponentials, whose sums these are, in ``x``."""
    if not bounded:
        x -= x.max(axis=1, keepdims=True)
    at = np.arange(0, x.size, x.shape[1]) + chosen
    own = x.reshape(-1).take(at)
    sums = np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype)
    return own - np.log(sums), sums, at


def _with_one(h: np.ndarray) -> np.ndarray:
    """``h`` with a column of ones, which takes the bias into a product."""
    out = np.ones((len(h), HIDDEN + 1), h.dtype)
    out[:, :HIDDEN] = h
    return out


Piece = list[tuple[int, int, int, int]]


def _pieces(cuts: list[tuple[int, int, int]]) -> Iterator[tuple[slice, Piece]]:
    """Strips of the rows that are in the order of their classes, with (number of the cut, class, start, end) of the classes in each."""
    held: Piece = []
    at = begin = 0
    for i, (c, s, e) in enumerate(cuts):
        while s < e:
            at = min(e, begin + STRIP)
            held.append((i, c, s, at))
            s = at
            if at == begin + STRIP:
                yield slice(begin, at), held
                held, begin = [], at
    if held:
        yield slice(begin, at), held


def _word_logits(weights: np.ndarray, bounded: list[bool], own: np.ndarray, begin: int, piece: Piece) -> np.ndarray:
    """Logits of the words of each row's class, for the rows of a piece that begins there; those that have no bound are shifted."""
    logits = np.empty((piece[-1][3] - begin, CLASS), own.dtype)
    for _, c, s, e in piece:
        x = np.matmul(own[s:e], weights[c], out=logits[s - begin : e - begin])
        if not bounded[c]:
            x -= x.max(axis=1, keepdims=True)
    return logits


def _gates(p: Parameters) -> np.ndarray:
    """The matrices of the two gates, one after the other."""
    return np.ascontiguousarray(p["gates"].reshape(HIDDEN, 2, HIDDEN).transpose(1, 0, 2))


def _thirds(table: np.ndarray) -> list[np.ndarray]:
    """The columns for the reset gate, the update gate and the candidate."""
    return [np.ascontiguousarray(x) for x in np.split(table, 3, axis=1)]


def states(p: Parameters, table: np.ndarray | list[np.ndarray], before: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool):
    """Hidden states over a window. before: (steps, lanes) rows of ``table``; fresh: where a text begins; h: the state carried in.

    ``table`` is ``embedding @ input + bias``, or the ``_thirds`` of it. With ``keep`` also what the way back needs: the state before
    each step, both gates and the candidate.
    """
    steps, lanes = before.shape
    out = np.empty((steps, lanes, HIDDEN), np.float32)
    begins = fresh.any(axis=1).tolist()
    reset, update, inputs = (x.take(before, axis=0) for x in (_thirds(table) if isinstance(table, np.ndarray) else table))
    recurrent, candidate = _gates(p), p["candidate"]
    prior = np.empty_like(out) if keep else None
    gates = np.empty((steps if keep else 1, 2, lanes, HIDDEN), np.float32)
    both = np.empty((lanes, HIDDEN), np.float32)
    for t in range(steps):
        if begins[t]:
            h = np.where(fresh[t][:, None], np.float32(0), h)
        rz = gates[t if keep else 0]
        np.matmul(h, recurrent, out=rz)
        rz[0] += reset[t]
        rz[1] += update[t]
        r, z = _sigmoid(rz)
        np.multiply(r, h, out=both)
        n = inputs[t]
        n += both @ candidate
        np.tanh(n, out=n)
        if keep:
            prior[t] = h
        h = np.subtract(h, n, out=out[t])
        h *= z
        h += n
    return out, h, (prior, gates, inputs)


def _by_class(classes: np.ndarray, last: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(places in the order of their classes, (class, start, end) of each class in it), other words aside."""
    order = np.argsort(classes.astype(np.uint16) if last < 1 << 16 else classes, kind="stable")
    own = classes[order]
    n = int(np.searchsorted(own, last))
    order, own = order[:n], own[:n]
    cuts = np.flatnonzero(np.diff(own, prepend=-1)).tolist()
    return order, [(int(own[s]), s, e) for s, e in zip(cuts, [*cuts[1:], n] if cuts else [], strict=True)]


def log_probabilities(p: Parameters, h: np.ndarray, target: np.ndarray, words: int) -> np.ndarray:
    """Natural log of the probability of each target, for other words of their class."""
    last = p["class_bias"].shape[0] - 1
    classes = np.where(target < words, target // CLASS, last)
    h, weights, bounded = _with_one(h), np.vstack([p["class"], p["class_bias"]]), _bounded(p["class"], p["class_bias"])
    out = np.empty(len(h))
    for s in _strips(len(h)):
        out[s] = _exponentials(h[s] @ weights, classes[s], bounded)[0]
    order, cuts = _by_class(classes, last)
    place, found = target.take(order) % CLASS, np.empty(len(order))
    own, weights = h.take(order, axis=0), np.concatenate([p["word"], p["word_bias"][:, None]], axis=1)
    bounded = _bounded(p["word"], p["word_bias"]).tolist()
    for s, piece in _pieces(cuts):
        found[s] = _exponentials(_word_logits(weights, bounded, own, s.start, piece), place[s], True)[0]
    out[order] += found
    return out


def touched(p: Parameters, before, target, fresh, used, h0, words: int):
    """(mean loss, gradients, rows, last state) of a window; the past before it counts as fixed. ``used`` masks padding.

    A parameter in ``rows`` has gradients for those of its rows only; those of all others are 0.
    """
    ids = before.reshape(-1)
    by_id = np.argsort(ids.astype(np.uint16) if len(p["embedding"]) <= 1 << 16 else ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[by_id], prepend=-1))
    seen = ids[by_id[first]]
    place = np.empty(len(p["embedding"]), np.int32)
    place[seen] = np.arange(len(seen))
    vectors = p["embedding"][seen]
    hidden, last_state, trace = states(p, _thirds(vectors @ p["input"] + p["bias"]), place[before], fresh, h0, True)
    prior, gates, cand = trace
    steps, lanes = before.shape
    h, goal, mask = hidden.reshape(-1, HIDDEN), target.reshape(-1), used.reshape(-1)
    goal = np.where(mask, goal, words)
    n = max(1, int(mask.sum()))
    scale = (mask / n).astype(np.float32)
    g, rows = {}, {"embedding": seen}

    last = p["class_bias"].shape[0] - 1
    classes = np.where(goal < words, goal // CLASS, last)
    h, dh = _with_one(h), np.empty_like(h)
    weights, bounded = np.vstack([p["class"], p["class_bias"]]), _bounded(p["class"], p["class_bias"])
    loss, sums_of_class, back_of_class = 0.0, np.zeros_like(weights), p["class"].T
    for s in _strips(len(h)):
        d = h[s] @ weights
        logs, sums, at = _exponentials(d, classes[s], bounded)
        loss -= (logs * scale[s]).sum()
        d *= (scale[s] / sums)[:, None]
        d.reshape(-1)[at] -= scale[s]
        sums_of_class += h[s].T @ d
        np.matmul(d, back_of_class, out=dh[s])
    g["class"], g["class_bias"] = sums_of_class[:HIDDEN], sums_of_class[HIDDEN]
    order, cuts = _by_class(classes, last)
    own, places, scales = h.take(order, axis=0), goal.take(order) % CLASS, scale.take(order)
    rows["word"] = rows["word_bias"] = np.array([c for c, _, _ in cuts], np.int64)
    weights, bounded = np.concatenate([p["word"], p["word_bias"][:, None]], axis=1), _bounded(p["word"], p["word_bias"]).tolist()
    back = np.empty((len(order), HIDDEN), dh.dtype)
    sums_of_word = np.zeros((len(cuts), HIDDEN + 1, CLASS), weights.dtype)
    for strip, piece in _pieces(cuts):
        d = _word_logits(weights, bounded, own, strip.start, piece)
        logs, sums, at = _exponentials(d, places[strip], True)
        loss -= (logs * scales[strip]).sum()
        d *= (scales[strip] / sums)[:, None]
        d.reshape(-1)[at] -= scales[strip]
        for i, c, s, e in piece:
            mine = d[s - strip.start : e - strip.start]
            sums_of_word[i] += own[s:e].T @ mine
            np.matmul(mine, p["word"][c].T, out=back[s:e])
    g["word"], g["word_bias"] = np.ascontiguousarray(sums_of_word[:, :HIDDEN]), sums_of_word[:, HIDDEN].copy()
    back += dh.take(order, axis=0)
    dh[order] = back

    dh = dh.reshape(steps, lanes, HIDDEN)
    recurrent, candidate = _gates(p).transpose(0, 2, 1).copy(), p["candidate"].T.copy()
    carry = np.zeros((lanes, HIDDEN), dh.dtype)
    dx = np.empty((3, steps, lanes, HIDDEN), dh.dtype)
    begins = fresh.any(axis=1).tolist()
    for t in range(steps - 1, -1, -1):
        d, (r, z), c, before_it = dh[t], gates[t], cand[t], prior[t]
        d += carry
        kept = 1 - z
        to_update = before_it - c
        to_update *= z
        to_update *= kept
        to_candidate = c * c
        np.subtract(1, to_candidate, out=to_candidate)
        to_candidate *= kept
        drh = np.multiply(d, to_candidate, out=dx[2, t]) @ candidate
        to_reset = 1 - r
        to_reset *= r
        to_reset *= before_it
        np.multiply(drh, to_reset, out=dx[0, t])
        np.multiply(d, to_update, out=dx[1, t])
        d *= z
        drh *= r
        d += drh
        d += dx[0, t] @ recurrent[0]
        d += dx[1, t] @ recurrent[1]
        carry = d
        if begins[t]:
            carry[fresh[t]] = 0
    flat = prior.reshape(-1, HIDDEN)
    dr, dz, dn = dx.reshape(3, -1, HIDDEN)
    g["candidate"] = (gates[:, 0] * prior).reshape(-1, HIDDEN).T @ dn
    g["gates"] = np.concatenate([flat.T @ dr, flat.T @ dz], axis=1)
    sums = np.concatenate([np.add.reduceat(x.take(by_id, axis=0), first, axis=0) for x in (dr, dz, dn)], axis=1)
    g["bias"] = sums.sum(0)
    g["input"] = vectors.T @ sums
    g["embedding"] = sums @ p["input"].T
    return float(loss), g, rows, last_state


def gradients(p: Parameters, before, target, fresh, used, h0, words: int):
    """(mean loss, gradients, last state) as of ``touched``, with all rows."""
    loss, g, rows, last_state = touched(p, before, target, fresh, used, h0, words)
    for k, at in rows.items():
        whole = np.zeros_like(p[k])
        whole[at] = g[k]
        g[k] = whole
    return loss, g, last_state


class Trainer:
    """Truncated backpropagation through time over lanes of concatenated texts, with Adagrad steps.

    A pass takes as many lanes, up to ``lanes``, as leave it ``updates`` windows: wide ones cost less a word,
    and few texts still make many steps.
    """

    def __init__(self, p: Parameters, words: int, *, lanes: int = 256, steps: int = 32, updates: int = 96, rate: float = 0.4):
        self.p = {k: v.copy() for k, v in p.items()}
        self.words, self.lanes, self.steps, self.updates, self.rate = words, lanes, steps, updates, np.float32(rate)
        self.squares = {k: np.full_like(v, 1e-4) for k, v in p.items()}

    def _step(self, g: Parameters, rows: dict[str, np.ndarray]) -> None:
        norm = np.sqrt(sum(float(np.vdot(x, x)) for x in g.values()))
        clip = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        for k, x in g.items():
            x *= clip
            at = rows.get(k, slice(None))
            squares = self.squares[k][at] + x * x
            self.squares[k][at] = squares
            x *= self.rate
            x /= np.sqrt(squares)
            self.p[k][at] -= x

    def learn(self, texts: list[np.ndarray]) -> float:
        """One pass over the texts; returns the mean loss."""
        goal = np.concatenate(texts)
        begins = np.zeros(len(goal), bool)
        begins[np.cumsum([0, *[len(t) for t in texts[:-1]]])] = True
        before = np.where(begins, np.int32(self.words + 1), np.concatenate([[np.int32(0)], goal[:-1]]))
        lanes = max(min(16, self.lanes), min(self.lanes, len(goal) // (self.steps * self.updates)))
        per_lane = -(-len(goal) // lanes)
        padded = per_lane * lanes

        def lay(x: np.ndarray, fill) -> np.ndarray:
            return np.concatenate([x, np.full(padded - len(x), fill, x.dtype)]).reshape(lanes, per_lane).T

        used = lay(np.ones(len(goal), bool), False)
        goal, before, fresh = lay(goal, self.words), lay(before, self.words), lay(begins, False)
        h, losses = np.zeros((lanes, HIDDEN), np.float32), []
        for at in range(0, per_lane, self.steps):
            window = [np.ascontiguousarray(x[at : at + self.steps]) for x in (before, goal, fresh, used)]
            loss, g, rows, h = touched(self.p, *window, h, self.words)
            losses.append(loss)
            self._step(g, rows)
        return float(np.mean(losses))


def score(p: Parameters, words: int, texts: list[np.ndarray], *, lanes: int = 512, steps: int = 32) -> np.ndarray:
    """Natural log-probability of each whole text, the state carried across windows. Texts share lanes, one after another.

    A window has the lanes that have not ended, so memory goes with the sum of the texts, however long one of them is. Few
    lanes have longer windows, as the softmax costs little more for many words than for few.
    """
    total = np.zeros(len(texts))
    table = _thirds(p["embedding"] @ p["input"] + p["bias"])
    lanes = min(lanes, len(texts))
    held, load = [[] for _ in range(lanes)], [(0, i) for i in range(lanes)]
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        size, lane = heapq.heappop(load)
        held[lane].append(i)
        heapq.heappush(load, (size + len(texts[i]), lane))
    sizes = np.zeros(lanes, np.int64)
    for size, lane in load:
        sizes[lane] = size
    order = np.argsort(-sizes, kind="stable")  # lanes that end early are dropped from the end
    sizes = sizes[order]
    texts_in_order = [i for lane in order for i in held[lane]]
    lengths = np.array([len(texts[i]) for i in texts_in_order])
    goal = np.concatenate([texts[i] for i in texts_in_order])
    owner = np.repeat(np.array(texts_in_order, np.int32), lengths)
    begins = np.zeros(len(goal), bool)
    begins[np.cumsum(lengths) - lengths] = True
    before = np.where(begins, np.int32(words + 1), np.concatenate([[np.int32(0)], goal[:-1]]))
    starts = np.cumsum(sizes) - sizes
    h = np.zeros((lanes, HIDDEN), np.float32)
    at = 0
    while at < int(sizes[0]):
        active = int((sizes > at).sum())
        count = min(max(steps, WINDOW // active), int(sizes[0]) - at)
        step = at + np.arange(count)[:, None]
        there = step < sizes[:active]
        cells = np.where(there, starts[:active] + step, starts[:active])
        hidden, h, _ = states(p, table, before[cells], begins[cells], h[:active], False)
        cells = cells[there]
        logs = log_probabilities(p, hidden[there], goal[cells], words)
        total += np.bincount(owner[cells], logs, minlength=len(texts))
        at += count
    return total
